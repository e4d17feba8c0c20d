"""Fingerprints of any stretch of a byte string in constant time, after one pass over it."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)


def _scramble(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


_LETTER = _scramble(np.arange(1, 257, dtype=np.uint64))


class Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, size: int) -> None:
        while len(self.up) <= size:
            more = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(BASE, more, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(_INVERSE, more, 1 << 64))])


class Rolling:
    """Fingerprints of stretches of one byte string; equal stretches have equal fingerprints."""

    def __init__(self, data: bytes, powers: Powers) -> None:
        powers.upto(len(data))
        self.down = powers.down
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_LETTER[np.frombuffer(data, np.uint8)] * powers.up[:len(data)], out=self.sums[1:])

    def at(self, start: np.ndarray, length) -> np.ndarray:
        """Fingerprints of ``length`` bytes from each start on."""
        return _scramble((self.sums[start + length] - self.sums[start]) * self.down[start])

    def all(self, length: int) -> np.ndarray:
        """Fingerprints of ``length`` bytes from every place on."""
        count = len(self.sums) - length
        return _scramble((self.sums[length:] - self.sums[:count]) * self.down[:count]) if count > 0 else np.zeros(0, np.uint64)


def fingerprint(data: bytes, powers: Powers) -> int:
    return int(Rolling(data, powers).at(np.zeros(1, np.int64), len(data))[0])
