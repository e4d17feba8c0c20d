"""64-bit fingerprints of byte strings, many at a time."""

from __future__ import annotations

import numpy as np

from tracelake.llm.common import worker_table

BASE = 0x9E3779B97F4A7C15
CHUNK = 1 << 20
_MIX = [np.uint64(c) for c in (BASE, 0xC2B2AE3D27D4EB4F)]


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    values = (values ^ (values >> np.uint64(31))) * _MIX[0]
    values = (values ^ (values >> np.uint64(29))) * _MIX[1]
    return values ^ (values >> np.uint64(32))


class Hasher:
    """Fingerprints of substrings by one pass over the bytes; A-Z may count as a-z."""

    def __init__(self, fold: bool) -> None:
        self.letters = mixed(np.arange(1, 257, dtype=np.uint64))
        if fold:
            self.letters[65:91] = self.letters[97:123]
        self.grow(CHUNK)

    def grow(self, size: int) -> None:
        self.power = np.empty(size + 1, np.uint64)
        self.back = np.empty(size + 1, np.uint64)
        for out, base in ((self.power, BASE), (self.back, pow(BASE, -1, 1 << 64))):
            out[0] = 1
            done = 1
            while done <= size:
                more = min(done, size + 1 - done)
                out[done:done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
                done += more

    def sums(self, raw: np.ndarray) -> np.ndarray:
        if len(raw) >= len(self.power):
            self.grow(2 * len(raw))
        out = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.letters[raw] * self.power[:len(raw)], out=out[1:])
        return out

    def between(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((sums[end] - sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def hasher(fold: bool = False) -> Hasher:
    return worker_table(("byte-hasher", fold), lambda: Hasher(fold))
