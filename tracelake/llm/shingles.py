"""Word shingles as 64-bit fingerprints."""

from __future__ import annotations

import numpy as np

from tracelake.llm.hashing import hasher, mixed

#: Fixed value: the bytes between words.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, start, end) of the runs of bytes other than ASCII white space; A-Z count as a-z."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    edge = np.diff(_SPACE[raw].view(np.int8), prepend=1, append=1)
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    tools = hasher(fold=True)
    return tools.between(tools.sums(raw), start, end), start, end


def fingerprints(codes: np.ndarray, size: int = 5) -> np.ndarray:
    """Fingerprint of the ``size`` words from each position on; one of the whole if there are fewer."""
    if not len(codes):
        return codes
    width = min(size, len(codes))
    out = np.full(len(codes) - width + 1, width, np.uint64)
    for i in range(width):
        out = mixed(out + codes[i:i + len(out)])
    return out


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Distinct fingerprints of a text, ascending."""
    return np.unique(fingerprints(words(text)[0], size))
