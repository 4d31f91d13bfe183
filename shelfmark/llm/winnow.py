"""Winnowing over words: the rightmost smallest k-gram hash of each window of `w` k-grams.

Two texts that share k + w - 1 consecutive words share a selected k-gram at the
same place in that span, since the choice depends on the span's words alone.
"""

from __future__ import annotations

import numpy as np
import xxhash

MIX = np.uint64(0x9E3779B97F4A7C15)
STEP = 0xD6E8FEB86659FD93


def code(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def kgrams(codes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash for each run of k words."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * np.uint64(STEP) + codes[j : j + n]
    h ^= h >> np.uint64(29)
    h *= MIX
    return h ^ (h >> np.uint64(32))


def select(h: np.ndarray, w: int) -> np.ndarray:
    """Places of the selected hashes, ascending."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.arange(n)
    if w == 1:
        return at
    least, place = h[:n].copy(), at.copy()
    for j in range(1, w):
        other = h[j : j + n]
        later = other <= least
        least[later] = other[later]
        place[later] = at[later] + j
    return place[np.concatenate(([True], place[1:] != place[:-1]))]


class Filter:
    """A fixed-size bitmap of hashes: most places are ruled out by one look."""

    BITS = 20

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes)
        self.bitmap = np.zeros(1 << self.BITS, bool)
        self.bitmap[self.sorted >> np.uint64(64 - self.BITS)] = True

    def among(self, h: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Those of the places whose hash is known."""
        places = places[self.bitmap[h[places] >> np.uint64(64 - self.BITS)]]
        if not len(places):
            return places
        found = np.searchsorted(self.sorted, h[places])
        found[found == len(self.sorted)] = 0
        return places[self.sorted[found] == h[places]]
