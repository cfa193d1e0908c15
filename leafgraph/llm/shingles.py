"""Hashes of word shingles, shared by fingerprints and the n-gram join."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words kept per worker before the cache starts anew.
CACHED = 200_000


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finalizer of SplitMix64; fixed values)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class ShingleHasher:
    """64-bit hashes of runs of `words` words; words are runs of non-space characters, lower-cased."""

    def __init__(self, words: int = 5) -> None:
        self.words, self.seen = words, {}

    def hashes(self, text: str | None) -> np.ndarray:
        """One hash for each position, repeated ones included; one for all words of a shorter text; none without words."""
        tokens = (text or "").lower().split()
        if not tokens:
            return np.empty(0, np.uint64)
        seen = self.seen
        if len(seen) > CACHED:
            seen.clear()
        for w in {*tokens}.difference(seen):
            seen[w] = xxhash.xxh3_64_intdigest(w)
        w = np.fromiter(map(seen.__getitem__, tokens), np.uint64, len(tokens))
        n = min(self.words, len(w))
        out = w[: len(w) - n + 1].copy()
        for i in range(1, n):
            out *= np.uint64(0x9E3779B97F4A7C15)
            out += w[i : len(w) - n + 1 + i]
        return mix(out ^ np.uint64(n))
