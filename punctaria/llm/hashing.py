"""Word and shingle hashes on whole texts, for Arrow-fed operators."""

from __future__ import annotations

import numpy as np
import xxhash

#: Hashes of words kept by a task; the cache is emptied beyond it.
CACHE_WORDS = 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hash of each word as bytes."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingle_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a document's word hashes; shorter documents are one shingle."""
    if not len(h):
        return h
    size = min(size, len(h))
    out = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        out = (out + h[k : len(out) + k]) * _MIX
        out ^= out >> np.uint64(31)
    return np.unique(out)
