"""Word shingles as sorted 64-bit hashes, vectorised.

Two different shingles collide with a chance of about 2^-64 a pair; no other step here is approximate.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers of the word positions (fixed values).
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
#: Words whose hash is remembered at most.
REMEMBERED = 500_000


class WordHashes(dict):
    """Hash of each word's bytes; forgets everything when it has grown to REMEMBERED words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of each value over the whole word."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(text: bytes, memory: WordHashes) -> np.ndarray:
    """The hashes of a UTF-8 text's words: A-Z lower-cased, split at ASCII white space."""
    words = text.lower().split()
    return np.fromiter(map(memory.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_set(text: bytes, k: int, memory: WordHashes) -> np.ndarray:
    """Sorted distinct hashes (int64) of the k-word shingles; a shorter text is one shingle, a blank one none."""
    w = word_hashes(text, memory)
    if not len(w):
        return np.empty(0, dtype=np.int64)
    size = min(k, len(w))
    m = len(w) - size + 1
    h = np.full(m, size, dtype=np.uint64)
    for i in range(size):
        h += w[i : i + m] * ODD[i]
    return np.unique(mixed(h).view(np.int64))
