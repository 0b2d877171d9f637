"""Words, hashes of words and shingle sets of texts, as numpy arrays."""

from __future__ import annotations

import numpy as np
import xxhash


MIX1, MIX2, GOLDEN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
#: Hash of a word, as bytes (quicker than to look it up among those seen).
word_hash = xxhash.xxh3_64_intdigest


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * MIX2
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words `[^\\x20\\x09-\\x0D]+` of a text with A-Z lower-cased."""
    words = (text or "").encode().lower().split()
    return np.fromiter(map(word_hash, words), np.uint64, len(words))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of the whole sequence where it has fewer words; empty without words."""
    h = word_hashes(text)
    n = len(h)
    if n == 0:
        return h
    size = min(k, n)
    total = mixed(h[: n - size + 1] + np.uint64(size))
    for i in range(1, size):
        total = mixed(total * GOLDEN + h[i : n - size + 1 + i])
    return np.unique(total)
