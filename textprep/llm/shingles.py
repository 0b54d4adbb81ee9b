"""Hashed word shingles of texts, inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

from textprep.llm.common import mixed64

ORDERED = np.uint64(0x9E3779B97F4A7C15)  # odd; keeps the order of words in a shingle's hash


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased."""
    words = text.lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """One hash per run of ``k`` words; fewer words are one shingle, no words none."""
    k = min(k, len(words)) or 1
    n = len(words) - k + 1
    out = mixed64(words[:n] + np.uint64(k))
    for j in range(1, k):
        out = mixed64(out * ORDERED ^ words[j : j + n])
    return out
