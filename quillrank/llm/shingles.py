"""Sets of word shingles as sorted 64-bit hashes, and their minimum hashes."""

from __future__ import annotations

import numpy as np
import xxhash

MEMO_WORDS = 100_000
CHUNK = 1 << 13


class WordHashes(dict):
    """64-bit hash of each word; forgotten and begun anew when it has grown to MEMO_WORDS."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed value for each 64-bit value, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; with fewer words, of the whole sequence."""
    if not len(words):
        return words
    width = min(k, len(words))
    odd = np.random.default_rng(k).integers(1, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    total = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        total += words[i : len(words) - width + 1 + i] * odd[i]
    return np.unique(mixed(total))


def min_hashes(hashes: np.ndarray, size: int, seed: int = 11) -> np.ndarray:
    """`size` minimum hashes of 32 bits."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, size, dtype=np.uint64)
    least = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), CHUNK):
        part = hashes[start : start + CHUNK]
        np.minimum(least, (part[:, None] * a + b).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0
