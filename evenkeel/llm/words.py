"""Words and word shingles of texts as 64-bit hashes, shared by several operators."""

from __future__ import annotations

import numpy as np
import xxhash

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash; forgets all words beyond ``limit`` to bound memory."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, w: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[w] = h = xxhash.xxh3_64_intdigest(w)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at bytes 9-13 and 32."""
    return utf8(text).lower().split()


def shingles(h: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of runs of ``k`` words; of the whole sequence if there are fewer; empty for none."""
    n = len(h)
    if n == 0:
        return h
    if n < k:
        acc = np.full(1, n, np.uint64)
        for x in h:
            acc = mix(acc * M1 + x)
        return acc
    acc = h[: n - k + 1].copy()
    for i in range(1, k):
        acc *= M1
        acc += h[i : n - k + 1 + i]
    return np.unique(mix(acc))
