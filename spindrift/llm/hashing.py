"""64-bit hashes of words and word runs, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_A, _B, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
#: Words whose hash a task remembers at most.
REMEMBERED = 300_000


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hashes of the words of texts; white space is U+0020 and U+0009 to U+000D."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: str | None, lower: bool) -> list[bytes]:
    raw = (text or "").encode("utf-8")
    return (raw.lower() if lower else raw).split()  # bytes: A-Z only, ASCII white space only


def runs(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash for each k consecutive words; of fewer words, one for all of them; of none, none."""
    n = len(words)
    if n == 0:
        return words
    k = min(k, n)
    value = np.full(n - k + 1, k + 1000 * seed, np.uint64)
    for j in range(k):
        value = mix(value * _C + words[j : n - k + 1 + j])
    return value


_BASE = 0xD6E8FEB86659FD93
_BACK = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def rolling(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each k consecutive words, as a polynomial of their hashes; for long arrays faster than runs()."""
    n = len(words)
    if n < k:
        return words[:0]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words) * _powers(_BASE, n), dtype=np.uint64)])
    # wherever the words stand, their polynomial is brought back to begin with the power 0
    return mix((sums[k:] - sums[:-k]) * _powers(_BACK, n - k + 1) + np.uint64(k))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
