"""Word shingle sets as sorted 64-bit hashes.

Words are the runs outside space and \\x09-\\x0D of the text with A-Z lowered.
A shingle's hash is an odd-weighted sum of 64-bit word hashes put through a
finalizer; two different shingles of a pair of documents share a hash with a
chance of about 2**-64, which is the only inexactness of the operators on top.
"""

from __future__ import annotations

import numpy as np
import xxhash

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)
#: Entries after which a worker forgets the word hashes it has seen (about 40 MB).
CACHE_WORDS = 200_000


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finalizer on uint64 arrays."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def weights(k: int) -> np.ndarray:
    return mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)


class WordHashes(dict):
    """Bytes of a word to its hash; a bounded memo, not a vocabulary."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: bytes | None, k: int, memo: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes (uint64); empty for null, empty or blank text."""
    words = text.lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, n)
    if n < k:
        total = np.uint64(n)
        with np.errstate(over="ignore"):
            total = (h * weights(n)).sum(dtype=np.uint64) + np.uint64(n) * _M1
        return mix(np.array([total], np.uint64))
    w = weights(k)
    acc = h[: n - k + 1] * w[0]
    for i in range(1, k):
        acc += h[i : n - k + 1 + i] * w[i]
    return np.unique(mix(acc))
