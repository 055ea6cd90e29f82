"""Words, shingles and MinHash signatures of whole texts, vectorised with NumPy.

A word is a maximal run of bytes outside ``\\x20\\x09-\\x0D`` after A-Z are
lower-cased; ``bytes.lower`` and ``bytes.split`` do exactly that on UTF-8.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Words remembered with their hashes; the memory is emptied when it is full.
MEMO_WORDS = 200_000
_memo: dict[bytes, int] = {}

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on an array of uint64."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """The lower-cased words of a text; none for null."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    if len(_memo) > MEMO_WORDS:
        _memo.clear()
    try:
        found = list(map(_memo.__getitem__, words))
    except KeyError:
        for w in set(words):
            if w not in _memo:
                _memo[w] = xxhash.xxh3_64_intdigest(w)
        found = list(map(_memo.__getitem__, words))
    return np.array(found, dtype=np.uint64)


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words, in order; of the whole sequence, if it is shorter."""
    if not len(hashes):
        return hashes
    m = min(n, len(hashes))
    total = np.zeros(len(hashes) - m + 1, dtype=np.uint64)
    for j in range(m):
        total += hashes[j : j + len(total)] * _ODD[j]
    return mix64(total + np.uint64(m))


_ODD = mix64(np.arange(1, 65, dtype=np.uint64) * _STEP) | np.uint64(1)


def shingle_set(text: str | None, n: int = 5) -> np.ndarray:
    """The distinct hashed n-word shingles of a whole text, ascending."""
    return np.unique(gram_hashes(word_hashes(words_of(text)), n))


class Signer:
    """MinHash signatures of k coordinates, each kept to 32 bits."""

    def __init__(self, k: int = 64, seed: int = 1) -> None:
        at = np.arange(1, 2 * k + 1, dtype=np.uint64) * _STEP + np.uint64(seed)
        self.k, self.xor, self.times = k, mix64(at[:k])[:, None], (mix64(at[k:]) | np.uint64(1))[:, None]

    def sign(self, shingles: np.ndarray) -> np.ndarray:
        """The signature of a non-empty set, worked off in pieces that fit in a core's cache."""
        best = np.full(self.k, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        for at in range(0, len(shingles), 1024):
            np.minimum(best, ((shingles[None, at : at + 1024] ^ self.xor) * self.times).min(axis=1), out=best)
        return (best >> np.uint64(32)).astype(np.uint32)


def similar(a: np.ndarray, b: np.ndarray, percent: int = 75) -> bool:
    """Whether 100 * intersection >= percent * union, on two ascending distinct arrays."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.intersect1d(a, b, assume_unique=True).size
    return 100 * both >= percent * (len(a) + len(b) - both)
