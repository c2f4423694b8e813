"""Word shingles and MinHash signatures in numpy, shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
import xxhash

#: Shingles of one block; a long text is hashed block by block, so memory doesn't grow with it.
BLOCK = 4096
_WORDS: dict[str, int] = {}
_WORDS_MOST = 500_000
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def word_hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of words; known ones are looked up."""
    if len(_WORDS) > _WORDS_MOST:
        _WORDS.clear()
    out = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        h = _WORDS.get(w)
        if h is None:
            h = _WORDS[w] = xxhash.xxh64_intdigest(w)
        out[i] = h
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes of ``size`` consecutive words; a shorter text is one shingle, an empty one has none."""
    n = len(words)
    if n == 0:
        return words
    size = min(size, n)
    out = np.zeros(n - size + 1, np.uint64)
    for i in range(size):
        out = mixed(out * np.uint64(3) + words[i : n - size + 1 + i] + _MIX[0])
    return np.unique(out)


def seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed multipliers (odd) and offsets of ``n`` hash functions."""
    base = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * _MIX[0])
    return base[:n] | np.uint64(1), base[n:]


def minhash(items: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each hash function over ``items``; all ones for none."""
    best = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(items), BLOCK):
        part = items[start : start + BLOCK, None] * a[None, :] + b[None, :]
        # the low bits of a product are weak
        np.minimum(best, (part ^ (part >> np.uint64(32))).min(axis=0), out=best)
    return best


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """One signed 64-bit key for each band of ``rows`` values."""
    parts = signature.reshape(-1, rows)
    out = np.arange(1, len(parts) + 1, dtype=np.uint64) * _MIX[0]
    for i in range(rows):
        out = mixed(out ^ parts[:, i])
    return out.view(np.int64)
