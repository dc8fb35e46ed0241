"""Word and shingle hashing shared by the text operators.

Words are runs of bytes other than space and ``\\t \\n \\v \\f \\r``; that is what
``bytes.split()`` yields, so a whole text costs one C call. A word's name is its
64-bit XXH3, shingles combine names by a fixed linear form with wrap-around, so
the same words get the same numbers on every executor.
"""

from __future__ import annotations

import numpy as np
import xxhash

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (splitmix64)."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def split_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words of a whole text; null and empty texts have none."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.translate(_LOWER) if lower else raw).split()


def word_ids(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def windows(ids: np.ndarray, width: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """A hash for each run of ``width`` consecutive ids, by start. Another odd ``base`` gives an independent one."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    factor = np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(width):
            factor = factor * np.uint64(base)
            out += mix(ids[k : k + n]) * factor if k == 0 and width == 1 else ids[k : k + n] * factor
    return mix(out)


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of ``width``-word shingles of the lower-cased text;
    a shorter text is one shingle, a text without words has none."""
    ids = word_ids(split_words(text, lower=True))
    if not len(ids):
        return ids
    return np.unique(windows(ids, min(width, len(ids))))
