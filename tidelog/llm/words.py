"""Words of UTF-8 texts and 64-bit hashes over them, in numpy, inside tasks.

``bytes.split()`` cuts at the bytes 20 and 09-0D (hex), which is the word pattern
``[^\\x20\\x09-\\x0D]+``; ``bytes.lower()`` changes A-Z only.
"""

from __future__ import annotations

import numpy as np
import xxhash

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
EMPTY = np.zeros(0, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def distinct(h: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    h = np.sort(h)
    return h[np.append(True, h[1:] != h[:-1])] if len(h) else h


def grams(ids: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` consecutive words; order and width count."""
    n = len(ids) - width + 1
    if n <= 0:
        return EMPTY
    h = np.full(n, width, np.uint64)
    for j in range(width):
        h = (h + ids[j : n + j]) * MULTIPLIER
    return mix(h)


def long_grams(ids: np.ndarray, width: int) -> np.ndarray:
    """As ``grams``, for wide runs: joins hashes of runs of doubling width."""
    n = len(ids) - width + 1
    if n <= 0:
        return EMPTY
    out, start, step, runs = np.full(n, np.uint64(width), np.uint64), 0, 1, ids
    rest = width
    while rest:
        if rest & 1:
            out = mix((out + runs[start : start + n]) * MULTIPLIER)
            start += step
        rest >>= 1
        if rest:
            runs = mix((runs[:-step] * MULTIPLIER + runs[step:]) * MULTIPLIER)
            step *= 2
    return out
