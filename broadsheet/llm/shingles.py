"""Five-word shingle sets of whole texts as arrays of 64-bit hashes."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

from .common import mix64

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE_WORDS = 5
_SPACES = np.zeros(256, bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _table(size: int, seed: int) -> np.ndarray:
    """Fixed pseudo-random odd 64-bit numbers."""
    return mix64(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_BYTES = _table(256, 1)
_PLACES = _table(4096, 2)
_WORDS = _table(SHINGLE_WORDS, 3)


def word_hashes(text: str) -> np.ndarray:
    """One hash per word, A-Z in lower case."""
    data = _LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    inside = ~_SPACES[data]
    if not inside.any():
        return np.zeros(0, np.uint64)
    starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    letters = np.flatnonzero(inside)
    word = np.cumsum(np.concatenate(([False], ~inside[:-1] & inside[1:]))[letters])
    word -= word[0]
    place = letters - starts[word]
    with np.errstate(over="ignore"):
        # Places beyond the table go round, each time with another factor.
        weight = _PLACES[place & 4095] + (place >> 12).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C16)
        parts = _BYTES[data[letters]] * weight
        first = np.concatenate(([0], np.flatnonzero(np.diff(word)) + 1))
        return mix64(np.add.reduceat(parts, first))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes; a shorter text is one shingle, one without words none."""
    if not text:
        return np.zeros(0, np.uint64)
    words = word_hashes(text)
    n = len(words)
    if n == 0:
        return words
    with np.errstate(over="ignore"):
        if n < SHINGLE_WORDS:
            return mix64((words * _WORDS[:n]).sum(keepdims=True) + np.uint64(n))
        sums = words[: n - SHINGLE_WORDS + 1] * _WORDS[0]
        for k in range(1, SHINGLE_WORDS):
            sums = sums + words[k : n - SHINGLE_WORDS + 1 + k] * _WORDS[k]
        return np.unique(mix64(sums + np.uint64(SHINGLE_WORDS)))


def common_count(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())
