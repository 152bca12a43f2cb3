"""Hashes of character n-grams and words of whole batches, by shifted arrays."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from disputa.llm.bpe import char_classes
from disputa.llm.common import mix

_STEP = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def folded() -> np.ndarray:
    """Lower-case form of the code points below 0x600 where it is one code point."""
    out = np.arange(0x600, dtype=np.uint32)
    for code in range(0x600):
        low = chr(code).lower()
        if len(low) == 1:
            out[code] = ord(low)
    return out


def lower(codes: np.ndarray) -> np.ndarray:
    table = folded()
    return np.where(codes < len(table), table[np.minimum(codes, len(table) - 1)], codes)


def letters_or_gap(codes: np.ndarray) -> np.ndarray:
    """Lower-case letters; everything else is 0."""
    return np.where(char_classes()[codes] == 0, lower(codes), np.uint32(0))


def spaced(codes: np.ndarray) -> np.ndarray:
    """Lower-case code points; white space is 0."""
    return np.where(char_classes()[codes] == 3, np.uint32(0), lower(codes))


def padded(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a 0 before each and one at the end, and for each code point the index of its text."""
    lengths = np.diff(offsets)
    owner = np.repeat(np.arange(len(lengths)), lengths + 1)
    out = np.zeros(len(owner) + 1, np.uint32)
    inner = np.arange(len(codes)) + np.repeat(np.arange(len(lengths)), lengths) + 1
    out[inner] = codes
    return out, np.append(owner, max(0, len(lengths) - 1))


def ngrams(stream: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the n-grams of a padded stream: no 0 inside, at most at either end, and not 0s alone."""
    size = len(stream) - n + 1
    if size <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    full = stream != 0
    good = full[1 : 1 + size].copy() if n > 1 else full[:size].copy()
    for k in range(2, n - 1):
        good &= full[k : k + size]
    if n == 2:
        good = full[:size] | full[1 : 1 + size]
    at = np.flatnonzero(good)
    code = np.full(len(at), n, np.uint64)
    for k in range(n):
        code = code * _STEP + stream[at + k]
    return at, mix(code)
