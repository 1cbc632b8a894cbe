"""Hashed n-gram presence, shared by the two text classifiers; everything is computed with numpy per text."""

from __future__ import annotations

import numpy as np

_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_FOLD = np.uint64(29)


def codes(text: str) -> np.ndarray:
    """Code points of ``text``."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def gram_buckets(values: np.ndarray, longest: int, bits: int) -> np.ndarray:
    """Different buckets, ascending, of all n-grams of ``values`` for every n from 1 to ``longest``.

    The hash of an n-gram is made of that of the gram one shorter and the next value.
    """
    flags = np.zeros(1 << bits, dtype=bool)
    shift = np.uint64(64 - bits)
    h = np.zeros(len(values), dtype=np.uint64)
    for n in range(1, min(longest, len(values)) + 1):
        h = (h[: len(values) - n + 1] + values[n - 1 :] + np.uint64(n)) * _MULT
        h ^= h >> _FOLD
        flags[(h * _MIX) >> shift] = True
    return np.flatnonzero(flags)
