"""Jaro-Winkler similarity, which Spark lacks, as a vectorised function, and bounds that spare its computation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Weight of a common start, its longest length that counts, and the value from which it counts.
SCALE, PREFIX, BOOST = 0.1, 4, 0.7
#: Cells of a histogram of characters.
CELLS = 64


class Characters:
    """A text's code points, and their places sorted by character; made once for all pairs that the text is in."""

    def __init__(self, text: str):
        self.points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.places = np.argsort(self.points, kind="stable")
        self.kinds, self.first, self.count = np.unique(self.points[self.places], return_index=True, return_counts=True)


def _greedy(a: np.ndarray, b: np.ndarray, reach: int) -> tuple[list[int], list[int]]:
    """Places of one character in both texts that match: each of the first text takes the first free one within reach."""
    k, own, other = 0, [], []
    for i in a.tolist():
        while k < len(b) and b[k] < i - reach:
            k += 1
        if k < len(b) and b[k] <= i + reach:
            own.append(i)
            other.append(int(b[k]))
            k += 1
    return own, other


def jaro_winkler_of(a: Characters, b: Characters) -> float:
    """1 for equal texts, 0 if nothing matches; a common start of up to ``PREFIX`` characters lifts values above ``BOOST``.

    Characters match independently of each other. Where the places of a character, taken in pairs from the first on,
    are all within reach, these pairs are the match; only for the other characters places are taken one by one.
    """
    n, m = len(a.points), len(b.points)
    if n == m and np.array_equal(a.points, b.points):
        return 1.0 if n else 0.0
    if not n or not m:
        return 0.0
    reach = max(max(n, m) // 2 - 1, 0)
    _, x, y = np.intersect1d(a.kinds, b.kinds, assume_unique=True, return_indices=True)
    size = np.minimum(a.count[x], b.count[y])
    ends = np.cumsum(size)
    if not len(size):
        return 0.0
    inner = np.arange(ends[-1]) - np.repeat(ends - size, size)
    own, other = a.places[np.repeat(a.first[x], size) + inner], b.places[np.repeat(b.first[y], size) + inner]
    far = np.abs(own - other) > reach
    if far.any():
        odd = np.logical_or.reduceat(far, ends - size)
        keep = np.repeat(~odd, size)
        pairs = [_greedy(a.places[a.first[i] : a.first[i] + a.count[i]], b.places[b.first[j] : b.first[j] + b.count[j]], reach) for i, j in zip(x[odd], y[odd], strict=True)]
        own = np.concatenate([own[keep], *(np.array(p[0], dtype=np.int64) for p in pairs)])
        other = np.concatenate([other[keep], *(np.array(p[1], dtype=np.int64) for p in pairs)])
    matches = len(own)
    if not matches:
        return 0.0
    moved = int((a.points[np.sort(own)] != b.points[np.sort(other)]).sum()) // 2
    jaro = (matches / n + matches / m + (matches - moved) / matches) / 3
    if jaro <= BOOST:
        return jaro
    short = min(PREFIX, n, m)
    differ = np.flatnonzero(a.points[:short] != b.points[:short])
    same = int(differ[0]) if len(differ) else short
    return jaro + same * SCALE * (1 - jaro)


def jaro_winkler(a: str, b: str) -> float:
    return jaro_winkler_of(Characters(a), Characters(b))


def least_length_ratio(least: float) -> float:
    """The shorter length over the longer one below which no pair of texts reaches a Jaro-Winkler similarity of ``least``."""
    # at most all of the shorter text matches in order, (ratio + 2) / 3, and the whole prefix is common
    jaro = max((least - PREFIX * SCALE) / (1 - PREFIX * SCALE), BOOST) if least > BOOST else least
    return max(3 * jaro - 2 - 1e-9, 0.0)


def histogram(text: str) -> np.ndarray:
    """How many characters of the text fall into each of ``CELLS`` cells, by a hash of the character."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.bincount((points * np.uint32(2654435761)) >> np.uint32(26), minlength=CELLS)


def bound_of(n: int, m: int, matches: int) -> float:
    """What texts of ``n`` and ``m`` characters with at most so many matches can't exceed, with the longest common start."""
    jaro = (matches / max(n, 1) + matches / max(m, 1) + 1) / 3
    return (jaro + PREFIX * SCALE * (1 - jaro) if jaro > BOOST else jaro) + 1e-9


def upper_bound(chars1: Column, chars2: Column, cells1: Column, cells2: Column, start1: Column, start2: Column) -> Column:
    """What the similarity of two texts can't exceed, from their lengths, histograms and first ``PREFIX`` characters; stays in the JVM.

    No more characters match than both histograms have in common, and at best none of them is out of order.
    """
    matches = F.aggregate(F.zip_with(cells1, cells2, lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    jaro = (matches / F.greatest(chars1, F.lit(1)) + matches / F.greatest(chars2, F.lit(1)) + 1) / 3
    same = F.lit(0)
    for k in range(PREFIX, 0, -1):
        common = (F.length(start1) >= k) & (F.length(start2) >= k) & (F.substring(start1, 1, k) == F.substring(start2, 1, k))
        same = F.when((same == 0) & common, k).otherwise(same)
    return F.when(jaro > BOOST, jaro + same * SCALE * (1 - jaro)).otherwise(jaro) + 1e-9


@F.pandas_udf(T.DoubleType())
def jaro_winkler_column(a: pd.Series, b: pd.Series) -> pd.Series:
    """Null if either text is null. Pairs that repeat in a batch are computed once, texts are prepared once."""
    texts: dict[str, Characters] = {}
    known: dict[tuple[str, str], float] = {}
    out = []
    for pair in zip(a, b, strict=True):
        if pair[0] is None or pair[1] is None:
            out.append(None)
            continue
        if pair not in known:
            for t in pair:
                if t not in texts:
                    texts[t] = Characters(t)
            known[pair] = jaro_winkler_of(texts[pair[0]], texts[pair[1]])
        out.append(known[pair])
    return pd.Series(out, dtype="float64")
