"""Periodic runs of words, by the Lyndon words of a text under an order of its words and under the inverse order.

For every place the longest Lyndon word that starts there ends at the next smaller suffix, and one scan from right to
left finds these ends with a stack (Bannai et al. 2017: every run has a root among these words under one of the two
orders). Suffixes are compared by their longest common extension: a few words directly, then a binary search over
rolling hashes, whose answer is checked word by word where that stretch wasn't checked before for the same distance.
Roots are extended both ways the same way. There is no suffix array.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm import common

#: Fewest words of a run, and fewest periods that it holds.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words that are compared before hashes are asked; modulus and base of the hashes.
NEAR, MOD, BASE = 8, (1 << 61) - 1, 1_000_003_000_029
OUT = "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class Sequence:
    """Words as numbers, equal ones for equal words, with common extensions of two places."""

    def __init__(self, numbers: list[int]):
        self.w, self.n = numbers, len(numbers)
        self._raw = memoryview(array("I", numbers)).cast("B")
        self._hash: array | None = None
        self._power: array | None = None
        # by distance: the last stretch [a, b) whose words are known to be those at that distance behind them
        self._checked: dict[int, tuple[int, int]] = {}

    def _same(self, i: int, j: int, k: int) -> bool:
        """Whether ``k`` words from ``i`` and from ``j`` on have one hash."""
        if self._hash is None:
            h, p, a, b = array("Q", [0]), array("Q", [1]), 0, 1
            for x in self.w:
                a, b = (a * BASE + x + 1) % MOD, b * BASE % MOD
                h.append(a)
                p.append(b)
            self._hash, self._power = h, p
        h, p = self._hash, self._power[k]
        return (h[i + k] - h[i] * p - h[j + k] + h[j] * p) % MOD == 0

    def _directly(self, a: int, b: int, shift: int) -> bool:
        """Whether the words of ``[a, b)`` are those ``shift`` later, read word by word but for what was read before."""
        lo, hi = self._checked.get(shift, (0, 0))
        # only what lies outside the known stretch is read
        for x, y in ((a, min(b, lo)), (max(a, hi), b)) if lo <= b and a <= hi else ((a, b),):
            if x < y and self._raw[4 * x : 4 * y] != self._raw[4 * (x + shift) : 4 * (y + shift)]:
                return False
        self._checked[shift] = (min(a, lo), max(b, hi)) if lo <= b and a <= hi and lo < hi else (a, b)
        return True

    def _most(self, near: int, most: int, same: Callable[[int], bool]) -> int:
        """The largest ``k`` up to ``most`` with ``same(k)``, which holds for ``near``: in steps that double, then by halves."""
        step, low = near, near
        while low < most and same(min(low + step, most)):
            low, step = min(low + step, most), 2 * step
        high = min(low + step, most)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if same(mid) else (low, mid - 1)
        return low

    def ahead(self, i: int, j: int) -> int:
        """How many words from ``i`` and from ``j`` on agree, for ``i < j``."""
        w, most, k = self.w, self.n - j, 0
        lo, hi = self._checked.get(j - i, (0, 0))
        if lo <= i + 1 < hi and w[i] == w[j]:  # at this distance the words up to hi were read before
            self._checked[j - i] = (min(i, lo), hi)
            k = hi - i
        near = min(k + NEAR, most)
        while k < near and w[i + k] == w[j + k]:
            k += 1
        if k < near or k == most:
            return k
        k = self._most(k, most, lambda m: self._same(i, j, m))
        if self._directly(i, i + k, j - i):
            return k
        return next((m for m in range(most) if w[i + m] != w[j + m]), most)  # two stretches had one hash

    def behind(self, i: int, j: int) -> int:
        """How many words before ``i`` and before ``j`` agree, for ``i < j``."""
        w, most, k = self.w, i, 0
        near = min(NEAR, most)
        while k < near and w[i - 1 - k] == w[j - 1 - k]:
            k += 1
        if k < NEAR or k == most:
            return k
        k = self._most(k, most, lambda m: self._same(i - m, j - m, m))
        if self._directly(i - k, i, j - i):
            return k
        return next((m for m in range(most) if w[i - 1 - m] != w[j - 1 - m]), most)

    def lyndon_ends(self, inverse: bool) -> list[int]:
        """For every place the end of the longest Lyndon word that starts there, under the order of the numbers or its inverse.

        The ends met from a place on are its stack: each is the next smaller suffix of the one before. A suffix that
        is a start of another one is smaller under both orders.
        """
        n = self.n
        v = [-x for x in self.w] if inverse else self.w
        end = [n] * n
        for i in range(n - 2, -1, -1):
            a, j = v[i], i + 1
            while j < n:
                b = v[j]
                if a < b:
                    j = end[j]
                elif a > b:
                    break
                else:
                    k = self.ahead(i, j)
                    if j + k == n or v[i + k] > v[j + k]:
                        break
                    j = end[j]
            end[i] = j
        return end


def runs_of(numbers: list[int]) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of a sequence by start, then period: at least ``LEAST_WORDS`` long and ``LEAST_PERIODS`` periods.

    A run of four periods holds its root three times in a row from the first one on, and each time the root is the
    longest Lyndon word; so only places with three equal lengths in a row are extended.
    """
    n = len(numbers)
    if n < LEAST_WORDS:
        return []
    seq, w, found = Sequence(numbers), np.array(numbers, dtype=np.int64), set()
    for inverse in (False, True):
        end = np.array([*seq.lyndon_ends(inverse), n], dtype=np.int64)
        size = end - np.arange(n + 1)
        at = np.flatnonzero(end[:n] < n)
        for _ in range(2):  # the next root, then the one after it
            at = at[(size[end[at]] == size[at]) & (w[at] == w[np.minimum(end[at], n - 1)])]
            if not len(at):
                break
            later = np.minimum(at + 2 * size[at], n)
            at = at[(later < n) & (size[later] == size[at])]
        done: dict[int, int] = {}
        for i in at.tolist():
            p = int(size[i])
            if i + 3 * p <= done.get(p, 0):
                continue  # lies in the run of this period that was found last
            before, after = seq.behind(i, i + p), seq.ahead(i, i + p)
            length = before + p + after
            done[p] = i - before + length
            if length >= max(LEAST_WORDS, LEAST_PERIODS * p):
                found.add((i - before, length, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _turn() -> Callable[[list], list]:
    def turn(texts: list) -> list:
        counts, runs, left = [], [], []
        for t in texts:
            words = t.split() if t else []  # of bytes: white space is ASCII's
            numbers: dict[bytes, int] = {}
            own = runs_of([numbers.setdefault(x, len(numbers)) for x in words])
            keep = bytearray(b"\1") * len(words)
            for start, length, period in own:
                keep[start + period : start + length] = bytes(length - period)
            counts.append(len(words))
            runs.append([{"start": s, "length": n, "period": p} for s, n, p in own])
            left.append(b" ".join(x for x, k in zip(words, keep, strict=True) if k) if own else b" ".join(words))
        return [pa.array(counts, pa.int64()), pa.array(runs, _RUNS), pa.array(left, pa.binary()).cast(pa.string())]

    return turn


def periodic_runs(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``n_words``, ``runs`` and ``collapsed``, the words without what a run repeats after its first period, joined by a space.

    A run is a stretch of consecutive words whose smallest period ``q`` fits ``LEAST_PERIODS`` times, at least
    ``LEAST_WORDS`` long, that no neighbouring word extends. Runs are in order of start, then period. Words are cut at
    ASCII white space and compared byte by byte.

    Null, empty and blank texts have no words, no runs and an empty ``collapsed``. Repeated rows are answered each; an
    empty table gives no rows. Columns of ``df`` with the names of the three are replaced, all others stay. A text of
    any length is one row of one task: its time grows with its words times their logarithm at most, its memory with
    some 120 bytes a word.
    """
    name = "_bytes"
    while name in df.columns:
        name += "_"
    kept = [c for c in df.columns if c not in ("n_words", "runs", "collapsed")]
    return common.map_texts(df.withColumn(name, F.col(f"`{text}`").cast("binary")), name, OUT, _turn, kept)


def strongest(runs: str = "runs"):
    """The run of greatest exact length over period, the earliest and then that of the smallest period of equals; null if there is none."""
    better = lambda a, b: a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"])
    first = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(runs, first, lambda a, b: F.when(better(a, b), b).otherwise(a))


def with_planted_runs(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``df`` whose texts repeat a piece of their own to the end in a tenth of the rows, which a checksum of ``key`` chooses.

    With ``h`` the checksum (crc32) of the key as text and ``g`` a tenth of it: if ``h`` ends in 0, words from ``g mod n``
    on are replaced by repeats of the next ``1 + (n - g mod n) / (3 + g mod 8)``, rounded down. Rows without words or key stay.
    """
    words = F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    h = F.crc32(F.col(key).cast("string"))
    drawn = df.withColumn("_h", h).withColumn("_w", F.when(F.col("_h") % 10 == 0, words))
    n, g = F.size("_w"), F.floor(F.col("_h") / 10)
    start = (g % n).cast("int")
    period = (1 + F.floor((n - start) / (3 + g % 8))).cast("int")
    cycle = F.flatten(F.array_repeat(F.slice("_w", start + 1, period), F.ceil((n - start) / period).cast("int")))
    planted = F.array_join(F.concat(F.slice("_w", 1, start), F.slice(cycle, 1, n - start)), " ")
    return drawn.withColumn(text, F.when(F.coalesce(n, F.lit(0)) > 0, planted).otherwise(F.col(text))).drop("_h", "_w")
