"""Texts that occur inside others: an index of sampled character grams with positions, in blocks of doubling length.

Of every window of consecutive grams of a text those with the smallest hash are marked. Marks between a text's first
and last one depend on the text in between only, so where a text lies in another one, its marks follow each other there
at the same distances. A needle asks with two blocks of marks that start and end it and together cover it: each is the
largest power of two that its marks hold. Blocks of one or two marks are short, so what a needle has before its first and
behind its last mark goes into their hashes too, in steps of a gram: no window begins there, so it is less than a window.
Haystacks file their blocks of all these lengths, the short ones with every number of steps, after a filter of the needles' blocks, so that hardly more than true finds are moved. A needle goes by the rarer one of its two blocks; the
other must be filed at the right distance; then a checksum of the place decides. Texts of needles are never moved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.operators.joins import fetched, key_filter, mapped_of, passes
from citeloom.operators.lineage import materialize

#: Bytes of a gram if texts are long enough for it; factors that mix hashes.
GRAM, _A, _B, _C = 8, np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
#: Marks of the blocks whose hashes have grams around them: fewer than so many grams of random text are no rarity.
AROUND = 2
#: Rows that are given back at once, texts that pass to Python at once, bytes of texts whose blocks are made at once.
ROWS, TEXTS, PART = 50_000, 500, 200_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def _extreme(x: np.ndarray, width: int, best) -> np.ndarray:
    """The least or largest of every ``width`` consecutive values, by doubling."""
    step = 1
    while 2 * step <= width:
        x, step = best(x[:-step], x[step:]), 2 * step
    return x if step == width else best(x[: len(x) - (width - step)], x[width - step :])


def shape(min_bytes: int) -> tuple[int, int]:
    """``(gram, window)`` such that every text of ``min_bytes`` has a whole window of grams."""
    gram = GRAM if min_bytes >= 2 * GRAM else 1
    return gram, max(min_bytes - gram + 1, 1)


def marks(text: bytes, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """``(places, hashes)`` of the grams that are the least of a window; equal ones of a window are marked all."""
    places, h = _marked(text, gram, window)
    return places, h[places]


def _marked(text: bytes, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of marks, and the hashes of all grams."""
    n = len(text) - gram + 1
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    x, step = np.frombuffer(text, dtype=np.uint8).astype(np.uint64), 1
    while step < gram:
        x, step = (x[:-step] << np.uint64(8 * step)) | x[step:], 2 * step
    h = _mixed(x)
    least = np.zeros(n + window - 1, dtype=np.uint64)
    least[window - 1 : n] = _extreme(h, window, np.minimum)
    places = np.flatnonzero(_extreme(least, window, np.maximum) == h)
    return places, h


def blocks(places: np.ndarray, hashes: np.ndarray) -> Iterator[np.ndarray]:
    """Hashes of all blocks of 1, 2, 4 ... marks by their first mark, distances of the marks included."""
    step, block = 1, hashes
    while len(block):
        yield block
        gaps = (places[step : step + len(block) - step] - places[: max(len(block) - step, 0)]).astype(np.uint64)
        block, step = _mixed(block[: len(gaps)] * _C + block[step : step + len(gaps)] + gaps), 2 * step


class Marks(NamedTuple):
    """Marks of several texts, whose grams stand one behind the other: places there, the text of each mark, hashes of all grams, where a text's begin."""

    places: np.ndarray
    owner: np.ndarray
    h: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes], gram: int, window: int) -> Marks:
        places, h = zip(*(_marked(t, gram, window) for t in texts), strict=True)
        first = np.cumsum([0, *map(len, h)])
        counts = list(map(len, places))
        return cls(np.concatenate(places) + np.repeat(first[:-1], counts), np.repeat(np.arange(len(texts)), counts), np.concatenate(h), first)

    def begins(self, marks: np.ndarray) -> np.ndarray:
        """Where marks are in their own texts."""
        return self.places[marks] - self.first[self.owner[marks]]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[bytes]]]:
    """Keys and texts of about ``PART`` bytes, so that what is done for many texts at once stays small."""
    for batch in batches:
        keys, texts, size = [], [], 0
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keys.append(key)
            texts.append(text)
            size += len(text)
            if size >= PART:
                yield keys, texts
                keys, texts, size = [], [], 0
        if keys:
            yield keys, texts


def _around(block: np.ndarray, edge: np.ndarray, owner: np.ndarray, marked: Marks, gram: int, window: int, side: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(which, hashes)`` of the blocks with one, two ... grams more that end (``side`` -1) or begin (1) at their edges, as far as their texts have them."""
    which, key = np.arange(len(block)), block
    for step in range(1, (window - 1) // gram + 1 if gram == GRAM else 1):
        at = edge[which] + gram * (-step if side < 0 else step - 1)
        held = (at >= marked.first[owner[which]]) & (at < marked.first[owner[which] + 1])
        which, key = which[held], _mixed(key[held] * (_C if side < 0 else _A) + marked.h[at[held]])
        if not len(which):
            return
        yield which, key


def _bare(block: np.ndarray) -> np.ndarray:
    """The hashes by which the filter knows short blocks without what is around them."""
    return _mixed(block ^ _B)


def filed(marked: Marks, gram: int, window: int, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(hashes, first marks)`` by which haystacks are found: of all blocks, and of short ones that needles have, with what is before or behind them."""
    for level, block in enumerate(blocks(marked.places, marked.h[marked.places])):
        n = 1 << level
        begin = np.flatnonzero(marked.owner[: len(block)] == marked.owner[n - 1 :])
        if not len(begin):
            return
        block = block[begin]
        if n <= AROUND:
            own = passes(bits, _bare(block))
            block, begin = block[own], begin[own]
            owner = marked.owner[begin]
            for edge, side in ((marked.places[begin], -1), (marked.places[begin + n - 1] + gram, 1)):
                for which, key in _around(block, edge, owner, marked, gram, window, side):
                    yield key, begin[which]
        yield block, begin


def asked(marked: Marks, gram: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(ends, at, bare, short)`` by side and needle: hashes of its two blocks, short ones with all that it has before and behind them, and where these begin; what ``_bare`` gives for short ones, and whether they are short."""
    n = np.bincount(marked.owner, minlength=len(marked.first) - 1)
    start, top = np.cumsum(n) - n, np.frexp(n)[1] - 1
    ends, at, bare = (np.zeros((2, len(n)), dtype=t) for t in (np.uint64, np.int64, np.uint64))
    for level, block in enumerate(blocks(marked.places, marked.h[marked.places])):
        if level > top.max():
            break
        own, width = np.flatnonzero(top == level), 1 << level
        for i, (mark, side) in enumerate(((start[own], -1), (start[own] + n[own] - width, 1))):
            key, at[i][own] = block[mark], marked.begins(mark)
            if width <= AROUND:
                bare[i][own] = _bare(key)
                edge = marked.places[mark] if side < 0 else marked.places[mark + width - 1] + gram
                for which, longer in _around(block[mark], edge, own, marked, gram, window, side):
                    key[which] = longer
            ends[i][own] = key
    return ends.view(np.int64), at, bare.view(np.int64), (1 << np.maximum(top, 0)) <= AROUND


_NEEDLE = "needle string, bytes long, sha binary, first long, first_at long, last long, last_at long, first_bare long, last_bare long"


def needles_of(texts: DataFrame, min_length: int) -> DataFrame:
    """``(key, text)`` of at least ``min_length`` characters as needles: their checksum, their two blocks and where these begin."""
    gram, window = shape(min_length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, held in _parts(batches):
            ends, at, bare, short = asked(Marks.of(held, gram, window), gram, window)
            own = [pa.array(keys, pa.string()), pa.array([len(t) for t in held], pa.int64()), pa.array([hashlib.sha256(t).digest() for t in held], pa.binary())]
            numbers = [ends[0], at[0], ends[1], at[1], *(pa.array(b, mask=~short) for b in bare)]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(c) if isinstance(c, np.ndarray) else c for c in numbers)], names=_NEEDLE.replace(",", "").split()[::2])

    long = texts.where(F.length("text") >= max(min_length, 1)).select("key", F.col("text").cast("binary").alias("text"))
    return long.mapInArrow(run, _NEEDLE)


def postings_of(texts: DataFrame, bits: np.ndarray, min_length: int) -> DataFrame:
    """``(haystack, rest, block, at)``: blocks of marks of ``(key, text)`` that pass the filter, where they begin and the bytes from there on."""
    gram, window = shape(min_length)
    held = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ends, found, at, n = [], [], [], [], 0
        made = lambda: pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array(np.concatenate(c) if c else [], pa.int64()) for c in (ends, found, at))], names=["haystack", "rest", "block", "at"])
        for names, texts in _parts(batches):
            marked = Marks.of(texts, gram, window)
            levels = list(filed(marked, gram, window, held.value))
            if not levels:
                continue
            block, begin = (np.concatenate(x) for x in zip(*levels, strict=True))
            hit = np.flatnonzero(passes(held.value, block))
            owner, start = marked.owner[begin[hit]], marked.begins(begin[hit])
            keys += [names[i] for i in owner.tolist()]
            ends.append(np.array([len(t) for t in texts])[owner] - start)
            found.append(block[hit].view(np.int64))
            at.append(start)
            n += len(hit)
            if n >= ROWS:
                yield made()
                keys, ends, found, at, n = [], [], [], [], 0
        if n:
            yield made()

    texts = texts.where(F.length("text") >= max(min_length, 1)).select("key", F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, "haystack string, rest long, block long, at long")


def known_by(needles: DataFrame) -> DataFrame:
    """``(block)``: the hashes of the filter for rows of ``needles_of``."""
    return needles.select(F.explode(F.array_compact(F.array("first", "last", "first_bare", "last_bare"))).alias("block"))


def asking(texts: DataFrame, keys: DataFrame, min_length: int) -> DataFrame:
    """The rows of ``needles_of`` for the texts of ``keys``, written."""
    return materialize(mapped_of(texts, keys, "key", lambda df: needles_of(df, min_length), "needle"), TEXTS)


def found_in(needles: DataFrame, haystacks: DataFrame, texts: DataFrame, min_length: int) -> DataFrame:
    """``(needle, haystack)`` for rows of ``needles_of``: the keys among ``haystacks(key, sha)`` whose ``texts(key, text)`` hold the needle.

    Keys are unique and not null; ``needles`` and ``haystacks`` are written already. Texts move only for places that both
    blocks left, those of haystacks.
    """
    bits = key_filter(known_by(needles), "block")
    postings = materialize(mapped_of(texts, haystacks, "key", lambda df: postings_of(df, bits, min_length), "haystack"), TEXTS)
    frequency = postings.groupBy("block").agg(F.count(F.lit(1)).alias("df"))
    ways = needles.select("needle", F.explode(F.array(*(F.struct(F.col(a).alias("block"), F.col(f"{a}_at").alias("at"), F.col(b).alias("other"), F.col(f"{b}_at").alias("other_at")) for a, b in (("first", "last"), ("last", "first"))))).alias("w"))
    ways = ways.select("needle", "w.*").join(frequency, "block")
    # both blocks must be filed somewhere; the rarer one asks
    rarer = ways.groupBy("needle").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("df", "block", "at", "other", "other_at")).alias("w")).where("n = 2").select("needle", "w.block", F.col("w.at").alias("own_at"), "w.other", "w.other_at")
    rarer = rarer.join(needles.select("needle", "bytes", "sha"), "needle")
    spots = rarer.join(postings, "block").withColumn("shift", F.col("at") - F.col("own_at")).where("shift >= 0 and rest >= bytes - own_at")
    ends = postings.select("haystack", F.col("block").alias("other"), F.col("at").alias("other_there"))
    both = spots.withColumn("other_there", F.col("other_at") + F.col("shift")).join(ends, ["haystack", "other", "other_there"], "left_semi")
    places = both.select("needle", F.col("haystack").alias("key"), "shift", "bytes", F.col("sha").alias("needle_sha")).distinct()
    places = materialize(places.join(haystacks.select("key", F.col("sha").alias("key_sha")), "key"))
    # a text that is the needle needs no look at it
    equal = F.col("needle_sha") == F.col("key_sha")
    unsure = places.where(~equal).select("needle", "key", "shift", "bytes", "needle_sha")
    raw = texts.select("key", F.col("text").cast("binary").alias("raw"))
    piece = F.expr("substring(raw, cast(shift + 1 as int), cast(bytes as int))")
    held = fetched(raw, unsure, "key").where(F.unhex(F.sha2(piece, 256)) == F.col("needle_sha"))
    return places.where(equal).select("needle", F.col("key").alias("haystack")).unionByName(held.select("needle", F.col("key").alias("haystack"))).distinct()


def digested(texts: DataFrame) -> DataFrame:
    """``(key, sha)`` of texts, by which equal ones are known without moving them."""
    return texts.select("key", F.unhex(F.sha2("text", 256)).alias("sha"))


def classes(keys: DataFrame) -> DataFrame:
    """``(sha, key, n)``: of keys with one checksum the least, and how many they are."""
    return keys.groupBy("sha").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("n"))


def contained(needles: DataFrame, haystacks: DataFrame, min_length: int = 50, fixed_ends: bool = False) -> DataFrame:
    """``(needle, haystack)`` for ``(key, text)`` tables: texts of at least ``min_length`` characters that occur inside others, exactly.

    Equal texts are one text on either side until the end, where every pair of keys is named. With ``fixed_ends`` the
    first and the last word of a needle must also be words of the haystack. Null texts and keys take no part, nor do
    empty needles; an empty table gives no rows.
    """
    parts = [df.where("key is not null and text is not null").select("key", "text") for df in (needles, haystacks)]
    own = [materialize(digested(df)) for df in parts]
    rep = [materialize(classes(df)) for df in own]
    found = found_in(asking(parts[0], rep[0], min_length), rep[1], parts[1], min_length)
    if fixed_ends:
        words = F.split("nt", " ")
        ends = F.array(F.get(words, F.lit(0)), F.element_at(words, -1))
        pairs = found.join(parts[0].select(F.col("key").alias("needle"), F.col("text").alias("nt")), "needle").join(parts[1].select(F.col("key").alias("haystack"), F.col("text").alias("ht")), "haystack")
        found = pairs.where(F.size(F.array_except(ends, F.split("ht", " "))) == 0).select("needle", "haystack")
    members = [a.join(b.select("sha", F.col("key").alias("rep")), "sha").select(F.col("key").alias(name), F.col("rep").alias(f"_{name}")) for a, b, name in ((own[0], rep[0], "needle"), (own[1], rep[1], "haystack"))]
    return found.withColumnsRenamed({"needle": "_needle", "haystack": "_haystack"}).join(members[0], "_needle").join(members[1], "_haystack").select("needle", "haystack")
