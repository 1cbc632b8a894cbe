"""N-gram Jaccard join: documents whose sets of word shingles are alike, and the groups that such links make.

A set is a sorted array of 48-bit shingle hashes. Equal sets fall into one class first, so copies cost nothing more.
Candidates share a shingle of their prefixes (AllPairs: with any one order of all shingles, two sets of the wanted
similarity share one of their first ``n - ceil(t n) + 1``); the order puts shingles that many documents have last.
Where many classes share a shingle, they are dealt into tiles: blocks of classes, ordered by size so that a band of
sizes meets only those bands that the threshold allows. Every set has a bitmap whose bits say whether an odd number of
its shingles falls there (odd sketches, Mitzenmacher et al. 2014); a shingle that only one of two sets has changes one
bit, so the bits in which two bitmaps differ bound the overlap from above, and only pairs that pass are compared
exactly, by intersecting the sorted arrays.

Groups need no more links than connect them. So before tiles are made, rounds of stars compare the classes under a
shingle with one of them, and pairs that a star has connected are skipped. No pair of different groups is skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm import common

#: Shingle size in words; similarity in hundredths.
SHINGLE, PERCENT = 5, 80
#: Classes of a block of a tile; most rounds of stars; bits of the table of common shingles; occurrences in a task from which one counts as common.
BLOCK, STARS, ORDER_BITS, COMMON = 512, 6, 18, 8
#: Classes of a shingle from which stars come first; rows of a packed tile.
CROWD, PACK = 8, 8192
#: Rows with whole texts or sets that Python gets at once; bits of the table that a task counts shingles in.
TEXT_ROWS, COUNT_BITS = 500, 22
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


_HIGH = np.uint64(0xFFFFFFFFFFFF0000)
_BASE = 0x9FB21C651E98DF25  # odd, so that its powers have inverses
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """A random value for every byte, capital ASCII letters like small ones; and which bytes are ASCII white space."""
    values = np.random.default_rng(20).integers(0, 2**64, 256, dtype=np.uint64)
    values[65:91] = values[97:123]
    space = np.zeros(256, dtype=bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    return values, space


_VALUES, _SPACE = _tables()


def word_hashes(data: bytes) -> np.ndarray:
    """A hash of every word: its bytes' values weighted by powers of the base, from sums over the whole text."""
    b = np.frombuffer(data, dtype=np.uint8)
    if len(_powers[0]) <= len(b):
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            _powers[k] = np.concatenate([np.ones(1, dtype=np.uint64), np.cumprod(np.full(2 * len(b), base, dtype=np.uint64))])
    edges = np.flatnonzero(np.diff(_SPACE[b], prepend=True, append=True))
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[b] * _powers[0][: len(b)], out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * _powers[1][starts])


def shingles(text: str | None) -> np.ndarray:
    """Sorted different hashes of the shingles of a text: A-Z lower-cased, words cut at ASCII white space.

    A text of fewer than five words has one shingle, all of its words; one without words has none.
    """
    h = word_hashes(text.encode("utf-8", "surrogatepass")) if text else ()
    if not len(h):
        return np.empty(0, dtype=np.uint64)
    n = min(SHINGLE, len(h))
    size = len(h) - n + 1
    out = np.full(size, np.uint64(n), dtype=np.uint64)
    for k in range(n):
        out += h[k : k + size] * _MULT[k]
        out ^= out >> np.uint64(31)
    return np.unique(_mix(out) & _HIGH)


def packed(h: np.ndarray) -> bytes:
    """Six bytes a hash; the two lowest are zero."""
    return np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    out[:, 2:] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - (percent * n + 99) // 100 + 1


def least_overlap(a, b, percent: int = PERCENT):
    """The smallest size of an intersection at which 100 * intersection >= percent * union."""
    return -((a + b) * -percent // (100 + percent))


def bitmap(h: np.ndarray) -> bytes:
    """Whether an odd number of shingles falls on a bit, in as many bits as shingles, rounded up to a power of two."""
    bits = max(64, 1 << int(len(h) - 1).bit_length())
    counts = np.bincount((h >> np.uint64(16) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(bitmaps: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of words, all folded to the length of the shortest by adding their halves without carry."""
    short = min(map(len, bitmaps))
    out = np.empty((len(bitmaps), short // 8), dtype=np.uint64)
    for i, b in enumerate(bitmaps):
        words = np.frombuffer(b, dtype=np.uint64)
        out[i] = np.bitwise_xor.reduce(words.reshape(-1, short // 8), axis=0)
    return out


def _sets(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(doc, n, k1, k2, set)`` per row: the sorted array of its shingles, and (n, k1, k2), which names the set.

    Texts are read once; all later steps read this table, in which six bytes a shingle are about as much as the text.
    """

    def turn(texts: list) -> list[pa.Array]:
        found = [shingles(t) for t in texts]
        k1 = np.array([h.sum(dtype=np.uint64) for h in found], dtype=np.uint64).view(np.int64)
        k2 = np.array([np.bitwise_xor.reduce(_mix(h + np.uint64(1))) for h in found], dtype=np.uint64).view(np.int64)
        return [pa.array([len(h) for h in found], type=pa.int64()), pa.array(k1), pa.array(k2), pa.array([packed(h) for h in found], type=pa.binary())]

    named = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("t"))
    return common.materialize(common.map_texts(named, "t", "n long, k1 long, k2 long, set binary", lambda: turn, keep=["doc"]), TEXT_ROWS)


def _common_shingles(sets: DataFrame) -> np.ndarray:
    """A table of fixed size: for the highest bits of a shingle's hash, how often shingles there occur (a logarithm).

    It only orders prefixes, and any order gives all candidates, so counts are rough: every task counts the shingles of
    its different sets in a table of fixed size and sends the places that have clearly more than their share. Maxima of
    equal buckets leave at most the table's size to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, total = np.zeros(1 << COUNT_BITS, dtype=np.uint32), set(), 0
        for batch in batches:
            for a, b in common.parts(batch, batch.column(0)):
                for data, k1 in zip(batch.column(0)[a:b].to_pylist(), batch.column(1)[a:b].to_pylist(), strict=True):
                    if k1 not in seen:
                        seen.add(k1)
                        h = unpacked(data)
                        total += len(h)
                        counts[h >> np.uint64(64 - COUNT_BITS)] += 1  # shingles of a set that share a place count once
        often = np.flatnonzero(counts >= COMMON + 3 * total / len(counts))
        at, most = often >> (COUNT_BITS - ORDER_BITS), np.zeros(1 << ORDER_BITS, dtype=np.int64)
        np.maximum.at(most, at, counts[often].astype(np.int64))
        at = np.flatnonzero(most)
        yield pa.RecordBatch.from_arrays([pa.array(at, type=pa.int64()), pa.array(most[at])], names=["at", "n"])
        del counts, often, most
        common.give_back()

    with common.arrow_rows(sets.sparkSession, TEXT_ROWS):
        found = sets.select("set", "k1").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(1 << ORDER_BITS, dtype=np.uint8)
    if len(found):
        table[found["at"].to_numpy(dtype=np.int64)] = np.log2(found["n"].to_numpy(dtype=np.float64)).astype(np.uint8)
    return table


def _classes(sets: DataFrame, order: np.ndarray, percent: int) -> DataFrame:
    """``(n, k1, k2, id, bits, prefix)`` of every different set with shingles; ``id`` is the smallest key that has it."""
    shared = sets.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, names = shared.value, ["doc", "n", "k1", "k2", "bits", "prefix"]
        for batch in batches:
            for a, b in common.parts(batch, batch.column(4)):
                bits, prefixes = [], []
                for data in batch.column(4)[a:b].to_pylist():
                    h = unpacked(data)
                    bits.append(bitmap(h))
                    prefixes.append(h[np.argsort(table[h >> np.uint64(64 - ORDER_BITS)], kind="stable")][: prefix_size(len(h), percent)].view(np.int64))
                some = batch.slice(a, b - a)
                ends = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(prefixes)))
                yield pa.RecordBatch.from_arrays([*(some.column(i) for i in range(4)), pa.array(bits, type=pa.binary()), lists], names=names)
        common.give_back()

    signed = sets.where("n > 0 and doc is not null").select("doc", "n", "k1", "k2", "set").mapInArrow(run, "doc long, n long, k1 long, k2 long, bits binary, prefix array<long>")
    grouped = signed.groupBy("n", "k1", "k2").agg(F.min("doc").alias("id"), F.min_by("bits", "k1").alias("bits"), F.min_by("prefix", "k1").alias("prefix"))
    return common.materialize(grouped, TEXT_ROWS)


def overlap(a: bytes, b: bytes) -> int:
    """Size of the intersection of two sorted arrays without repeats."""
    both = np.concatenate([unpacked(a), unpacked(b)])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def _possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` that sizes and bitmaps don't rule out."""

    @F.pandas_udf("boolean")
    def may(na: pd.Series, nb: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        def one(n: int, m: int, p: bytes, q: bytes) -> bool:
            if percent * max(n, m) > 100 * min(n, m):
                return False
            bits = folded([p, q])
            return (n + m - int(np.bitwise_count(bits[0] ^ bits[1]).sum())) // 2 >= least_overlap(n, m, percent)

        return pd.Series([one(*row) for row in zip(na.tolist(), nb.tolist(), x, y, strict=True)], dtype=bool)

    pairs = common.materialize(pairs)
    # each side moves the bitmaps of its own ends only: those of stars' centres are few
    wanted = lambda end: common.with_filter(classes.select(F.col("id").alias(end), F.col("n").alias(f"n{end}"), F.col("bits").alias(f"x{end}")), pairs.select(end), "_may", [end]).where("_may").drop("_may")
    left, right = wanted("a").hint("merge"), wanted("b").hint("merge")
    return common.materialize(pairs.join(left, "a").join(right, "b").where(may("na", "nb", "xa", "xb")).select("a", "b").distinct(), TEXT_ROWS)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the written ``pairs(a, b)`` that are as similar as wanted. A filter of fixed size keeps the sets of other keys out of the shuffle."""

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([100 * (o := overlap(x, y)) >= percent * ((len(x) + len(y)) // 6 - o) for x, y in zip(a, b, strict=True)], dtype=bool)

    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc"))
    wanted = common.with_filter(sets.where("n > 0"), ids, "_may", ["doc"]).where("_may")
    left = wanted.select(F.col("doc").alias("a"), F.col("set").alias("sa")).hint("merge")
    right = wanted.select(F.col("doc").alias("b"), F.col("set").alias("sb")).hint("merge")
    return common.materialize(pairs.join(left, "a").join(right, "b").where(alike("sa", "sb")).select("a", "b").distinct(), TEXT_ROWS)


def _tile_pairs(percent: int):
    """Pairs of a tile that belong to different groups and whose bitmaps don't rule them out.

    A tile has the blocks of one shingle, or the classes of many shingles that few have; rows meet under their shingle only.
    Sizes and bitmaps of its classes come beside it, each once.
    """

    def run(tile: pd.DataFrame, signed: pd.DataFrame) -> pd.DataFrame:
        if not len(tile):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        signed = signed.sort_values("s_id")
        tile = tile.assign(at=np.searchsorted(signed["s_id"].to_numpy(), tile["id"].to_numpy()))
        tile["n"] = signed["n"].to_numpy()[tile["at"].to_numpy()]
        tile = tile.sort_values(["token", "n", "id"], kind="stable")
        token, n, group, block, ids = (tile[c].to_numpy() for c in ("token", "n", "comp", "block", "id"))
        held, two, found = signed["bits"].tolist(), tile["t1"].iloc[0] != tile["t2"].iloc[0], []
        bitmaps = [held[k] for k in tile["at"].tolist()]
        cuts = np.concatenate([[0], np.flatnonzero(token[1:] != token[:-1]) + 1, [len(token)]]).tolist()
        for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
            while start < stop - 1:  # a band of sizes, and all larger ones that the threshold allows beside it
                sizes = n[start:stop]
                end = start + int(np.searchsorted(sizes, n[start] * 5 // 4, side="right"))
                last = start + int(np.searchsorted(sizes, n[end - 1] * 100 // percent, side="right"))
                if last - start > 1:
                    bits = folded(bitmaps[start:last])
                    ends = start + np.searchsorted(sizes, n[start:end] * 100 // percent, side="right")
                    for i in range(start, end):
                        j = slice(i + 1, int(ends[i - start]))
                        apart = np.bitwise_count(bits[j.start - start : j.stop - start] ^ bits[i - start]).sum(axis=1, dtype=np.int64)
                        fit = ((n[j] + n[i] - apart) // 2 >= least_overlap(n[j], n[i], percent)) & (group[j] != group[i])
                        if two:
                            fit &= block[j] != block[i]
                        if fit.any():
                            other = ids[j][fit]
                            found.append(np.column_stack([np.minimum(other, ids[i]), np.maximum(other, ids[i])]))
                start = end
        pairs = np.concatenate(found) if found else np.empty((0, 2), dtype=np.int64)
        return pd.DataFrame(np.unique(pairs, axis=0), columns=["a", "b"])

    return run


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``n_shingles`` and ``component_id``.

    Two documents link when 100 * intersection >= ``percent`` * union of their shingle sets. ``component_id`` is the
    smallest key that links reach, the own one included. Null, empty and wordless texts have 0 shingles and stay
    alone. Keys are whole numbers; a null key has a null component unless its set occurs with another key, and then
    that one's; rows that share a key count as one document in links. An empty table gives no rows.
    """
    return common.condensed(lambda: _groups(docs, key, text, percent))


def _groups(docs: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    sets = _sets(docs, key, text)
    full = sets.where("n > 0")
    classes = _classes(sets, _common_shingles(sets), percent)
    tokens = classes.select(F.explode("prefix").alias("token"), "id", "n")
    # shingles of one class stay where they are, but for a few that the filter passes
    often = common.materialize(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("token"))
    sifted = common.with_filter(tokens, often, "_may", ["token"]).where("_may").drop("_may")
    shared = _different_groups(sifted.join(often.hint("merge"), "token"))  # classes that share a prefix shingle with another one
    comps = _components(sets, classes, shared, percent)
    members = classes.select("n", "k1", "k2", "id").join(comps.withColumnRenamed("node", "id"), "id", "left").select("n", "k1", "k2", F.coalesce("component", "id").alias("component_id"))
    joined = full.select("doc", "n", "k1", "k2").join(members, ["n", "k1", "k2"], "left").select("doc", "n", "component_id")
    alone = sets.where("n = 0").select("doc", "n", F.col("doc").alias("component_id"))
    return joined.unionByName(alone).select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), "component_id")


def _near(a, b, percent: int):
    """Whether two sizes allow the wanted similarity."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.greatest(a, b) * percent <= F.least(a, b) * 100


def _with_partner(rows: DataFrame, percent: int) -> DataFrame:
    """``rows(token, id, n, c, comp)`` without those whose shingle no class of another group and a near size has.

    Rows of more than ``CROWD`` to a shingle stay as they are, so what is gathered by a shingle is bounded.
    """
    few = F.col("c") <= CROWD
    held = rows.where(few).groupBy("token").agg(F.collect_list(F.struct("id", "n", "c", "comp")).alias("m"))
    kept = F.filter("m", lambda x: F.exists("m", lambda y: (x["comp"] != y["comp"]) & _near(x["n"], y["n"], percent)))
    return common.materialize(rows.where(~few).select("token", "id", "n", "c", "comp").unionByName(held.select("token", F.inline(kept))))


def _different_groups(rows: DataFrame) -> DataFrame:
    """``rows(token, id, n)`` of one token for every different set of ids, with its size ``c``: alike classes share many shingles, and one says it all.

    Sets are named by their size and two hashes that are combined without order, so no set is ever gathered.
    """
    rows = common.materialize(rows)
    named = rows.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("id")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("x2"))
    kept = common.materialize(named.groupBy("c", "x1", "x2").agg(F.min("token").alias("token")).select("token", "c"))
    return common.materialize(common.with_filter(rows, kept, "_may", ["token"]).where("_may").drop("_may").join(kept.hint("merge"), "token"))


def _components(sets: DataFrame, classes: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """``(node, component)`` of all classes that link with another class; ``shared`` has ``token, id, n, c``."""
    left, comps = shared.withColumn("comp", F.col("id")), None
    crowded = left.where(F.col("c") > CROWD)
    before = None
    for r in range(STARS):
        now = crowded.select("token", "comp").distinct().count()
        if not now or (before is not None and now > 0.9 * before):  # rounds that connect little more are left to the tiles
            break
        before = now
        # the smallest key first, from which copies are often made, then others
        order = F.col("id") if r == 0 else F.xxhash64(F.lit(r), "id")
        centre = crowded.groupBy("token").agg(F.min_by(F.struct("id", "comp", "n"), order).alias("c")).select("token", F.col("c.id").alias("pid"), F.col("c.comp").alias("pc"), F.col("c.n").alias("pn"))
        pairs = crowded.join(centre, "token").where(F.col("comp") != F.col("pc")).where(_near("n", "pn", percent)).select(F.least("id", "pid").alias("a"), F.greatest("id", "pid").alias("b")).distinct()
        comps = _joined(comps, _verified(_possible(pairs, classes, percent), sets, percent))
        left = _open(left.drop("comp"), comps)
        crowded = left.where(F.col("c") > CROWD)
    left = _with_partner(left, percent)
    blocks = F.ceil(F.col("c") / BLOCK)
    dealt = left.withColumn("block", F.pmod(F.xxhash64("id"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    # shingles of one block are packed with others that have the same smallest class, some thousands of rows to a tile, so
    # that a bitmap travels once for many shingles; those of more blocks have tiles of their own
    per = left.groupBy("token").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows"))
    homes = per.join(per.groupBy("least").agg(F.ceil(F.sum("rows") / PACK).alias("slices")).hint("merge"), "least").select("token", "least", "slices")
    packs = max(1, left.count() // PACK)
    part = F.when(F.col("slices") > 1, F.concat_ws("_", F.lit("m"), "least", F.pmod(F.xxhash64("token"), F.col("slices")))).otherwise(F.concat(F.lit("p"), F.pmod(F.xxhash64("least"), F.lit(packs)).cast("string")))
    tile = F.when(blocks > 1, F.concat(F.lit("t"), F.col("token").cast("string"))).otherwise(part)
    names = ["tile", "t1", "t2"]
    tiles = dealt.join(homes, "token").select(tile.alias("tile"), F.least("block", "other").alias("t1"), F.greatest("block", "other").alias("t2"), "token", "block", "id", "comp")
    tiles = common.materialize(tiles)
    # classes of open shingles only
    wanted = common.with_filter(classes.select("id", "n", "bits"), left.select("id"), "_may", ["id"]).where("_may").drop("_may")
    own = tiles.select(*(F.col(c).alias(f"s_{c}") for c in [*names, "id"])).distinct()
    signed = own.join(wanted.withColumnRenamed("id", "s_id").hint("merge"), "s_id")
    found = common.materialize(tiles.groupBy(*names).cogroup(signed.groupBy(*(f"s_{c}" for c in names))).applyInPandas(_tile_pairs(percent), "a long, b long").distinct())
    return _joined(comps, _verified(found, sets, percent))


def _open(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """``rows(token, id, n, c)`` with their groups, of the shingles whose classes aren't all in one group yet."""
    named = rows.join(comps.withColumnRenamed("node", "id"), "id", "left").select("token", "id", "n", "c", F.coalesce("component", "id").alias("comp"))
    split = named.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")
    return common.materialize(named.join(split, "token"))


def _joined(comps: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after more links; the earlier ones are stars already."""
    return common.connected_components(links if comps is None else comps.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))


def keep_one_per_group(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose key is the smallest of their group; rows with a null key stay."""
    groups = similar_groups(docs, key, text, percent)
    gone = groups.where(F.col(key) != F.col("component_id")).select(F.col(key).alias("_gone")).distinct()
    return docs.join(gone.hint("merge"), docs[key] == gone["_gone"], "left_anti")  # one plan for every size
