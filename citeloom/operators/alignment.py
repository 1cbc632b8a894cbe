"""Aligning the texts of two snapshots one to one, from the surest evidence to the weakest.

A snapshot is ``(pos, key, citekey, text)`` with ``pos`` the place in the snapshot's order and ``key`` unique. Texts are
known by checksums; they move only where a place inside another text or a similarity has to be decided.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.functions import similarity
from citeloom.functions import text as tx
from citeloom.operators import containment, graph
from citeloom.operators.containment import contained  # noqa: F401  is part of this module for callers
from citeloom.operators.joins import few_bytes, fetched
from citeloom.operators.lineage import materialize

MIN_LENGTH, RADIUS, THRESHOLD = 50, 5, 0.9
MAPPING = "key1 string, key2 string, stage string"
#: Places of the later snapshot whose texts a worker holds at once.
TILE = 128
#: Rounds after which what they found is written as one table, so that plans stay short.
COMPACT = 4
#: Characters of free texts (and 100 a unit) that are aligned by one worker if they hang together; beyond, rounds go over all tasks.
ISLAND_CHARS = 20_000_000
ABOUT = ["pos", "prefix", "key", "sha", "chars", "start", "cells"]


def _unique(df: DataFrame, by: list[str], key: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("key").alias(key)).where("_n = 1").drop("_n")


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _cells(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: similarity.histogram(t or "").astype("int32"))


def described(df: DataFrame) -> DataFrame:
    """What the stages need to know of a snapshot besides its texts, in some hundred bytes a row: places, checksums, lengths, histograms."""
    clip = tx.clip_first_token(F.col("text"))
    sha = lambda c: F.unhex(F.sha2(c, 256))
    return df.select(
        F.col("pos").cast("long").alias("pos"),
        "key",
        F.substring_index("key", "_", 1).alias("prefix"),
        F.lower("citekey").alias("citekey"),
        sha(F.col("text")).alias("sha"),
        F.length("text").alias("chars"),
        F.substring("text", 1, similarity.PREFIX).alias("start"),
        _cells("text").alias("cells"),
        sha(clip).alias("clip_sha"),
    )


def _same_text(a: DataFrame, b: DataFrame, min_length: int) -> DataFrame:
    long = F.col("chars") >= min_length
    return _unique(a.where(long), ["sha"], "key1").join(_unique(b.where(long), ["sha"], "key2"), "sha").select("key1", "key2", F.lit("text").alias("stage"))


def _same_citekey(a: DataFrame, b: DataFrame) -> DataFrame:
    own = lambda df, k: _unique(df.where("citekey <> ''"), ["citekey", "sha"], k)
    return own(a, "key1").join(own(b, "key2"), ["citekey", "sha"]).select("key1", "key2", F.lit("citekey").alias("stage"))


def _facts(df: DataFrame) -> DataFrame:
    return df.select("key", F.lower("citekey").alias("citekey"), F.unhex(F.sha2("text", 256)).alias("sha"), F.length("text").alias("chars"))


def by_unique_text(one: DataFrame, two: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """Texts of at least ``min_length`` characters that each snapshot has once."""
    return _same_text(_facts(one), _facts(two), min_length)


def by_citekey_and_text(one: DataFrame, two: DataFrame) -> DataFrame:
    """Pairs of citekey (without regard to case) and text that each snapshot has once; citekeys must not be empty."""
    return _same_citekey(_facts(one), _facts(two))


def _containing(one: DataFrame, two: DataFrame, own1: DataFrame, own2: DataFrame, min_length: int) -> DataFrame:
    """``by_containment`` for the rows ``own(key, sha)`` of snapshots of clipped texts. Equal texts are one, with their number as weight."""
    rep1, rep2 = materialize(containment.classes(own1)), materialize(containment.classes(own2))
    there = containment.found_in(containment.asking(one, rep1, min_length), rep2, two, min_length).select(F.col("needle").alias("key1"), F.col("haystack").alias("key2"))
    back = containment.found_in(containment.asking(two, rep2, min_length), rep1, one, min_length).select(F.col("haystack").alias("key1"), F.col("needle").alias("key2"))
    links = materialize(there.unionByName(back).distinct())
    # an end's partners are all members of the classes that it is linked with
    n1, n2 = rep1.select(F.col("key").alias("key1"), F.col("n").alias("n1")), rep2.select(F.col("key").alias("key2"), F.col("n").alias("n2"))
    weighed = links.join(n1, "key1").join(n2, "key2")
    once1 = weighed.groupBy("key1").agg(F.sum("n2").alias("n")).where("n = 1").select("key1")
    once2 = weighed.groupBy("key2").agg(F.sum("n1").alias("n")).where("n = 1").select("key2")
    return weighed.where("n1 = 1 and n2 = 1").join(once1, "key1", "left_semi").join(once2, "key2", "left_semi").select("key1", "key2", F.lit("containment").alias("stage"))


def _clipped(df: DataFrame) -> DataFrame:
    return df.where("key is not null and text is not null").select("key", tx.clip_first_token(F.col("text")).alias("text"))


def by_containment(one: DataFrame, two: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """Texts without their first token that contain one another, either way, where neither end has a second partner."""
    a, b = _clipped(one), _clipped(two)
    return _containing(a, b, materialize(containment.digested(a)), materialize(containment.digested(b)), min_length)


def _left(df: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    return df.join(mapping.select(F.col(key).alias("key")), "key", "left_anti")


def similarities(pairs: DataFrame, one: DataFrame, two: DataFrame) -> DataFrame:
    """``(key1, key2, sim)`` for written ``pairs(key1, key2, at2)``, with the texts of ``one(key, text)`` and ``two(key, text)``.

    Pairs are dealt by ``at2`` into tiles of neighbouring places. A text goes once to every tile that needs it, and a
    worker holds the later texts of one tile, prepared once, while the earlier ones pass by.
    """
    at = F.floor(F.col("at2") / TILE).alias("tile")
    later = pairs.select(at, F.col("key2").alias("key"), F.lit(None).cast("string").alias("partners")).distinct()
    earlier = pairs.groupBy(at, F.col("key1").alias("key")).agg(F.concat_ws("\n", F.collect_set("key2")).alias("partners"))
    wanted = materialize(later.unionByName(earlier))
    sides = [(two, wanted.where("partners is null")), (one, wanted.where("partners is not null"))]
    few = few_bytes(wanted)
    held, asks = (fetched(df.select("key", "text"), keys, "key", few).select("tile", "partners", "key", "text") for df, keys in sides)
    rows = held.unionByName(asks).repartition("tile").sortWithinPartitions("tile", F.col("partners").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, texts = None, {}
        for batch in batches:
            out = []
            for here, partners, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if here != tile:
                    tile, texts = here, {}
                own = similarity.Characters(text)
                if partners is None:
                    texts[key] = own
                else:
                    out += [(key, other, similarity.jaro_winkler_of(own, texts[other])) for other in partners.split("\n")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.float64()))], names=["key1", "key2", "sim"])

    return rows.mapInArrow(run, "key1 string, key2 string, sim double")


def _images(free: DataFrame, placed: DataFrame, radius: int) -> DataFrame:
    """``(key1, p1, p2, x2)``: the places that mapped neighbours of free units have in both snapshots, and the later one's prefix."""
    near = F.explode(F.sequence(F.lit(-radius), F.lit(radius)))
    around = free.select("pos", F.col("prefix").alias("x1"), F.col("key").alias("key1"), near.alias("d")).withColumn("p1", F.col("pos") + F.col("d"))
    return around.join(placed, ["p1", "x1"]).select("key1", "p1", "p2", "x2")


def _possible(images: DataFrame, a: DataFrame, b: DataFrame, radius: int, threshold: float) -> DataFrame:
    """Pairs of free units that may be more alike than the threshold by lengths, starts and histograms, or are equal; rows of places, no texts."""
    near = F.explode(F.sequence(F.lit(-radius), F.lit(radius)))
    asks = images.select("key1", F.col("x2").alias("prefix"), near.alias("d"), "p2").select("key1", "prefix", (F.col("p2") + F.col("d")).alias("pos")).distinct()
    named = lambda df, i: df.select(*(F.col(c).alias(f"{c}{i}") for c in ABOUT))
    pairs = asks.join(b.where("chars > 0").select("pos", "prefix", F.col("key").alias("key2")), ["pos", "prefix"]).select("key1", "key2").distinct()
    pairs = pairs.join(named(a, 1), "key1").join(named(b, 2), "key2")
    ratio = similarity.least_length_ratio(threshold)
    bound = similarity.upper_bound(F.col("chars1"), F.col("chars2"), F.col("cells1"), F.col("cells2"), F.col("start1"), F.col("start2"))
    fits = (F.least("chars1", "chars2") >= F.greatest("chars1", "chars2") * ratio) & (bound > threshold)
    return pairs.where((F.col("sha1") == F.col("sha2")) | fits).select("key1", F.col("pos1").alias("at1"), "key2", F.col("pos2").alias("at2"), "sha1", "sha2")


def _placed(mapping: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    one = a.select(F.col("key").alias("key1"), F.col("pos").alias("p1"), F.col("prefix").alias("x1"))
    two = b.select(F.col("key").alias("key2"), F.col("pos").alias("p2"), F.col("prefix").alias("x2"))
    return mapping.select("key1", "key2").join(one, "key1").join(two, "key2").select("p1", "x1", "p2", "x2")


def _islands(a: DataFrame, b: DataFrame, images: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """``(key, island)`` of the free units of both snapshots, such that no round leads from one island to another.

    What is mapped in a round lets ask only units within the radius of either end. So free units of cells of places
    side by side belong together, and a cell with the cells around the images of its units.
    """
    width = max(radius, 1)
    node = lambda side, x, c: F.xxhash64(F.lit(side), x, c)
    cells = [df.select("prefix", F.floor(F.col("pos") / width).alias("c")).distinct() for df in (a, b)]
    beside = [c.join(c.select("prefix", (F.col("c") - 1).alias("c")), ["prefix", "c"]).select(node(i, F.col("prefix"), F.col("c")).alias("a"), node(i, F.col("prefix"), F.col("c") + 1).alias("b")) for i, c in enumerate(cells, 1)]
    spans = F.explode(F.sequence(F.floor((F.col("p2") - radius) / width), F.floor((F.col("p2") + radius) / width)))
    around = images.join(a.select(F.col("key").alias("key1"), "prefix", F.floor(F.col("pos") / width).alias("c1")), "key1").select("prefix", "c1", "x2", spans.alias("c")).distinct()
    across = around.join(cells[1].withColumnRenamed("prefix", "x2"), ["x2", "c"]).select(node(1, F.col("prefix"), F.col("c1")).alias("a"), node(2, F.col("x2"), F.col("c")).alias("b"))
    parts = graph.components(beside[0].unionByName(beside[1]).unionByName(across))
    of = lambda df, side: df.withColumn("node", node(side, F.col("prefix"), F.floor(F.col("pos") / width))).join(parts, "node").select("key", F.col("component").alias("island"))
    return materialize(of(a, 1)), materialize(of(b, 2))


def _rounds_of(anchors: list[tuple], ones: dict, twos: dict, radius: int, threshold: float) -> list[tuple[str, str]]:
    """The rounds of ``by_neighbours`` on one island: ``ones`` and ``twos`` have ``(key, text)`` by prefix and place, anchors are ``(p1, x1, p2, x2)``."""
    free1, free2, found, waiting, new = dict(ones), dict(twos), [], {}, anchors
    ratio, known, cells = similarity.least_length_ratio(threshold), {}, {}
    near = range(-radius, radius + 1)

    def alike(s: str, t: str) -> float:
        if s == t:
            return 1.0
        if (s, t) not in known:
            sim = 0.0
            if min(len(s), len(t)) >= ratio * max(len(s), len(t)):
                for x in (s, t):
                    if x not in cells:
                        cells[x] = similarity.Characters(x), similarity.histogram(x)
                (p, h), (q, g) = cells[s], cells[t]
                if similarity.bound_of(len(s), len(t), int(np.minimum(h, g).sum())) > threshold:
                    sim = similarity.jaro_winkler_of(p, q)
            known[s, t] = sim
        return known[s, t]

    while True:
        for p1, x1, p2, x2 in new:
            for u in ((x1, p1 + d) for d in near if (x1, p1 + d) in free1):
                for v in ((x2, p2 + d) for d in near if (x2, p2 + d) in free2):
                    if (u, v) not in waiting and free2[v][1] and (sim := alike(free1[u][1], free2[v][1])) > threshold:
                        waiting[u, v] = sim
        best1: dict = {}
        for (u, v), sim in waiting.items():
            best1[u] = max(best1.get(u, (-1.0, 0, None)), (sim, -v[1], v))
        best2: dict = {}
        for u, (sim, _, v) in best1.items():
            best2[v] = max(best2.get(v, (-1.0, 0, None)), (sim, -u[1], u))
        if not best2:
            return found
        found += [(free1.pop(u)[0], free2.pop(v)[0]) for v, (_, _, u) in best2.items()]
        new = [(u[1], u[0], v[1], v[0]) for v, (_, _, u) in best2.items()]
        waiting = {(u, v): sim for (u, v), sim in waiting.items() if u in free1 and v in free2}


def _on_islands(one: DataFrame, two: DataFrame, a: DataFrame, b: DataFrame, images: DataFrame, small: DataFrame, in_a: DataFrame, in_b: DataFrame, radius: int, threshold: float) -> DataFrame:
    """``(key1, key2)`` of the islands ``small(island)``: each goes to one worker with its texts, and all its rounds run there."""
    own1, own2 = (materialize(df.join(small, "island", "left_semi")) for df in (in_a, in_b))
    unit = lambda texts, facts, own, kind: fetched(texts.select("key", "text"), materialize(facts.select("key", "pos", "prefix").join(own, "key")), "key").select("island", F.lit(kind).alias("kind"), "prefix", "pos", F.lit(None).cast("string").alias("x2"), F.lit(None).cast("long").alias("p2"), "key", "text")
    anchors = images.join(own1.withColumnRenamed("key", "key1"), "key1").join(a.select(F.col("key").alias("key1"), "prefix"), "key1").select("island", F.lit(0).alias("kind"), "prefix", F.col("p1").alias("pos"), "x2", "p2").distinct()
    rows = unit(one, a, own1, 1).unionByName(unit(two, b, own2, 2)).unionByName(anchors, allowMissingColumns=True).repartition("island").sortWithinPartitions("island")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ((island, rest) for batch in batches for island, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for _, group in itertools.groupby(table, key=lambda r: r[0]):
            anchors, ones, twos = [], {}, {}
            for _, (kind, prefix, pos, x2, p2, key, text) in group:
                if kind == 0:
                    anchors.append((pos, prefix, p2, x2))
                else:
                    (ones if kind == 1 else twos)[prefix, pos] = key, text
            found = _rounds_of(anchors, ones, twos, radius, threshold)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found, strict=True)], names=["key1", "key2"])

    return rows.mapInArrow(run, "key1 string, key2 string")


def _by_neighbours(one: DataFrame, two: DataFrame, a: DataFrame, b: DataFrame, mapping: DataFrame, radius: int, threshold: float) -> DataFrame:
    """``by_neighbours`` with the written descriptions ``a`` and ``b`` of the snapshots; only their rows move, but for texts of pairs that the bounds left."""
    left_a, left_b = (materialize(_left(df.select(*ABOUT), mapping, k)) for df, k in ((a, "key1"), (b, "key2")))
    images = materialize(_images(left_a, _placed(mapping, a, b), radius).distinct())
    in_a, in_b = _islands(left_a, left_b, images, radius)
    first = _possible(images, left_a, left_b, radius, threshold).select(F.col("key1").alias("key"))
    # an island without a possible pair in the first round never gets one
    alive = first.join(in_a, "key").select("island").distinct()
    sized = in_a.join(left_a.select("key", "chars"), "key").unionByName(in_b.join(left_b.select("key", "chars"), "key")).groupBy("island").agg(F.sum(F.col("chars") + 100).alias("size"))
    sized = materialize(sized.join(alive, "island", "left_semi"))
    local = sized.where(F.col("size") <= ISLAND_CHARS).select("island")
    pairs = _on_islands(one, two, left_a, left_b, images, local, in_a, in_b, radius, threshold)
    found = materialize(pairs.select("key1", "key2", F.lit("neighbours").alias("stage")), containment.TEXTS)
    if not sized.where(F.col("size") > ISLAND_CHARS).take(1):
        return found
    wide = sized.where(F.col("size") > ISLAND_CHARS).select("island")
    wide_a, wide_b = (materialize(df.join(i.join(wide, "island", "left_semi").select("key"), "key", "left_semi")) for df, i in ((left_a, in_a), (left_b, in_b)))
    return found.unionByName(_in_rounds(one, two, a, b, wide_a, wide_b, mapping, radius, threshold))


def _in_rounds(one: DataFrame, two: DataFrame, a: DataFrame, b: DataFrame, left_a: DataFrame, left_b: DataFrame, mapping: DataFrame, radius: int, threshold: float) -> DataFrame:
    """The same rounds, each over all of ``left_a`` and ``left_b``, for islands that are too large for one worker."""
    new, found = mapping.select("key1", "key2", "stage"), new_rows(one)
    waiting, scores = None, None
    for rounds in itertools.count(1):
        free_a, free_b = _left(left_a, found, "key1"), _left(left_b, found, "key2")
        pairs = materialize(_possible(_images(free_a, _placed(new, a, b), radius), free_a, free_b, radius, threshold))
        same = F.col("sha1") == F.col("sha2")
        missing = pairs.where(~same)
        if scores is not None:
            missing = missing.join(scores, ["sha1", "sha2"], "left_anti")
        missing = materialize(missing.groupBy("sha1", "sha2").agg(F.min(F.struct("key1", "key2", "at2")).alias("m")).select("sha1", "sha2", "m.*"))
        if missing.take(1):
            made = materialize(similarities(missing, one, two).join(missing, ["key1", "key2"]).select("sha1", "sha2", "sim"), containment.TEXTS)
            scores = made if scores is None else scores.unionByName(made)
            scores = scores if rounds % COMPACT else materialize(scores)
        scored = pairs.where(same).withColumn("sim", F.lit(1.0))
        if scores is not None:
            scored = scored.unionByName(pairs.where(~same).join(scores, ["sha1", "sha2"]).select(*scored.columns))
        scored = scored.where(F.col("sim") > threshold).select("key1", "at1", "key2", "at2", "sim")
        if waiting is not None:
            scored = scored.unionByName(waiting.join(new.select("key1"), "key1", "left_anti").join(new.select("key2"), "key2", "left_anti")).distinct()
        waiting = materialize(scored)
        best = waiting.groupBy("key1").agg(F.max_by(F.struct("key2", "at1", "at2", "sim"), F.struct("sim", -F.col("at2"))).alias("x")).select("key1", "x.*")
        new = materialize(best.groupBy("key2").agg(F.max_by("key1", F.struct("sim", -F.col("at1"))).alias("key1")).select("key1", "key2", F.lit("neighbours").alias("stage")))
        if not new.take(1):
            return found
        found = found.unionByName(new) if rounds % COMPACT else materialize(found.unionByName(new))


def new_rows(df: DataFrame) -> DataFrame:
    """An empty mapping."""
    return df.sparkSession.createDataFrame([], MAPPING)


def by_neighbours(one: DataFrame, two: DataFrame, mapping: DataFrame, radius: int = RADIUS, threshold: float = THRESHOLD) -> DataFrame:
    """Texts near the partner of a neighbour and more alike than ``threshold``, in rounds until none is found.

    A candidate lies within ``radius`` places of the image of a mapped neighbour and has the same key prefix. A round
    takes every text's best candidate (by similarity, then places) and, where several want one text, the best of those.
    Only the pairs of the round before ask for candidates; those of earlier rounds that are alike and still free wait.
    Units that no round can bring together are islands; an island of at most ``ISLAND_CHARS`` runs all its rounds in one
    task, larger ones share rounds over all tasks, with the same result. Similarities are kept by both texts; a pair that lengths, common starts or histograms of
    characters rule out is never computed, and texts of the others are fetched once.
    """
    a, b = (materialize(described(df), containment.TEXTS) for df in (one, two))
    return _by_neighbours(one, two, a, b, materialize(mapping.select("key1", "key2", "stage")), radius, threshold)


def align(one: DataFrame, two: DataFrame, min_length: int = MIN_LENGTH, radius: int = RADIUS, threshold: float = THRESHOLD) -> DataFrame:
    """``(key1, key2, stage)``: all four stages, each on what the earlier ones left. The mapping is one to one.

    Snapshots are read several times and should be cheap to read (tables, column functions). Null keys and texts take
    no part; an empty snapshot maps nothing.
    """
    one, two = (df.where("key is not null and text is not null") for df in (one, two))
    a, b = (materialize(described(df), containment.TEXTS) for df in (one, two))
    done = materialize(_same_text(a, b, min_length))
    done = materialize(done.unionByName(_same_citekey(_left(a, done, "key1"), _left(b, done, "key2"))))
    own = lambda df, key: materialize(_left(df.select("key", F.col("clip_sha").alias("sha")), done, key))
    done = materialize(done.unionByName(_containing(_clipped(one), _clipped(two), own(a, "key1"), own(b, "key2"), min_length)))
    return done.unionByName(_by_neighbours(one, two, a, b, done, radius, threshold))


def progress(mapping: DataFrame, one: DataFrame, two: DataFrame) -> DataFrame:
    """How many units are mapped by every stage, and which share of the smaller snapshot all of them are: ``(stage, n, share)``."""
    least = one.agg(F.count(F.lit(1)).alias("n1")).join(two.agg(F.count(F.lit(1)).alias("n2"))).select(F.least("n1", "n2").alias("least"))
    each = mapping.groupBy("stage").agg(F.count(F.lit(1)).alias("n"))
    every = mapping.agg(F.lit("all").alias("stage"), F.count(F.lit(1)).alias("n"))
    return each.unionByName(every).join(F.broadcast(least)).select("stage", "n", (F.col("n") / F.col("least")).alias("share"))
