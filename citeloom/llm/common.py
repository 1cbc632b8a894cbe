"""What the corpus operators share: cut lineage, bounded broadcasts and samples, connected components."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.operators.lineage import arrow_rows, materialize, new_path, release, scope

__all__ = ["arrow_rows", "class_sample", "condensed", "connected_components", "crc_fold", "fits", "give_back", "join_small", "map_texts", "materialize", "new_path", "release", "scope", "with_filter"]

#: A side of a join is broadcast up to this many bytes; beyond that the join shuffles, and deals a key over so many tasks.
MAX_BROADCAST_BYTES, SALTS = 16_000_000, 16
#: Bytes of text that a worker turns at once. A batch from the JVM is cut to it, so memory doesn't grow with texts or rows.
PART_BYTES = 500_000
#: Bits of a filter for joins.
FILTER_BITS = 1 << 25


def condensed(build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build()`` returns, written; all tables that it cut on the way are removed, whether it succeeds or not.

    For results much smaller than what they are made of. Nothing but ``build`` may keep frames over its own tables.
    """
    inner = uuid.uuid4().hex
    try:
        with scope(inner):
            df = build()
        return materialize(df)
    finally:
        release(inner)


def parts(batch: pa.RecordBatch, texts: pa.Array, size: int = PART_BYTES) -> Iterator[tuple[int, int]]:
    """``(start, stop)`` of runs of rows with ``size`` bytes of text, or one row more; a run has a row at least."""
    ends = np.cumsum(np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.float64)) + 64.0)
    start, done = 0, 0.0
    while start < batch.num_rows:
        stop = min(int(np.searchsorted(ends, done + size)) + 1, batch.num_rows)
        yield start, stop
        start, done = stop, ends[stop - 1]


def give_back() -> None:
    """Return memory that a worker has freed to the system, as workers wait for further tasks, and stages run side by side."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def map_texts(df: DataFrame, text: str, out: str, start: Callable[[], Callable[[list], list]], keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``df`` (all by default) and those of the DDL string ``out``, which the text decides row by row.

    ``start()`` is called once a task and gives a function from texts to Arrow arrays, one for every column of ``out``.
    Columns of ``df`` with names of ``out`` are replaced. Rows pass in Arrow batches that are cut by bytes of text and
    given back part by part, so a worker holds one batch and one part's results; nothing is shuffled.
    """
    added = T.StructType.fromDDL(out)
    names = [f.name for f in added]
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    own = text in kept
    src = df.select(*(F.col(f"`{c}`") for c in kept), *([] if own else [F.col(f"`{text}`").alias("_text_to_map")]))
    place, n_kept = (kept.index(text) if own else len(kept)), len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = start()
        for batch in batches:
            for a, b in parts(batch, batch.column(place)):
                some = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(some.column(i) for i in range(n_kept)), *turn(some.column(place).to_pylist())], names=kept + names)
        give_back()

    return src.mapInArrow(run, T.StructType([*(src.schema[c] for c in kept), *added]))


def fits(df: DataFrame, max_bytes: int | None = None) -> bool:
    """Whether the rows of ``df`` take ``max_bytes`` at most: its strings and binaries, and 16 bytes for every column."""
    size = F.lit(16 * len(df.columns)).cast("long")
    for f in df.schema:
        if isinstance(f.dataType, T.StringType | T.BinaryType):
            size = size + F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0))
        elif not isinstance(f.dataType, T.NumericType | T.BooleanType | T.DateType | T.TimestampType):
            raise TypeError(f"{f.name} has no size")
    return (df.agg(F.sum(size)).first()[0] or 0) <= (MAX_BROADCAST_BYTES if max_bytes is None else max_bytes)


def join_small(rows: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with a table that is small as a rule, by columns of equal names.

    If its bytes are checked to be few it is broadcast. Beyond that both sides are shuffled, and every key is dealt over
    ``SALTS`` tasks, so that a key of very many rows isn't one task's.
    """
    if fits(small):
        return rows.join(F.broadcast(small), on, how)
    others = [c for c in rows.columns if c not in on] or on
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*others), F.lit(SALTS)).cast("int"))
    spread = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread.hint("merge"), [*on, "_salt"], how).drop("_salt")


def with_filter(rows: DataFrame, keys: DataFrame, name: str, on: list[str]) -> DataFrame:
    """``rows`` with a boolean column ``name`` that is true where the columns ``on`` may occur in ``keys``, and for all that do.

    The hashes of ``keys`` are bits of a bitmap of ``FILTER_BITS``, 4 MB at every size of the input, which is broadcast.
    So few rows that have no partner go into a join by a shuffle, and those that the filter passes wrongly do no harm.
    """
    place = (F.lit(1) + F.pmod(F.xxhash64(*on), F.lit(FILTER_BITS))).cast("long")
    bits = keys.select(place.alias("_p")).groupBy(F.bitmap_bucket_number("_p").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias("_bits"))
    placed = rows.withColumn("_at", place).withColumn("_bucket", F.bitmap_bucket_number("_at")).withColumn("_at", F.bitmap_bit_position("_at"))
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = F.expr("cast(_at % 8 as int)")
    found = placed.join(F.broadcast(bits), "_bucket", "left").withColumn("_byte", byte).withColumn("_bit", hit)
    return found.withColumn(name, F.coalesce(F.expr("getbit(cast(_byte as long), _bit) = 1"), F.lit(False))).drop("_bucket", "_at", "_bits", "_byte", "_bit")


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string")) % folds


def class_sample(df: DataFrame, label: str, per_class: int, key: str, seed: int = 7) -> DataFrame:
    """At most ``per_class`` rows of each class of ``label``, chosen by a hash of ``key``.

    The bound holds for every input size. Counting is one aggregation; only the hash decides, so a rerun
    on the same rows picks the same sample.
    """
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, per_class / n))).otherwise(share)
    point = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    return df.where(point < share)


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Components of an undirected graph: ``edges(a, b)`` of longs to ``(node, component)``, the smallest node of each.

    Alternates large-star and small-star steps (Kiveris et al. 2014). Each step is a minimum per node, which is
    combined before the shuffle, and a join back, so a hub with very many links stays split over tasks. Nulls and
    self-links are ignored; only nodes with a link to another node are returned; an empty input gives no rows.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    # a is always the larger end
    e = materialize(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(max_rounds):
        if _settled(e):
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = materialize(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
    else:
        raise RuntimeError("connected components did not settle")
    # settled: every node points straight at the smallest of its component
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _settled(e: DataFrame) -> bool:
    """Whether every larger end has one link only and is nobody's smaller end."""
    ends = e.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    per_node = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return per_node.where("up > 1 or (up > 0 and down > 0)").isEmpty()
