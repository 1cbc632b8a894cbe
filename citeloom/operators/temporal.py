"""Versions and dates: validity intervals, the latest before a date, gaps that are filled."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeloom.operators.lineage import materialize

#: Rows of a key that one task sorts.
HOT_ROWS = 1_000_000


def valid_at(dates: DataFrame, versions: DataFrame, at: str, begin: str, end: str, bucket: Column | None = None, bucket_of=None) -> DataFrame:
    """``dates`` with the versions whose interval, both ends included, holds them.

    Without buckets the range condition makes a nested loop, right for a few dates. With ``bucket_of`` (a function
    from a date column to a whole number that grows with it) intervals are spread over the buckets they touch and
    the join is one on equal buckets, with the range checked beside it.
    """
    inside = (F.col(begin) <= F.col(at)) & (F.col(end) >= F.col(at))
    if bucket_of is None:
        return dates.join(versions, inside)
    spread = versions.withColumn("_b", F.explode(F.sequence(bucket_of(F.col(begin)), bucket_of(F.col(end)))))
    return dates.withColumn("_b", bucket_of(F.col(at))).join(spread, "_b").where(inside).drop("_b")


def several_versions(chosen: DataFrame, at: str, law: str) -> DataFrame:
    """What breaks the rule of one version per law and date."""
    return chosen.groupBy(at, law).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, since: str, value: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every row of ``left`` with ``value`` of the latest row of ``right`` at or before it, per key; null if there is none.

    One shuffle by key and one sort: both sides are united, and the last value seen is carried forward. Of rows of
    ``right`` at the same time the largest value counts. Keys of more than ``hot_rows`` rows are split over tasks: they are
    sorted by ranges of key and time, every part carries its own values forward, and what a part's first rows lack is the last
    value of the parts before it. Rows with a null key or time find nothing.
    """
    cols = left.columns
    a = left.select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(1).alias("_side"), F.struct(*cols).alias("_row"), F.lit(None).cast(right.select(F.struct(*value)).schema[0].dataType).alias("_v"))
    b = right.where(F.col(key).isNotNull() & F.col(since).isNotNull()).select(F.col(key).alias("_k"), F.col(since).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*cols)).schema[0].dataType).alias("_row"), F.struct(*value).alias("_v"))
    both = a.unionByName(b)
    order = ["_t", "_side", "_v"]
    hot = materialize(both.where("_k is not null").groupBy("_k").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows).select("_k"))
    seen = Window.partitionBy("_k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    parts = [both.join(F.broadcast(hot), "_k", "left_anti").withColumn("_last", F.last("_v", ignorenulls=True).over(seen))]
    if hot.take(1):  # these are as many as the rows over hot_rows at most
        parts.append(_last_by_parts(both.join(F.broadcast(hot), "_k", "left_semi"), order))
    out = functools.reduce(DataFrame.unionByName, (p.where("_side = 1").select("_row", "_last") for p in parts))
    return out.select("_row.*", *(F.col("_last")[c].alias(c) for c in value))


def _last_by_parts(rows: DataFrame, order: list[str]) -> DataFrame:
    """``_last``, the last ``_v`` of the key up to each row, by ranges of the sorted rows; no key is gathered, only one row a key and part is."""
    held = materialize(rows.orderBy("_k", *order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part", "_k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ends = held.groupBy("_part", "_k").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_end"))
    before = Window.partitionBy("_k").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_carry", F.last("_end", ignorenulls=True).over(before)).select("_part", "_k", "_carry")
    own = held.withColumn("_own", F.last("_v", ignorenulls=True).over(inside))
    return own.join(carried, ["_part", "_k"]).withColumn("_last", F.coalesce("_own", "_carry"))


def missing_strictly(latest: DataFrame, at: str, value: str) -> DataFrame:
    """Rows without any earlier value, which callers treat as errors."""
    return latest.where(F.col(value).isNull())


def carry_forward(df: DataFrame, keys: list[str], year: str) -> DataFrame:
    """Years between a key's first and last that are missing: ``keys, to_year, from_year``, the last year that exists before."""
    have = df.select(*keys, F.col(year).cast("int").alias("y")).distinct()
    spine = have.groupBy(*keys).agg(F.min("y").alias("lo"), F.max("y").alias("hi")).select(*keys, F.explode(F.sequence("lo", "hi")).alias("to_year"))
    filled = spine.join(have.withColumn("to_year", F.col("y")), [*keys, "to_year"], "left")
    back = Window.partitionBy(*keys).orderBy("to_year").rowsBetween(Window.unboundedPreceding, 0)
    return filled.withColumn("from_year", F.last("y", ignorenulls=True).over(back)).where("y is null").select(*keys, "to_year", "from_year")


def snapshot_pairs(snapshots: DataFrame, column: str, interval: int = 1) -> DataFrame:
    """Every snapshot with the one ``interval`` later. Snapshots are few (years), so one task orders them."""
    return snapshots.select(column).distinct().withColumn("next", F.lead(column, interval).over(Window.orderBy(column))).where("next is not null")


def names_by_date(laws: DataFrame, name: str = "citename", citekey: str = "citekey", begin: str = "start", end: str = "end", order: str = "filename") -> DataFrame:
    """``(date, name, citekey)`` for every date on which a law starts: the names of laws in force, the last of equals."""
    dates = laws.select(F.col(begin).alias("date")).distinct()
    held = valid_at(dates, laws, "date", begin, end)
    return held.groupBy("date", name).agg(F.max_by(citekey, F.struct(order, citekey)).alias(citekey))
