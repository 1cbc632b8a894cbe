"""What depends on the order of rows: parents by indentation, neighbours, counters, order checks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from citeloom.operators.joins import few_bytes
from citeloom.operators.lineage import materialize

_NONE = object()


def parents_by_level(df: DataFrame, group: str, pos: str, level: str, key: str) -> DataFrame:
    """``parent_key``: the last earlier row of the group with a smaller level; any number of levels, groups of any length.

    Rows are sorted by ranges of group and place, so a long group lies in many parts. A part keeps the rows that are still
    open, one a level at most, on a stack, and gives back what is on it where its first and its last group end. These ends, a row a level and
    part, are put together in the order of parts; what a part lacks it takes from the stack of the parts before it.
    Rows without a level have no parent and are none. Null groups are one group; an empty table gives no rows.
    """
    names = df.columns
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in df.schema), T.StructField("_part", T.IntegerType()), T.StructField("parent_key", df.schema[key].dataType), T.StructField("_state", T.IntegerType())])
    at_group, at_level, at_key = (names.index(c) for c in (group, level, key))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, current, stack, kinds, first = TaskContext.get().partitionId(), _NONE, [], None, True

        def ends() -> pa.RecordBatch:
            held = {at_group: [current] * len(stack), at_level: [s[0] for s in stack], at_key: [s[1] for s in stack]}
            columns = [pa.array(held[i], t) if i in held else pa.nulls(len(stack), t) for i, t in enumerate(kinds)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([part] * len(stack), pa.int32()), pa.nulls(len(stack), kinds[at_key]), pa.array([2] * len(stack), pa.int32())], names=schema.names)

        for batch in batches:
            kinds = [f.type for f in batch.schema]
            parents, states = [], []
            for g, v, k in zip(*(batch.column(i).to_pylist() for i in (at_group, at_level, at_key)), strict=True):
                if g != current or current is _NONE:
                    if first and stack:
                        yield ends()
                    first = current is _NONE
                    current, stack = g, []
                if v is None:
                    parents.append(None)
                    states.append(0)
                    continue
                while stack and stack[-1][0] >= v:
                    stack.pop()
                parents.append(stack[-1][1] if stack else None)
                # only a part's first group can go on from the part before
                states.append(1 if first and not stack else 0)
                stack.append((v, k))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(parents), pa.int32()), pa.array(parents, kinds[at_key]), pa.array(states, pa.int32())], names=schema.names)
        if stack:
            yield ends()  # of the part's last group; those between it and the first one lie in this part as a whole

    held = materialize(df.orderBy(group, pos).mapInArrow(nearest, schema))
    g, v, k = (df.schema[c].dataType for c in (group, level, key))
    before_schema = T.StructType([T.StructField("_g", g), T.StructField("_part", T.IntegerType()), T.StructField("_v", v), T.StructField("_k", k)])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, stack, part, out = _NONE, [], None, []
        for batch in batches:
            out, kinds = [], [batch.schema.field(i).type for i in (0, 2, 3)]
            for g, p, v, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != current or current is _NONE:
                    current, stack, part = g, [], p
                elif p != part:
                    out += [(g, p, *s) for s in stack]
                    part = p
                while stack and stack[-1][0] >= v:
                    stack.pop()
                stack.append((v, k))
            types = (kinds[0], pa.int32(), kinds[1], kinds[2])
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=before_schema.names)

    stacks = held.where("_state = 2").select(F.col(group).alias("_g"), "_part", F.col(level).alias("_v"), F.col(key).alias("_k"))
    before = stacks.repartition("_g").sortWithinPartitions("_g", "_part", "_v").mapInArrow(joined, before_schema)
    open_rows = held.where("_state = 1").select(F.col(group).alias("_g"), "_part", F.col(level).alias("_level")).distinct()
    found = open_rows.alias("o").join(before.alias("b"), F.col("o._g").eqNullSafe(F.col("b._g")) & (F.col("o._part") == F.col("b._part"))).where("_v < _level")
    found = materialize(found.groupBy("o._g", "o._part", "_level").agg(F.max_by("_k", "_v").alias("_found")).select("_g", F.col("_part").alias("_p"), "_level", "_found"))
    rows = held.where("_state < 2")
    same = F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")) & (F.col(level) == F.col("_level")) & (F.col("_state") == 1)
    small = F.broadcast(found) if few_bytes(found) else found
    return rows.join(small, same, "left").select(*names, F.coalesce("parent_key", "_found").alias("parent_key"))


def neighbours(df: DataFrame, group: str, pos: str, key: str, radius: int = 5, prefix: Column | None = None) -> DataFrame:
    """Keys within ``radius`` rows, the own one included, in order; only those of the same prefix if one is given."""
    w = Window.partitionBy(group).orderBy(pos).rowsBetween(-radius, radius)
    mark = F.lit("") if prefix is None else prefix
    held = df.withColumn("_p", mark).withColumn("_w", F.collect_list(F.struct(F.col("_p").alias("p"), F.col(key).alias("k"))).over(w))
    return held.withColumn("neighbours", F.transform(F.filter("_w", lambda x: x["p"] == F.col("_p")), lambda x: x["k"])).drop("_p", "_w")


def numbered(df: DataFrame, group: str, pos: list[str], out: str = "number", first: int = 1) -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(group).orderBy(*pos)) + (first - 1))


def places(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """``out``: the place of every row, from 1, in the order of ``order`` over the whole table, without one task that sorts it all.

    Rows are sorted by ranges and written; each part numbers its own, and the sizes of the parts before, one row a part, are added.
    """
    sorted_rows = materialize(df.orderBy(*order).withColumn("_part", F.spark_partition_id()))
    sizes = sorted_rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return sorted_rows.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn(out, F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")


def out_of_order(df: DataFrame, group: str, pos: str, value: str) -> DataFrame:
    """Rows whose value is less than the row's before."""
    return df.withColumn("before", F.lag(value).over(Window.partitionBy(group).orderBy(pos))).where(F.col(value) < F.col("before"))


def same_start_as_before(df: DataFrame, group: str, pos: str, heading: str) -> DataFrame:
    """``merges``: the first two words of the heading are those of the row before, so both can be one."""
    start = F.lower(F.substring_index(F.col(heading), " ", 2))
    return df.withColumn("merges", F.coalesce(start == F.lag(start).over(Window.partitionBy(group).orderBy(pos)), F.lit(False)))


def sticky(df: DataFrame, group: str, pos: str, flag: Column, out: str) -> DataFrame:
    """True from the first row of the group on for which ``flag`` holds."""
    w = Window.partitionBy(group).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.max(F.coalesce(flag, F.lit(False))).over(w))


def best_per_key(df: DataFrame, key: str, score: str, tie: list[str], least: float) -> DataFrame:
    """The row of highest score per key, the first of ties, if it is above ``least``; an aggregation, so hot keys are combined early."""
    rest = [c for c in df.columns if c != key]
    order = F.struct(F.col(score), *(-F.col(t) for t in tie))
    return df.where(F.col(score) > least).groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_b")).select(key, "_b.*")
