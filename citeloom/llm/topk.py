"""Exact top-k search by inner product over an impact-ordered index, score at a time.

The index is dealt into shards of bounded size. A shard has, for every dimension, its rows filed by the quantised value
that they hold there: the rows of one dimension and one quantum are a posting segment. A query takes a shard's segments
by descending impact, the size of its own component times the segment's quantum, and adds the impact to the scores of
the rows filed there. What is still to come can add the next impact a dimension at most, so every row has a bound; the
search stops when the proof stands that only few rows can still be members, and those are scored exactly.

Queries are dealt into blocks, and a block meets every shard once; the best of all shards are the best of all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeloom.llm import common

#: Rows of a shard, and components that they have at most; quanta of a dimension on either side of zero; queries of a block.
SHARD, SHARD_VALUES, QUANTA, BLOCK = 16_384, 2_000_000, 32, 1_024
#: Rounds in which postings are taken, and the share of a shard's rows that may be left to be scored exactly.
ROUNDS, LEFT = 8, 1 / 16
#: Shards that pass to Python at once.
PASSED = 4
_INDEX = "shard long, n int, dims int, ids binary, no_id binary, rows binary, postings binary, dim binary, quantum binary, start binary, width long, asks binary"
_NO_ID = np.iinfo(np.int64).min


@dataclass
class Shard:
    """``rows`` of whole numbers; ``postings`` are row numbers by dimension and quantum; a segment ``s`` is ``postings[start[s] : start[s + 1]]``."""

    ids: np.ndarray
    no_id: np.ndarray
    rows: np.ndarray
    postings: np.ndarray
    dim: np.ndarray
    quantum: np.ndarray
    start: np.ndarray
    width: int

    @classmethod
    def of(cls, ids: np.ndarray, no_id: np.ndarray, rows: np.ndarray) -> Shard:
        n, dims = rows.shape
        width = max(1, math.ceil(int(np.abs(rows).max(initial=0)) / QUANTA))
        quanta = rows // width
        order = np.argsort(quanta, axis=0, kind="stable").T  # by dimension, then quantum
        sorted_quanta = np.take_along_axis(quanta, order.T, axis=0).T
        new = np.ones((dims, n), dtype=bool)
        new[:, 1:] = sorted_quanta[:, 1:] != sorted_quanta[:, :-1]
        start = np.flatnonzero(new)
        return cls(ids, no_id, rows, order.astype(np.uint16).ravel(), (start // n).astype(np.int32), sorted_quanta.ravel()[start].astype(np.int64), np.append(start, n * dims).astype(np.int64), width)

    def best(self, query: np.ndarray, own: int, k: int) -> np.ndarray:
        """Numbers of rows that hold the ``k`` highest scores with ``query``, all that tie with the last one included; never row ``own`` (-1: none)."""
        n, dims = self.rows.shape
        size = np.abs(query).astype(np.float64)
        impact = query[self.dim] * ((self.quantum + 0.5) * self.width - 0.5)
        order = np.argsort(-np.abs(impact), kind="stable")
        order = order[query[self.dim[order]] != 0]
        lengths = (self.start[1:] - self.start[:-1])[order]
        taken = np.concatenate(([0], np.cumsum(lengths)))
        score, seen = np.zeros(n), np.zeros(n)
        # a posting's score is its segment's up to half a quantum; rounding of doubles is far below a billionth
        slack = size.sum() * self.width / 2 + 1e-9 * float(size @ np.abs(self.rows).max(axis=0, initial=0).astype(np.float64))
        active, least, at = int((query != 0).sum()), -math.inf, 0
        while True:
            to = len(order) if taken[-1] == 0 else int(np.searchsorted(taken, taken[at] + taken[-1] / ROUNDS))
            to = min(max(to, at + 1), len(order))
            if to > at:
                some = order[at:to]
                counts = lengths[at:to]
                places = np.repeat(self.start[some] - taken[at:to] + taken[at], counts) + np.arange(taken[to] - taken[at])
                rows = self.postings[places]
                score += np.bincount(rows, np.repeat(impact[some], counts), minlength=n)
                seen += np.bincount(rows, minlength=n)
                at = to
            rest = abs(impact[order[at]]) if at < len(order) else 0.0
            if own >= 0:
                score[own] = -math.inf
            # the exact scores of the best so far bound the k-th highest one from below
            front = np.argpartition(-score, min(4 * k, n) - 1)[: 4 * k]
            front = front[front != own]
            if len(front) >= k:
                least = max(least, float(np.partition(self.rows[front] @ query, len(front) - k)[len(front) - k]))
            may = np.flatnonzero(score + slack + (active - seen) * rest >= least)
            if at == len(order) or len(may) <= LEFT * n:
                break
        may = may[may != own]
        exact = self.rows[may] @ query
        if len(may) > k:
            may = may[exact >= np.partition(exact, len(may) - k)[len(may) - k]]
        return may


def _packed(s: Shard, number: int, asks: np.ndarray) -> pa.RecordBatch:
    n, dims = s.rows.shape
    values = [number, n, dims, *(x.tobytes() for x in (s.ids, s.no_id, s.rows, s.postings, s.dim, s.quantum, s.start)), s.width, asks.astype(np.int32).tobytes()]
    types = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 7, pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=_INDEX.replace(",", "").split()[::2])


def _unpacked(r: dict) -> Shard:
    read = lambda c, t: np.frombuffer(r[c], dtype=t)
    return Shard(read("ids", np.int64), read("no_id", bool), read("rows", np.int64).reshape(r["n"], r["dims"]), read("postings", np.uint16), read("dim", np.int32), read("quantum", np.int64), read("start", np.int64), r["width"])


def build_index(df: DataFrame, key: str, vector: str, asks: Column, scale: float = 1024.0) -> DataFrame:
    """The shards of an index over ``floor(scale * x)`` of the components of the array column ``vector``; written, since it is read by every search.

    Rows where the boolean column ``asks`` holds are marked as queries. ``key`` is a whole number and may be null.
    Vectors that are null, or hold a null or a component that isn't finite, are left out. Missing components of shorter
    vectors count as zero, so an empty vector scores 0 with all. Components beyond the bound up to which no score
    leaves 64 bits (the root of 2^63 over the largest length, after scaling) are set to it. An empty table has no shards.
    """
    fine = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.where(F.coalesce(fine, F.lit(False))).select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("v"), F.coalesce(asks, F.lit(False)).alias("asks"))
    n, dims = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    dims = max(dims or 0, 1)
    bound = math.isqrt((1 << 63) // dims) - 1
    size = max(1, min(SHARD, SHARD_VALUES // dims))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, some, held = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            while batch.num_rows:
                some.append(batch.slice(0, size - held))
                held += some[-1].num_rows
                batch = batch.slice(some[-1].num_rows)
                if held == size:
                    yield made(some, number)
                    number, some, held = number + 1, [], 0
        if held:
            yield made(some, number)

    def made(some: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        t = pa.Table.from_batches(some).combine_chunks()
        ids, lists, asked = (c.combine_chunks() for c in t.columns)
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
        values = np.clip(lists.flatten().to_numpy(zero_copy_only=False), -bound, bound)
        full = np.zeros((t.num_rows, dims), dtype=np.int64)
        full[np.arange(dims) < lengths[:, None]] = values
        return _packed(Shard.of(ids.fill_null(_NO_ID).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), full), number, np.flatnonzero(asked.to_numpy(zero_copy_only=False)))

    return common.materialize(rows.repartition(max(1, math.ceil(n / size))).mapInArrow(run, _INDEX))


def _blocks(index: DataFrame) -> tuple[DataFrame, int]:
    """``(block, queries)`` rows of ``BLOCK`` queries or so, and how many: each query's id, shard, row and components as whole numbers of 64 bits."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, rows = np.frombuffer(r["ids"], dtype=np.int64), np.frombuffer(r["rows"], dtype=np.int64).reshape(r["n"], r["dims"])
                out = [np.concatenate(([ids[i], r["shard"], i], rows[i])).tobytes() for i in np.frombuffer(r["asks"], dtype=np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["q"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, some = TaskContext.get().partitionId(), [q for b in batches for q in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([b"".join(some)], pa.binary())], names=["block", "queries"])

    total = index.agg(F.sum(F.octet_length("asks")) / 4).first()[0] or 0
    count = max(1, math.ceil(total / BLOCK))
    queries = index.select("shard", "n", "dims", "ids", "rows", "asks").mapInArrow(spread, "q binary")
    return common.materialize(queries.repartition(count).mapInArrow(gather, "block long, queries binary"), PASSED), count


def search(index: DataFrame, k: int) -> DataFrame:
    """``(query_id, rank, id, score)``: for every marked row of the index the ``k`` other rows of highest inner product, all if there are fewer.

    Ties go to the smaller id, rows without id come last among them. A row never answers itself, but rows that repeat it
    do, and repeated queries are answered each. Exact: no row that can be a member is left out.

    A task holds a shard and a block. Blocks are broadcast while their checked bytes are few; beyond that both sides
    are shuffled. A query gets ``k`` rows from every shard, of which ``k`` are left before the last shuffle and after it.
    """
    blocks, count = _blocks(index)
    pairs = common.join_small(index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))), blocks, ["block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                shard, out = _unpacked(r), []
                for q in np.frombuffer(r["queries"], dtype=np.int64).reshape(-1, 3 + r["dims"]):
                    rows = shard.best(q[3:], int(q[2]) if q[1] == r["shard"] else -1, k)
                    scores = shard.rows[rows] @ q[3:]
                    first = np.lexsort((shard.ids[rows], shard.no_id[rows], -scores))[:k]
                    out.append((np.full(len(first), q[0]), np.full(len(first), q[1]), np.full(len(first), q[2]), rows[first], scores[first]))
                ids, at, row, rows, scores = (np.concatenate(c) for c in zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 5
                found = pa.array(shard.ids[rows], mask=shard.no_id[rows])
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (ids, at, row)), found, pa.array(scores, pa.int64())], names=["query_id", "at", "row", "id", "score"])

    found = pairs.mapInArrow(run, "query_id long, at long, row long, id long, score long")
    order = Window.partitionBy("query_id", "at", "row").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return common.materialize(ranked.select("query_id", "rank", "id", "score"), PASSED)


def top_k(df: DataFrame, key: str, vector: str, asks: Column, k: int, scale: float = 1024.0) -> DataFrame:
    """``search`` over ``build_index``, written; the index goes when the result is there."""
    return common.condensed(lambda: search(build_index(df, key, vector, asks, scale), k))
