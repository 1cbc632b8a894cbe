"""Embedding near-duplicates by collision counting on one-dimensional projections.

Unit vectors are projected on random orthogonal directions. Two vectors collide in a projection if one is in the
window of fixed half-width that is centred at the other (QALSH: Huang et al. 2015). Near vectors collide in almost
all projections; the number of collisions that a pair at the threshold reaches with the wanted recall is the bound
from which pairs are verified by their cosine in double precision.

A vector is filed in the cells of the directions that it projects on most strongly (Andoni et al. 2015), so that near
vectors share a cell, and a pair is judged in the first cell that it shares. Large cells are dealt into blocks, pairs
of blocks are tiles; a tile sorts as many projections as every pair that reaches the bound collides in at least once,
takes the union of their windows, and counts the collisions in the others. It returns its sums per vector and a forest
of its links, never its pairs. Equal vectors are one.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm import common

#: Projections, recall that their count is calibrated to, width of windows in standard deviations, vectors of a block.
PROJECTIONS, RECALL, WIDTH, BLOCK = 24, 0.999, 2.5, 1024
#: Vectors that a cell should have; strongest directions that a vector is filed under; rotations that cells may combine.
CELL, STRONGEST, ROTATIONS = 2048, 6, 2


def directions(dims: int, count: int, seed: int = 5) -> np.ndarray:
    """Orthonormal rows while there are dimensions left, then further sets of them."""
    rng, rows = np.random.default_rng(seed), []
    while sum(map(len, rows)) < count:
        q, r = np.linalg.qr(rng.standard_normal((dims, dims)))
        rows.append((q * np.sign(np.diag(r))).T)
    return np.concatenate(rows)[:count]


def half_width(cosine: float, dims: int, width: float = WIDTH) -> float:
    """``width`` standard deviations of the projected difference of two unit vectors with that cosine."""
    return width * math.sqrt(max(2.0 - 2.0 * cosine, 0.0) / dims)


def least_collisions(projections: int, width: float = WIDTH, recall: float = RECALL) -> int:
    """The largest count that a pair at the threshold reaches with probability ``recall``, if projections were independent normals."""
    p, tail = math.erf(width / math.sqrt(2)), 0.0
    for k in range(projections, -1, -1):
        tail += math.comb(projections, k) * p**k * (1 - p) ** (projections - k)
        if tail >= recall:
            return k
    return 0


def rotations(n: int, dims: int) -> int:
    """Rotations that cells of ``n`` vectors of a label and length combine; none if one cell holds them all."""
    # a cell of one rotation holds STRONGEST of the 2 * dims signed directions; another rotation divides it once more
    share = min(1.0, STRONGEST / (2 * dims))
    return min(ROTATIONS, math.ceil(math.log(n / CELL) / -math.log(share))) if n > CELL and share < 1 else 0


def unit_rows(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, and which rows are usable: not null, not zero, all components finite and not null."""
    dims = max((len(v) for v in vectors if v is not None), default=0)
    x = np.full((len(vectors), dims), np.nan)
    for i, v in enumerate(vectors):
        if v is not None and len(v) == dims:
            x[i] = np.asarray(v, dtype=np.float64)
    norm = np.sqrt((x * x).sum(axis=1)) if dims else np.zeros(len(vectors))
    good = np.isfinite(norm) & (norm > 0)
    x[good] /= norm[good][:, None]
    return x, good


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.98, projections: int = PROJECTIONS) -> DataFrame:
    """One row per row of ``vectors``: ``key, n_links, component_id, kept``.

    Rows link when their labels are equal and not null and the cosine of their vectors is ``cosine`` or more. ``n_links``
    counts the other rows that a row links with directly, ``component_id`` is the smallest key that links reach, and
    ``kept`` says that it is the own key. Vectors that are null, empty or zero, or hold null or non-finite components, and
    rows with a null label or key link with nothing; vectors of different lengths don't link. An empty table gives no
    rows. Keys are whole numbers. Links of equal vectors are exact; others are found with the recall of ``RECALL`` and the cells.
    """
    return common.condensed(lambda: _judged(vectors, key, vector, label, cosine, projections))


def _judged(vectors: DataFrame, key: str, vector: str, label: str, cosine: float, projections: int) -> DataFrame:
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).alias("label"))
    ok = F.col("label").isNotNull() & F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
    ok = ok & F.expr("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))") & F.expr("exists(v, x -> x <> 0)")
    marked = rows.withColumn("ok", F.coalesce(ok, F.lit(False)))
    usable = common.materialize(marked.where("ok").select("id", "v", "label"))
    # -0.0 and 0.0 are equal when rows are grouped
    classes = common.materialize(usable.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size")))
    degrees, forest = _links(classes, cosine, projections)
    comps = common.connected_components(forest)
    found = classes.join(degrees, "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    found = found.select("label", "v", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = usable.join(found, ["label", "v"]).select("id", "n_links", "component_id")
    alone = marked.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(key), F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _links(classes: DataFrame, cosine: float, projections: int) -> tuple[DataFrame, DataFrame]:
    """Links to other classes per class, weighted by their sizes, and a forest that connects what links."""
    large = classes.groupBy("label", F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL)
    classes = common.join_small(classes.withColumn("d", F.size("v")), large, ["label", "d"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    shared: dict = {}

    def project(batches):
        for batch in batches:
            out = []
            for (rep, size, label, n), v in zip(batch[["rep", "size", "label", "n"]].itertuples(index=False, name=None), batch["v"], strict=True):
                d = len(v)
                count = rotations(n, d)
                if (d, count) not in shared:
                    shared[d, count] = [directions(d, d, seed=50 + r) for r in range(count)]
                x = np.asarray(v, dtype=np.float64)
                x = x / np.max(np.abs(x))
                x = x / np.sqrt(x @ x)
                homes = [0]
                for turn in shared[d, count]:
                    q = turn @ x
                    top = np.argsort(-np.abs(q), kind="stable")[:STRONGEST]
                    homes = [h * 2 * d + int(2 * k + (q[k] > 0)) for h in homes for k in top]
                homes.sort()
                out += [(f"{label}/{d}", h, homes, rep, size, x) for h in homes]
            yield pd.DataFrame(out, columns=["space", "cell", "homes", "rep", "size", "x"])

    placed = common.materialize(classes.select("rep", "size", F.col("label").cast("string").alias("label"), "n", "v").mapInPandas(project, "space string, cell long, homes array<long>, rep long, size long, x array<double>"))
    sizes = placed.groupBy("space", "cell").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    blocks = F.ceil(F.col("c") / BLOCK)
    dealt = placed.join(sizes, ["space", "cell"]).withColumn("block", F.pmod(F.xxhash64("rep"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    tiles = dealt.withColumn("t1", F.least("block", "other")).withColumn("t2", F.greatest("block", "other")).drop("other", "c")
    tile = _tile(cosine, least_collisions(projections), projections)
    done = common.materialize(tiles.groupBy("space", "cell", "t1", "t2").applyInPandas(tile, "rep long, links long, root long"))
    return done.groupBy("rep").agg(F.sum("links").alias("links")), done.select(F.col("rep").alias("a"), F.col("root").alias("b"))


def _tile(cosine: float, bound: int, projections: int):
    # a pair with ``bound`` collisions has one in any so many projections
    gates = projections - bound + 1
    axes: dict = {}

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        cell, two = int(rows["cell"].iloc[0]), rows["t1"].iloc[0] != rows["t2"].iloc[0]
        x = np.stack(rows["x"].to_list())
        if x.shape[1] not in axes:
            axes[x.shape[1]] = directions(x.shape[1], projections)
        p = x @ axes[x.shape[1]].T
        width = half_width(cosine, x.shape[1])
        rep, size, block = (rows[c].to_numpy() for c in ("rep", "size", "block"))
        homes = np.stack(rows["homes"].to_list())
        links, root = np.zeros(len(rep), dtype=np.int64), np.arange(len(rep))
        # of two blocks, one queries the other
        asking = np.flatnonzero(block == rows["t1"].iloc[0]) if two else np.arange(len(rep))
        asked = np.flatnonzero(block != rows["t1"].iloc[0]) if two else np.arange(len(rep))
        windows = []
        for k in range(min(gates, p.shape[1])):
            order = asked[np.argsort(p[asked, k], kind="stable")]
            windows.append((order, np.searchsorted(p[order, k], p[:, k] - width), np.searchsorted(p[order, k], p[:, k] + width, side="right")))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i in asking.tolist():
            hits = np.zeros(len(rep), dtype=np.int64)
            for order, start, end in windows:
                hits[order[start[i] : end[i]]] += 1
            j = np.flatnonzero(hits) if bound else asked
            if not two:
                j = j[j > i]
            count = hits[j]
            for k in range(gates, p.shape[1], 4):  # pairs that can't reach the bound any more go early
                count = count + (np.abs(p[j, k : k + 4] - p[i, k : k + 4]) <= width).sum(axis=1)
                able = count + max(p.shape[1] - k - 4, 0) >= bound
                j, count = j[able], count[able]
            j = j[count >= bound]
            if len(j):
                j = j[x[j] @ x[i] >= cosine]
            if len(j) and homes.shape[1] > 1:  # the first cell that both are in has the pair
                both = (homes[j][:, :, None] == homes[i][None, None, :]).any(axis=2)
                j = j[np.where(both, homes[j], np.iinfo(np.int64).max).min(axis=1) == cell]
            if len(j):
                links[j] += size[i]
                links[i] += size[j].sum()
                mine = top(i)
                for k in j.tolist():
                    other = top(k)
                    if other != mine:
                        root[max(mine, other)] = min(mine, other)
                        mine = min(mine, other)
        at = np.flatnonzero(links)
        return pd.DataFrame({"rep": rep[at], "links": links[at], "root": rep[[top(i) for i in at.tolist()]] if len(at) else np.empty(0, dtype=np.int64)})

    return run
