"""Operators that scan long groups in parts, against plain loops: as-of joins, parents by level, ancestors."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.operators import graph, ordered, temporal


@pytest.mark.parametrize("hot", [10, 10**9])
def test_as_of_with_a_hot_key(spark, hot):
    rnd = random.Random(4)
    key = lambda: rnd.choice(["h"] * 18 + ["a", None])
    left = [(i, key(), rnd.choice([None, *range(100)])) for i in range(400)]
    right = [(key(), rnd.choice([None, *range(0, 100, 3)]), rnd.choice([None, 1, 2, 3])) for _ in range(120)]
    one = spark.createDataFrame(left, "id long, k string, t int").repartition(4)
    two = spark.createDataFrame(right, "k string, since int, v int").repartition(4)
    found = {r["id"]: (r["since"], r["v"]) for r in temporal.as_of(one, two, "k", "t", "since", ["since", "v"], hot_rows=hot).collect()}
    for i, k, t in left:
        fits = [(s, v is not None, v or 0, v) for q, s, v in right if q == k and k is not None and s is not None and t is not None and s <= t]
        assert found[i] == ((max(fits)[0], max(fits)[3]) if fits else (None, None)), (i, k, t)
    assert len(found) == 400


def test_a_hot_key_is_split(spark):
    rows = spark.range(4000).select(F.lit("h").alias("_k"), F.col("id").alias("_t"), F.lit(1).alias("_side"), F.struct("id").alias("_row"), F.when(F.col("id") % 500 == 0, F.struct("id")).alias("_v"))
    out = temporal._last_by_parts(rows, ["_t", "_side", "_v"])
    sizes = [r[0] for r in out.groupBy("_part").count().select("count").collect()]
    assert len(sizes) > 1 and max(sizes) < 4000
    assert all(r["_last"]["id"] == r["_t"] // 500 * 500 for r in out.select("_t", "_last").collect())


def parents(rows):
    out, stacks = {}, {}
    for g, _, v, k in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        stack = stacks.setdefault(g, [])
        if v is None:
            out[k] = None
            continue
        while stack and stack[-1][0] >= v:
            stack.pop()
        out[k] = stack[-1][1] if stack else None
        stack.append((v, k))
    return out


def test_parents_by_level_across_parts(spark):
    # groups of some hundred rows, so that many begin in one part and end in the next
    rnd = random.Random(12)
    rows = [(f"g{i // 150:02d}", i, rnd.choice([1, 2, 3, 4]) if i % 150 else 0, f"k{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, pos int, level int, key string").repartition(5)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else small parts are put together
    try:
        found = {r["key"]: r["parent_key"] for r in ordered.parents_by_level(df, "g", "pos", "level", "key").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert found == parents(rows)


@pytest.mark.parametrize("levels", [1, 4, 200])
def test_parents_by_level_of_long_groups(spark, levels):
    rnd = random.Random(levels)
    rows, level = [], 0
    for i in range(3000):
        level = min(max(level + rnd.choice([-3, -1, 0, 1, 1, 1]), 0), levels - 1)
        rows.append((rnd.choice(["long"] * 9 + ["b", "z", "z", None]), i, None if rnd.random() < 0.02 else level, f"k{i}"))
    df = spark.createDataFrame(rows, "g string, pos int, level int, key string").repartition(4)
    df = spark.createDataFrame(df.rdd, T.StructType([T.StructField(f.name, f.dataType, f.name in ("g", "level")) for f in df.schema]))
    found = {r["key"]: r["parent_key"] for r in ordered.parents_by_level(df, "g", "pos", "level", "key").collect()}
    assert found == parents(rows)
    assert ordered.parents_by_level(df.where("false"), "g", "pos", "level", "key").collect() == []


def test_ancestors_of_a_chain(spark, monkeypatch):
    made, plain = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df: made.append(1) or plain(df))
    n = 1000
    nodes = spark.createDataFrame([(f"k{i}", f"k{i - 1}" if i else "") for i in range(n)], "key string, parent_key string")
    closure = graph.ancestors(nodes)
    assert closure.count() == n * (n + 1) // 2
    assert closure.where("distance <> cast(substring(key, 2) as int) - cast(substring(ancestor, 2) as int)").isEmpty()
    assert len(made) <= 1 + 2 * 12


def test_ancestors_beyond_the_list_and_cycles(spark):
    nodes = spark.createDataFrame([("a", "outside"), ("b", "a"), ("c", None)], "key string, parent_key string")
    assert sorted(map(tuple, graph.ancestors(nodes).collect())) == [("a", "a", 0), ("a", "outside", 1), ("b", "a", 1), ("b", "b", 0), ("b", "outside", 2), ("c", "c", 0)]
    with pytest.raises(ValueError, match="own ancestor"):
        graph.ancestors(spark.createDataFrame([("a", "c"), ("b", "a"), ("c", "b")], "key string, parent_key string"))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1040)] + [(5000, 5000)]
    found = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(1000, 1040), 1000)}


def test_quotient_moves_ends_to_units(spark):
    edges = spark.createDataFrame([("a1", "b1", "r"), ("a1", "b1", "r"), ("a1", "a2", "r"), ("a1", "A", "r"), ("x", "x", "r"), ("x", "b2", "r"), (None, "b1", "r"), ("y", None, "r")], "u string, v string, edge_type string")
    units = spark.createDataFrame([("a1", "A"), ("a2", "A"), ("b1", "B"), ("b2", "B"), ("y", None), (None, "Z")], "key string, unit string")
    found = sorted(map(tuple, graph.quotient(edges, units).select("u", "v").collect()), key=repr)
    assert found == sorted([("A", "B"), ("A", "B"), ("x", "x"), ("x", "B"), (None, "B"), ("y", None)], key=repr)
    assert graph.quotient(edges.where("false"), units).count() == 0 and graph.quotient(edges, units.where("false")).count() == 8
