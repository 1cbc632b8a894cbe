"""Every registered query of the reference's operators against its SQL, and properties of the alignment."""

import random

import duckdb
import pytest

from citeloom.functions import similarity
from citeloom.operators import alignment
from citeloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    clean = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(clean(r[k]) for k in order) for r in found), key=repr)


@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_query(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found, want = registry.QUERIES[name](spark, sf), con.sql(registry.ORACLES[name])
    assert sorted(found.columns) == sorted(want.columns)
    assert rows(found.columns, found.collect()) == rows(want.columns, want.fetchall())


def test_containment_of_random_texts(spark):
    rnd = random.Random(8)
    text = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz        ") for _ in range(rnd.randint(100, 400)))
    a, b, c = ([text() for _ in range(15)] for _ in range(3))
    one = [x for x in a for _ in range(3)] + b + ["prefix literal text one", "two of them"]
    two = [x for x in c for _ in range(3)] + b + ["literal text", "and two of them here"]
    frame = lambda ts: spark.createDataFrame([(str(i), t) for i, t in enumerate(ts)], "key string, text string")
    found = {tuple(r) for r in alignment.contained(frame(two), frame(one), 1).collect()}
    want = {(str(j), str(i)) for j, n in enumerate(two) for i, h in enumerate(one) if n in h and (n.split(" ")[1:-1] == [] or set(n.split(" ")[1:-1]) <= set(h.split(" ")))}
    assert found == want


def test_alignment_is_one_to_one(spark):
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    text = lambda: " ".join(rnd.choice(words) for _ in range(20))
    old = [text() for _ in range(40)]
    new = [t if i % 4 else t.replace("w1", "v1", 1) for i, t in enumerate(old)]
    new[5] = "prefix " + old[5] + " and more"
    frame = lambda ts: spark.createDataFrame([(i, f"l{i % 1}_{i:03d}", f"k_{i}", t) for i, t in enumerate(ts)], "pos long, key string, citekey string, text string")
    found = alignment.align(frame(old), frame(new)).collect()
    assert len({r["key1"] for r in found}) == len({r["key2"] for r in found}) == len(found)
    assert {r["key1"] for r in found} == {r["key2"] for r in found} == {f"l0_{i:03d}" for i in range(40)}
    assert all(r["key1"] == r["key2"] for r in found)
    assert {r["stage"] for r in found} >= {"text", "neighbours"}
    same = alignment.align(frame(old), frame(old)).collect()
    assert {(r["key1"], r["key2"]) for r in same} == {(f"l0_{i:03d}",) * 2 for i in range(40)}


def test_alignment_of_long_runs(spark):
    rnd = random.Random(3)
    n, words = 56, [f"{rnd.randrange(36**6):x}" for _ in range(400)]
    old = [" ".join(rnd.choice(words) for _ in range(20)) for _ in range(n)]
    new = [old[0]] + [t + " changed" for t in old[1:]]
    frame = lambda ts: spark.createDataFrame([(i, f"l_{i:03d}", "", t) for i, t in enumerate(ts)], "pos long, key string, citekey string, text string")
    anchor = spark.createDataFrame([("l_000", "l_000", "text")], alignment.MAPPING)
    found = alignment.by_neighbours(frame(old), frame(new), anchor, radius=1).collect()
    assert sorted((r["key1"], r["key2"], r["stage"]) for r in found) == [(f"l_{i:03d}",) * 2 + ("neighbours",) for i in range(1, n)]


def test_alignment_of_unequal_lengths(spark):
    long = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(40))
    short = long[: len(long) * 3 // 10]
    for a, b in ((long, short), ("abcd" + "x" * 6, "abcd"), ("a" * 100, "a" * 33), ("a" * 9, "a")):
        sim = similarity.jaro_winkler(a, b)
        assert similarity.least_length_ratio(sim) <= len(b) / len(a)
    assert similarity.least_length_ratio(0.9) == pytest.approx(0.5)
    frame = lambda t: spark.createDataFrame([(0, "l_0", "", "same"), (1, "l_1", "", t)], "pos long, key string, citekey string, text string")
    anchor = spark.createDataFrame([("l_0", "l_0", "text")], alignment.MAPPING)
    assert [tuple(r) for r in alignment.by_neighbours(frame(long), frame(short), anchor, threshold=0.8).collect()] == [("l_1", "l_1", "neighbours")]


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
