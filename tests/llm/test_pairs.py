"""Operators on pairs against SQL or brute force, with copies, ties, nulls, empty and long texts and empty tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.llm import common, decontaminate, linededup, neardup, ngramjoin
from citeloom.llm.queries import QUERIES
from citeloom.llm.sql import ORACLES

WORDS = [f"w{i}" for i in range(60)] + ["É", "é", "THE", "the", "don't", "a-b"]


def text(rnd, n, sep=" "):
    return sep.join(rnd.choice(WORDS) for _ in range(n))


def corpus(seed=1, n=60):
    rnd = random.Random(seed)
    base = [text(rnd, rnd.choice([1, 3, 5, 12, 40, 120])) for _ in range(n)]
    out = [(i, t) for i, t in enumerate(base)]
    for i in range(n, n + 40):  # copies that are changed a little, some not at all
        words = rnd.choice(base).split(" ")
        for _ in range(rnd.choice([0, 0, 1, 2, 6])):
            words[rnd.randrange(len(words))] = rnd.choice(WORDS)
        out.append((i, " ".join(words)))
    return out + [(900, None), (901, ""), (902, "   \n\t "), (903, text(rnd, 30_000)), (904, "x"), (905, "X")]


@pytest.mark.parametrize("seed", [1])
def test_ngram_join(compare, documents, tmp_path, seed):
    compare(QUERIES["op7_ngram_join"], {"documents": documents(corpus(seed))}, tmp_path, ORACLES["op7_ngram_join"])


def test_ngram_join_chain_and_tiles(spark, monkeypatch):
    # a chain of texts of which only neighbours link, so that stars don't connect it and tiles are needed
    monkeypatch.setattr(ngramjoin, "STARS", 1)
    monkeypatch.setattr(ngramjoin, "BLOCK", 4)
    words = [f"u{i}" for i in range(200)]
    docs = [(i, " ".join(words[4 * i : 4 * i + 60])) for i in range(20)]
    found = {r[0]: r[2] for r in ngramjoin.similar_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    sets = [set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for _, t in docs]
    root = list(range(20))
    for _ in range(20):
        for i in range(20):
            for j in range(20):
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    assert found == dict(enumerate(root))
    assert len(set(root)) < 20


def test_ngram_join_empty_and_null_keys(spark):
    assert ngramjoin.similar_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = spark.createDataFrame([(None, "a b c d e f"), (3, "A b c d e f"), (3, "A b c d e f"), (None, None)], "doc_id long, text string")
    found = sorted(map(str, map(tuple, ngramjoin.similar_groups(rows).collect())))
    assert found == sorted(["(None, 2, 3)", "(3, 2, 3)", "(3, 2, 3)", "(None, 0, None)"])


def test_ngram_bounds():
    for n in range(1, 300):
        for m in range(n, 400):
            o = ngramjoin.least_overlap(n, m)
            assert 100 * o >= 80 * (n + m - o) and 100 * (o - 1) < 80 * (n + m - o + 1)
    h = np.unique(np.random.default_rng(1).integers(0, 2**64, 500, dtype=np.uint64) & ngramjoin._HIGH)
    assert (ngramjoin.unpacked(ngramjoin.packed(h)) == h).all()
    a, b = h[:300], h[100:]
    bits = ngramjoin.folded([ngramjoin.bitmap(a), ngramjoin.bitmap(b)])
    assert (len(a) + len(b) - int(np.bitwise_count(bits[0] ^ bits[1]).sum())) // 2 >= ngramjoin.overlap(ngramjoin.packed(a), ngramjoin.packed(b)) == 200 - (500 - len(h))


def test_keep_one(spark):
    rows = [(1, "a b c d e f g", "k"), (2, "a b c d e f g", "k"), (None, "a b c d e f g", "k"), (4, None, "k")]
    left = ngramjoin.keep_one_per_group(spark.createDataFrame(rows, "doc_id long, text string, _gone string"))
    assert sorted(r[0] or 0 for r in left.collect()) == [0, 1, 4]


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 560)]
    root = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    found = {r[0]: r[1] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found.get(x, x) == root[x] for x in root)
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("seed", [1])
def test_decontaminate(compare, documents, spark, tmp_path, seed):
    rnd = random.Random(seed)
    docs, items = corpus(seed), []
    for i in range(12):  # items taken from documents, some short, some twice, some not there
        words = rnd.choice([d[1] for d in docs[:60] if len(d[1]) > 60] + [text(rnd, 30)]).split(" ")
        at = rnd.randrange(max(1, len(words) - 14))
        items.append((i, " ".join(words[at : at + rnd.choice([1, 4, 10, 14])]).upper() if i % 3 else " ".join(words)))
    items += [(50, items[0][1]), (51, None), (52, " . ! "), (53, "nowhere to be found at all " * 3), (54, "w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1")]
    docs += [(60 + 900, "w1 " * 30), (961, "É a-b é")]
    tables = {"documents": documents(docs), "benchmark": spark.createDataFrame(items, "item_id long, text string")}
    compare(QUERIES["op6_decontaminate"], tables, tmp_path, ORACLES["op6_decontaminate"])


def test_decontaminate_edges(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k", "x"), (1, "a b c d e f g h i j k", "x"), (2, "b c", "x"), (None, "a b c d e f g h i j", "x"), (3, None, "x")], "doc_id long, text string, item string")
    bench = spark.createDataFrame([("q", "A B C D E F G H I J")], "item_id string, text string")
    found = sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"], r["items"], r["spans"]) for r in decontaminate.contamination(docs, bench).collect())
    assert [f[:4] for f in found] == [(0, 10, 10, ["q"]), (1, 11, 10, ["q"]), (1, 11, 10, ["q"]), (2, 2, 0, []), (3, 0, 0, [])]
    assert [tuple(s) for s in found[1][4]] == [(0, 10)]
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and sorted(r[0] for r in left.collect()) == [2, 3]
    nothing = bench.where("false")
    assert decontaminate.drop_contaminated(docs, nothing).count() == 5
    assert decontaminate.contamination(docs.where("false"), bench).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a b c x d e f g h i j")], "doc_id long, text string")
    bench = spark.createDataFrame([("q", "a b c d e f g h i j")], "item_id string, text string")
    src = decontaminate._source(docs, "doc_id", "text")
    post, places = decontaminate._index(src, decontaminate.benchmark_texts(bench, "item_id", "text")[0])
    assert decontaminate.phrase_matches(post, places).count() == 0
    assert decontaminate.proximity_matches(post, places, slop=3).count() == 1


LINES = ["short", "a line of five words", "", "  ", "x " * 30 + "end", "y " * 55, "z " * 49 + "z", "tail of it"]


@pytest.mark.parametrize("seed", [1])
def test_line_dedup(compare, documents, tmp_path, seed):
    rnd = random.Random(seed)
    lines = LINES + [text(rnd, rnd.choice([1, 5, 20, 45])) for _ in range(12)]
    docs = [(i, "\n".join(rnd.choice(lines) for _ in range(rnd.choice([1, 2, 6, 20, 90])))) for i in range(40)]
    docs += [(900, None), (901, ""), (902, "\n\n"), (903, "w\n" * 300), (904, "w\n" * 300 + "v"), (905, docs[3][1])]
    compare(QUERIES["op9_line_dedup"], {"documents": documents(docs)}, tmp_path, ORACLES["op9_line_dedup"])


def test_line_dedup_edges(spark):
    long = "word " * 60
    rows = [(None, long, 7), (2, long, 7), (2, long, 7), (3, "a\n" + long + "\nb", 7), (4, None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines long")
    found = sorted((r["doc_id"] or 0, r["text"] or "", r["n_lines"], r["n_cut"]) for r in linededup.dedup_lines(df).collect())
    # the smallest key keeps the run; rows with equal key and text are one document; a null key comes last
    assert found == [(0, "", 1, 1), (2, long, 1, 0), (2, long, 1, 0), (3, "a\nb", 3, 1), (4, "", 0, 0)]
    assert linededup.dedup_lines(df.where("false")).count() == 0


def vectors(seed, n=300, dims=16):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims))
    for i in range(n // 2, n):  # near ones, at about the threshold
        x[i] = x[rng.integers(0, n // 2)] + rng.standard_normal(dims) * rng.choice([0, 0.05, 0.15, 0.2])
    rows = [(i, [float(np.float32(v)) for v in x[i]], int(i % 3) if i % 50 else None) for i in range(n)]
    return rows + [(n, None, 1), (n + 1, [0.0] * dims, 1), (n + 2, [float("nan")] * dims, 1), (n + 3, [None] * dims, 1), (n + 4, [float("inf")] + [1.0] * (dims - 1), 1), (n + 5, [], 1)]


@pytest.mark.parametrize("cell", [2048, 16])
def test_embeddings(compare, spark, tmp_path, monkeypatch, cell):
    monkeypatch.setattr(neardup, "CELL", cell)
    monkeypatch.setattr(neardup, "BLOCK", 32)
    rows = vectors(4)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    if cell == 2048:
        compare(QUERIES["op8_embedding_neardup"], {"embeddings": df}, tmp_path, ORACLES["op8_embedding_neardup"])
        return
    # cells of strongest directions: recall against brute force
    found = {r[0]: r[1] for r in neardup.near_duplicates(df).collect()}
    good = [(i, np.array(v) / np.linalg.norm(v), label) for i, v, label in rows[:300] if label is not None]
    want = {i: sum(j != i and k == m and v @ w >= 0.98 for j, w, m in good) for i, v, k in good}
    assert sum(found[i] for i in want) >= 0.9 * sum(want.values())
    assert all(found[i] <= want[i] for i in want)


def test_embeddings_empty(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert neardup.near_duplicates(spark.createDataFrame([(1, [1.0, 2.0], 5), (2, [2.0, 4.0], 5), (3, [1.0, 2.0], None)], "vec_id long, embedding array<double>, label int").withColumn("size", F.lit(1))).where("n_links = 1").count() == 2


def planted(n, dims, low, high, seed=11):
    """``n`` pairs of vectors with cosines from ``low`` to ``high``, far from all others."""
    rng = np.random.default_rng(seed)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x, y, c = unit(rng.standard_normal((n, dims))), rng.standard_normal((n, dims)), rng.uniform(low, high, (n, 1))
    return np.stack([x, c * x + np.sqrt(1 - c * c) * unit(y - (x * y).sum(axis=1, keepdims=True) * x)], axis=1).reshape(2 * n, dims)


def test_embeddings_recall_of_windows(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CELL", 1 << 20)
    x = planted(2000, 64, 0.98, 0.985)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    want = int(((x[::2] * x[1::2]).sum(axis=1) >= 0.98).sum())
    assert neardup.near_duplicates(df).agg(F.sum("n_links")).first()[0] >= 2 * 0.999 * want


def test_embeddings_of_several_lengths(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CELL", 1 << 20)
    x, schema = planted(1000, 64, 0.98, 0.985), "vec_id long, embedding array<double>, label int"
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(-1, [1.0] * 512, 1)]
    want = int(((x[::2] * x[1::2]).sum(axis=1) >= 0.98).sum())
    assert neardup.near_duplicates(spark.createDataFrame(rows, schema)).agg(F.sum("n_links")).first()[0] >= 2 * 0.999 * want


def test_embeddings_beside_a_larger_label(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CELL", 600)
    monkeypatch.setattr(neardup, "STRONGEST", 1)
    few, many, schema = planted(250, 16, 0.981, 0.985), planted(500, 16, 0.981, 0.985, 12), "vec_id long, embedding array<double>, label int"
    rows = [(i, v.tolist(), 1) for i, v in enumerate(few)] + [(1000 + i, v.tolist(), 2) for i, v in enumerate(many)]
    assert neardup.near_duplicates(spark.createDataFrame(rows, schema)).where("vec_id < 1000").agg(F.sum("n_links")).first()[0] >= 500


@pytest.mark.parametrize("rotations", [1, 2])
def test_embeddings_recall_of_cells(rotations):
    dims, n = 384, 20_000
    x = planted(n, dims, 0.98, 0.98)
    both = np.ones(n, dtype=bool)
    for r in range(rotations):
        q = x @ neardup.directions(dims, dims, seed=50 + r).T
        top = np.argpartition(-np.abs(q), neardup.STRONGEST, axis=1)[:, : neardup.STRONGEST]
        cells = 2 * top + (np.take_along_axis(q, top, axis=1) > 0)
        both &= (cells[::2, :, None] == cells[1::2, None, :]).any(axis=(1, 2))
    assert both.mean() >= 0.9998


def test_filter_of_fixed_size(spark):
    rows, keys = spark.range(3000).withColumn("k", F.col("id").cast("string")), spark.range(0, 3000, 7).select(F.col("id").cast("string").alias("k"))
    marked = {r["id"]: r["_may"] for r in common.with_filter(rows, keys, "_may", ["k"]).collect()}
    assert len(marked) == 3000 and all(marked[i] for i in range(0, 3000, 7))
    assert sum(marked.values()) < 500
    assert not any(r["_may"] for r in common.with_filter(rows, keys.where("false"), "_may", ["k"]).collect())


def test_small_joins_by_broadcast_and_by_shuffle(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(30)] + [(99, None)], "id long, k string")
    small = spark.createDataFrame([("a", 1), ("a", 2), ("c", 3)], "k string, v int")
    want = sorted(map(tuple, common.join_small(rows, small, ["k"]).select("id", "k", "v").collect()))
    assert len(want) == 40
    monkeypatch.setattr(common, "MAX_BROADCAST_BYTES", 0)
    assert sorted(map(tuple, common.join_small(rows, small, ["k"]).select("id", "k", "v").collect())) == want


def test_decontaminate_without_broadcasts(compare, documents, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "MAX_BROADCAST_BYTES", 0)
    item = " ".join(f"w{i % 5}x{i}" for i in range(14))
    docs = documents([(1, f"before {item} after"), (2, "w0x0 w1x1 alone"), (3, None), (4, item.upper())])
    bench = spark.createDataFrame([(7, item), (8, "w0x0 w1x1"), (9, None)], "item_id long, text string")
    compare(QUERIES["op6_decontaminate"], {"documents": docs, "benchmark": bench}, tmp_path, ORACLES["op6_decontaminate"])


def test_line_dedup_beside_any_columns(spark):
    run = "\n".join(f"line {i} " + "word " * 9 for i in range(8))
    df = spark.createDataFrame([(1, run, "x", 1, "h"), (2, "own\n" + run, "y", 2, "d")], "doc_id long, text string, runs string, begin int, h string")
    rows = sorted(tuple(r) for r in linededup.dedup_lines(df).collect())
    assert rows == [(1, run, "x", 1, "h", 8, 0), (2, "own", "y", 2, "d", 9, 8)]


def test_what_moves_for_a_pair_is_bounded(spark):
    """Bitmaps take two bits a shingle at most and still rule out what is far apart; rows without a partner of a near size don't reach a tile."""
    rng = np.random.default_rng(5)
    h = np.unique(rng.integers(0, 2**64, 3000, dtype=np.uint64) & ngramjoin._HIGH)
    for n, m, both in ((1000, 1000, 1000), (1000, 900, 880), (1000, 1200, 0), (1000, 1000, 700), (1100, 900, 100), (70, 60, 55), (5, 6, 5)):
        a, b = np.sort(h[:n]), np.sort(h[n - both : n - both + m])
        maps = [ngramjoin.bitmap(a), ngramjoin.bitmap(b)]
        assert all(8 * len(x) <= max(64, 2 * k) for x, k in zip(maps, (n, m), strict=True))
        bits = ngramjoin.folded(maps)
        bound = (n + m - int(np.bitwise_count(bits[0] ^ bits[1]).sum())) // 2
        assert bound >= both
        if n > 500 and both < 0.75 * n:
            assert bound < ngramjoin.least_overlap(n, m)
    rows = [(1, 1, 100, 3, 1), (1, 2, 124, 3, 2), (1, 3, 200, 3, 3), (2, 1, 100, 2, 1), (2, 4, 100, 2, 1), (3, 5, 10, 99, 5), (4, 6, 10, 2, 6), (4, 7, 13, 2, 7)]
    kept = ngramjoin._with_partner(spark.createDataFrame(rows, "token long, id long, n long, c long, comp long"), 80)
    assert sorted(map(tuple, kept.select("token", "id").collect())) == [(1, 1), (1, 2), (3, 5)]
