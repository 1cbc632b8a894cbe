"""Top-k search, repair of turns and periodic runs against brute force, with nulls, ties, repeats, long and empty input."""

import hashlib
import itertools
import random
import zlib
from math import floor, inf, nan

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.llm import periodic, topk, turnrepair
from citeloom.llm.queries import QUERIES
from citeloom.llm.sql import ORACLES

# -- top-k ----------------------------------------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)


def random_vectors(n, dims, seed, ties=False):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, dims)) / np.sqrt(dims)
    v[n // 2 :: 7] = v[0]  # copies, so that scores tie
    return (np.round(v * 4) / 4 if ties else v).astype(np.float32)


@pytest.mark.parametrize("ties", [False, True])
def test_top_k_query(compare, spark, tmp_path, ties):
    rows = [(i, v.tolist(), 0) for i, v in enumerate(random_vectors(700, 24, 3, ties))]
    rows += [(1100, None, 1), (1200, [1.0, None] + [0.0] * 22, 1), (1300, [inf] * 24, 1), (1400, [nan] * 24, None), (1500, [0.0] * 24, None), (None, rows[0][1], 0), (300, rows[300][1], 0)]
    compare(QUERIES["op11_topk_search"], {"embeddings": vectors(spark, rows)}, tmp_path, ORACLES["op11_topk_search"])


def test_top_k_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 60)
    monkeypatch.setattr(topk, "BLOCK", 16)
    v = np.floor(random_vectors(500, 16, 5).astype(np.float64) * 1024).astype(np.int64)
    df = spark.createDataFrame([(i, [float(x) / 1024 for x in r]) for i, r in enumerate(v)], "id long, vec array<double>")
    found = {}
    for r in topk.top_k(df, "id", "vec", F.col("id") % 9 == 0, 5).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["id"], r["score"])
    scores = v @ v.T
    for q in range(0, 500, 9):
        want = sorted((-int(scores[q, c]), c) for c in range(500) if c != q)[:5]
        assert [found[q][k + 1] for k in range(5)] == [(c, -s) for s, c in want]
    assert set(found) == set(range(0, 500, 9))


def test_top_k_stops_on_proof():
    rng = np.random.default_rng(1)
    rows = np.floor(1024 * rng.standard_normal((4000, 32)) / 6).astype(np.int64)
    shard = topk.Shard.of(np.arange(4000), np.zeros(4000, bool), rows)
    for q in (rows[5], rows[17] * 1000, np.zeros(32, np.int64), np.eye(32, dtype=np.int64)[3] * 7, -rows[9]):
        exact = rows @ q
        want = np.flatnonzero(exact >= np.sort(np.delete(exact, 5))[-10])
        assert set(shard.best(q, 5, 10)) == set(want) - {5}


def test_top_k_odd_input(spark):
    none = topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id", "embedding", F.col("vec_id") % 100 == 0, 10)
    assert none.collect() == []
    # shorter vectors are filled with zeros, huge components are set to the bound, clashing names don't matter
    rows = [(0, [1.0, 2.0], 1), (1, [1.0], 2), (2, [], 3), (3, [3e38, 3e38], 4), (4, [-1.0, -1.0], 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    found = [(r["rank"], r["id"], r["score"]) for r in topk.top_k(df, "vec_id", "embedding", F.col("vec_id") == 0, 10).orderBy("rank").collect()]
    assert [x[:2] for x in found] == [(1, 3), (2, 1), (3, 2), (4, 4)] and found[1][2] == 1024**2 and found[2][2] == 0 and found[0][2] > 1 << 40
    alone = topk.top_k(df.where("vec_id = 0"), "vec_id", "embedding", F.col("vec_id") == 0, 10)
    assert alone.collect() == []


# -- repair of turns ------------------------------------------------------------------------------------------------


def every_way(symbols):
    """All edit strings up to two insertions at a place, by cost; slow and plain."""
    best = None
    n = len(symbols)
    for edits in itertools.product("DKUA", repeat=n):
        for puts in itertools.product(("", "u", "a", "ua", "au"), repeat=n + 1):
            roles, cost, audit = "", 0, ""
            for i in range(n + 1):
                roles, cost, audit = roles + puts[i], cost + 3 * len(puts[i]), audit + "I" * len(puts[i])
                if i == n:
                    break
                e, s = edits[i], symbols[i]
                if s == "x" and e != "D":
                    cost = 10**6
                cost += {"D": 4, "K": 0}.get(e, 3) + (3 if e != "D" and s.isupper() else 0)
                roles += {"D": "", "K": s.lower()}.get(e, e.lower())
                audit += e if e in "DK" else "R"
            body = roles[1:] if roles.startswith("s") else roles
            if (roles == "" or (body and body == "ua" * (len(body) // 2))) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def test_plans_against_every_way():
    names = str.maketrans("UAua", "RRII")
    signatures = sorted({"".join(s) for n in range(4) for s in itertools.product("suaoUAx", repeat=n) if n < 3 or random.Random(str(s)).random() < 0.15})
    for signature, cost, plan in turnrepair.walk(iter(signatures)):
        assert (cost, plan.translate(names)) == every_way(signature), signature


def by_hand(rows):
    """What the query returns, one conversation after another."""
    out, ink = {}, lambda t: t.strip(" \t\n\x0b\f\r")
    names = str.maketrans("UAua", "RRII")
    for conv in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in [r for r in rows if r[0] == conv]:
            role, text = " " if role is None else role, " " if text is None else text
            hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if hit == 0:
                continue
            text = "" if hit == 1 else "".join(c for c in text if c not in ".!?") if hit == 2 else text
            kept += [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
        signature, faults, seen = "", [0, 0, 0], set()
        for _, role, text in kept:
            first = role[:1] if role[:1] in ("s", "u", "a") else "o"
            if not ink(text):
                faults[0], first = faults[0] + 1, "x"
            elif (role, text) in seen:
                faults[1], first = faults[1] + 1, "x"
            elif ink(text)[-1] not in ".!?":
                faults[2], first = faults[2] + 1, first.upper()
            seen.add((role, text))
            signature += first
        ((_, cost, plan),) = turnrepair.walk(iter([signature]))
        turns = [r[0] for r in kept if r[0] is not None]
        lines, rest = [], iter(kept)
        for e in plan:
            if e in "ua":
                lines.append({"u": "user:", "a": "assistant:"}[e])
            else:
                _, role, text = next(rest)
                if e != "D":
                    lines.append({"K": role, "U": "user", "A": "assistant"}[e] + ":" + text)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(kept))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *faults, illegal, cost, plan.translate(names), hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("batch", [3, 1000])
def test_turn_repair_query(compare, spark, tmp_path, monkeypatch, batch):
    monkeypatch.setattr(turnrepair, "ROWS", batch)  # answers come back in many batches too
    rnd, rows = random.Random(2), []
    for conv in [*range(150), None]:
        for turn in range(rnd.choice([1, 2, 5, 9])):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = rnd.choice(["Hi.", "Hi.", "what", "x y?", "", " \n", None, "né!\t", "a ", "end.\x0b"])
            rows += [(conv, rnd.choice([turn, turn, turn, turn + 3, None]), role, text)] * rnd.choice([1, 1, 1, 2])
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("plan", F.lit("x")).repartition(5)
    found = compare(QUERIES["op12_turn_repair"], {"conversations": df}, tmp_path)
    want = by_hand(rows)
    got = {None if r.conv_id != r.conv_id or r.conv_id is None else int(r.conv_id): tuple(getattr(r, c) for c in COLUMNS) for r in found.itertuples()}
    assert len(found) == len(want) and got == want
    assert found["duplicate"].sum() > 10 and found["truncated"].sum() > 10 and found["gaps"].sum() > 10


def test_turn_repair_of_the_tables(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in QUERIES["op12_turn_repair"](spark, sf).collect()}
    assert found == by_hand(rows)


def test_turn_repair_of_long_and_empty(spark, monkeypatch):
    monkeypatch.setattr(turnrepair, "CHUNK", 7)
    schema = "conv_id long, turn long, role string, text string"
    assert turnrepair.report(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, i, "user" if i % 2 else "assistant", f"{i}.") for i in range(500)]
    df = spark.createDataFrame(rows, schema)
    found = turnrepair.report(df, spark.createDataFrame([(1,), (2,), (2,)], "conv_id long"))
    # cheapest: the first assistant gets a user turn before it, and the last user turn an answer or none
    got = {r["conv_id"]: (r["cost"], len(r["plan"]), r["gaps"], r["illegal"]) for r in found.collect()}
    assert got == {1: (6, 502, 0, 0), 2: (0, 0, 0, 0)}
    turns = turnrepair.repaired(df, found).collect()
    assert [r["role"] for r in turns] == ["user", "assistant"] * 251 and [r["edit"] for r in turns].count("I") == 2


# -- periodic runs --------------------------------------------------------------------------------------------------


def all_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i - s + q
            if i > s and length >= max(6, 4 * q) and not any(all(w[t] == w[t + d] for t in range(s, s + length - d)) for d in range(1, q)):
                out.append((s, length, q))
            i = max(i, s + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(key, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + floor((n - a) / (3 + g % 8))
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def expected(key, text):
    w = planted(key, text)
    runs = all_runs(w)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    keep = [True] * len(w)
    for s, n, q in runs:
        keep[s + q : s + n] = [False] * (n - q)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return len(runs), *best, milli, sha(lines.encode()), sha(b" ".join(x for x, k in zip(w, keep, strict=True) if k))


def test_runs_of_random_sequences():
    rnd = random.Random(6)
    for _ in range(3000):
        w = [rnd.randrange(rnd.choice([1, 2, 3, 5])) for _ in range(rnd.randint(0, 50))] * rnd.randint(1, 5)
        if len(w) > 12 and rnd.random() < 0.5:
            s, p = rnd.randrange(len(w)), rnd.randint(1, 9)
            w[s:] = [w[s + i % p] if s + i % p < len(w) else 0 for i in range(len(w) - s)]
        assert periodic.runs_of(w) == all_runs(w)
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 2000:
        fib.append(fib[-1] + fib[-2])
    assert periodic.runs_of(fib[-1]) == all_runs(fib[-1])
    assert periodic.runs_of([3] * 100_000) == [(0, 100_000, 1)]


def test_hashes_that_agree_by_chance(monkeypatch):
    # with a modulus of 7 nearly all hashes agree, so every answer hangs on the words themselves
    monkeypatch.setattr(periodic, "MOD", 7)
    rnd = random.Random(7)
    for _ in range(300):
        w = [rnd.randrange(2) for _ in range(rnd.randint(10, 120))] * rnd.choice([1, 1, 4])
        seq = periodic.Sequence(w)
        for _ in range(20):
            i, j = sorted(rnd.sample(range(len(w)), 2))
            k = seq.ahead(i, j)
            assert w[i : i + k] == w[j : j + k]


def test_periodic_runs_query(compare, documents, tmp_path):
    rnd = random.Random(8)
    texts = [" ".join(rnd.choice("ab cd ef é gh".split()) for _ in range(rnd.choice([0, 3, 6, 30, 200]))) for _ in range(150)]
    texts += ["a " * 7, "a\tb\x0bc\n" * 5, " \n ", "", None, "x y " * 9, "b\x1ca " * 8, " ".join(str(i % 3001) for i in range(12_100))]
    rows = list(enumerate(texts)) + [(3, texts[3]), (3, texts[3])]
    found = compare(QUERIES["op13_periodic_runs"], {"documents": documents(rows)}, tmp_path)
    got = sorted((int(r.doc_id), *(None if x != x else x for x in (r.n_runs, r.start, r.length, r.period, r.exponent_milli)), r.runs_sha256, r.collapsed_sha256) for r in found.itertuples())
    assert got == sorted((i, *expected(i, t)) for i, t in rows)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 5


def test_periodic_runs_columns_and_null_keys(spark):
    df = spark.createDataFrame([(None, "a b a b a b a b", 1, "k"), (5, None, 2, "k")], "doc_id long, text string, runs int, _bytes string")
    found = {r["doc_id"]: r for r in periodic.periodic_runs(periodic.with_planted_runs(df, "doc_id")).collect()}
    assert set(found[5].asDict()) == {"doc_id", "text", "_bytes", "n_words", "runs", "collapsed"}
    assert [tuple(x) for x in found[None]["runs"]] == [(0, 8, 2)] and found[None]["collapsed"] == "a b" and found[None]["_bytes"] == "k"
    assert found[5]["n_words"] == 0 and found[5]["collapsed"] == "" and found[5]["runs"] == []
    assert periodic.periodic_runs(df.where("false")).collect() == []
