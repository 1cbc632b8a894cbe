"""Containment and alignment against plain loops: the index, the bounds, and the rounds beside a queue of single steps."""

import random
import re
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.functions import similarity
from citeloom.operators import alignment, containment, joins


def pairs(df):
    return sorted(tuple(r) for r in df.select("needle", "haystack").collect())


def frame(spark, texts, name="t"):
    return spark.createDataFrame([(f"{name}{i}", t) for i, t in enumerate(texts)], "key string, text string").repartition(3)


@pytest.mark.parametrize("min_length", [1, 4, 20, 50])
def test_contained_against_loops(spark, min_length):
    rnd = random.Random(min_length)
    letters = "ab c" if min_length < 20 else "abcdefghé ü"
    hay = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 160))) for _ in range(60)]
    hay += [hay[3], hay[3], "a" * 150, "", "x" * 49]
    needles = [h[s : s + rnd.randint(1, 120)] for h in hay for s in (rnd.randrange(max(len(h), 1)),)]
    needles += ["".join(rnd.choice(letters) for _ in range(70)) for _ in range(20)] + ["a" * 60, hay[3], hay[3], None]
    want = sorted((f"n{i}", f"h{j}") for i, n in enumerate(needles) for j, h in enumerate(hay) if n and len(n) >= min_length and n in h)
    assert pairs(containment.contained(frame(spark, needles, "n"), frame(spark, hay, "h"), min_length)) == want
    assert len(want) > 10


def test_contained_of_many_repeats(spark):
    rnd = random.Random(5)
    part = lambda: [re.sub(r"\s+", " ", "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz" + " " * 8) for _ in range(rnd.randint(100, 1000)))) for _ in range(100)]
    a, b, c = part(), part(), part()
    one = a * 10 + b + a * 25 + ["sdf sdf", "sdfsdf"]
    two = c * 15 + b + c * 20 + ["sdf sdf", "sdfsdf"]
    assert len(one) == len(two) == 3602
    found = containment.contained(frame(spark, two), frame(spark, one), 1)
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert found.count() == 102
    assert 0 < containment.contained(frame(spark, two), frame(spark, one), 101).count() < 102


def test_contained_with_fixed_ends_and_empty(spark):
    hay, needles = ["one two three four", "one twothree"], ["two three", "ne two thre", "two", "twothre"]
    n, h = frame(spark, needles, "n"), frame(spark, hay, "h")
    assert pairs(containment.contained(n, h, 1)) == [("n0", "h0"), ("n1", "h0"), ("n2", "h0"), ("n2", "h1"), ("n3", "h1")]
    assert pairs(containment.contained(n, h, 1, fixed_ends=True)) == [("n0", "h0"), ("n2", "h0")]
    assert pairs(containment.contained(n.where("false"), h, 1)) == pairs(containment.contained(n, h.where("false"), 1)) == []


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_containment_of_ends_with_one_partner(spark, seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7)))
    part = lambda n: " ".join(word() for _ in range(n))
    shared, body = part(12), part(40)
    copies = [body.replace(w, w + "x", 1) for w in rnd.sample(body.split(), 12)]
    one = [f"{i} {t}" for i, t in enumerate([shared, shared + " end", *copies, *(part(20) for _ in range(25))])]
    two = [f"§ {t}" for t in [*(f"{part(3)} {shared} {c}" for c in copies), *(t.split(" ", 1)[1].rsplit(" ", 1)[0] for t in one[8:]), *(f"{t.split(' ', 1)[1]} more" for t in one[20:30]), shared]]
    two += rnd.sample(two, 4)
    clip = lambda t: t.split(" ", 1)[1]
    holds = lambda a, b: len(a) >= 50 and a in b
    links = [(i, j) for i, a in enumerate(map(clip, one)) for j, b in enumerate(map(clip, two)) if holds(a, b) or holds(b, a)]
    lone = lambda k: {x for x in (p[k] for p in links) if sum(p[k] == x for p in links) == 1}
    want = sorted((f"a{i}", f"b{j}") for i, j in links if i in lone(0) and j in lone(1))
    found = sorted((r["key1"], r["key2"]) for r in alignment.by_containment(frame(spark, one, "a"), frame(spark, two, "b")).collect())
    assert found == want and len(want) > 5 and len(links) > 3 * len(want)


def test_joins_beyond_the_bound_are_the_same(spark, monkeypatch):
    rnd = random.Random(6)
    hay = ["".join(rnd.choice("abcdefgh ") for _ in range(200)) for _ in range(80)]
    needles = [h[20:120] for h in hay[::2]] + ["zzzz" * 20]
    want = pairs(containment.contained(frame(spark, needles, "n"), frame(spark, hay, "h")))
    monkeypatch.setattr(joins, "few_bytes", lambda df, most=0: False)
    assert pairs(containment.contained(frame(spark, needles, "n"), frame(spark, hay, "h"))) == want and len(want) == 40


def test_filter_holds_back_no_key(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("h"))
    bits = joins.key_filter(keys, "h")
    import numpy as np

    own = np.array([r[0] for r in keys.collect()], dtype=np.int64).view(np.uint64)
    other = np.array([r[0] for r in spark.range(5000, 25000).select(F.xxhash64("id")).collect()], dtype=np.int64).view(np.uint64)
    assert joins.passes(bits, own).all() and joins.passes(bits, other).mean() < 0.02
    sifted = joins.sifted(spark.range(20000).withColumnRenamed("id", "k"), spark.range(500).withColumnRenamed("id", "k"), "k").collect()
    assert {r[0] for r in sifted} >= set(range(500)) and len(sifted) < 1500


def test_bounds_hold_back_no_similar_pair(spark):
    rnd = random.Random(7)
    texts = []
    for _ in range(300):
        a = "".join(rnd.choice("abcde é") for _ in range(rnd.randint(0, 40)))
        b = list(a)
        for _ in range(rnd.randint(0, 12)):
            b.insert(rnd.randint(0, len(b)), rnd.choice("abcdefgh"))
        texts.append((a, "".join(b) if rnd.random() < 0.8 else "".join(rnd.sample(b, len(b)))))
    df = spark.createDataFrame(texts, "a string, b string")
    cells = lambda c: alignment._cells(c)
    bound = similarity.upper_bound(F.length("a"), F.length("b"), cells("a"), cells("b"), F.substring("a", 1, 4), F.substring("b", 1, 4))
    rows = df.select("a", "b", bound.alias("bound"), similarity.jaro_winkler_column("a", "b").alias("sim")).collect()
    assert all(r["sim"] <= r["bound"] for r in rows)
    ratio = similarity.least_length_ratio(0.9)
    assert all(min(len(r["a"]), len(r["b"])) >= ratio * max(len(r["a"]), len(r["b"])) for r in rows if r["sim"] > 0.9)
    assert sum(r["bound"] < 0.9 for r in rows) > 20 and sum(r["sim"] > 0.9 for r in rows) > 20


def by_queue(one, two, mapping, radius, threshold):
    """One unit after another: the best free text near the images of its neighbours, whose neighbours are asked again."""
    place1, place2 = {k: i for i, (k, _) in enumerate(one)}, {k: i for i, (k, _) in enumerate(two)}
    near = lambda units, i, key: [k for k, _ in units[max(0, i - radius) : i + radius + 1] if k.split("_")[0] == key.split("_")[0]]
    done, free1, free2 = dict(mapping), {k for k, _ in one} - set(mapping), {k for k, _ in two} - set(mapping.values())
    queue = deque(sorted(free1))
    while queue:
        key = queue.popleft()
        if key not in free1:
            continue
        around = near(one, place1[key], key)
        images = {k for n in around if n in done for k in near(two, place2[done[n]], done[n]) if k in free2}
        scored = [(similarity.jaro_winkler(one[place1[key]][1], two[place2[k]][1]), -place2[k], k) for k in images]
        if scored and max(scored)[0] > threshold:
            best = max(scored)[2]
            done[key] = best
            free1.remove(key)
            free2.remove(best)
            queue.extend(k for k in around if k in free1)
    return done


@pytest.mark.parametrize(("seed", "chars"), [(1, 20_000_000), (2, 20_000_000), (1, 0), (2, 3_000)])
def test_rounds_against_a_queue(spark, monkeypatch, seed, chars):
    monkeypatch.setattr(alignment, "ISLAND_CHARS", chars)  # on islands, in rounds over all tasks, and some each way
    rnd = random.Random(seed)
    words = [f"{rnd.randrange(36**6):x}" for _ in range(600)]
    old = [(f"l{i // 60}_{i:03d}", " ".join(rnd.choice(words) for _ in range(rnd.randint(8, 25)))) for i in range(180)]
    new = []
    for key, text in old:
        if rnd.random() < 0.1:
            continue  # a unit that went
        if rnd.random() < 0.1:
            new.append((f"{key}n", " ".join(rnd.choice(words) for _ in range(15))))  # one that came
        t = text.split(" ")
        if rnd.random() < 0.8:
            t[rnd.randrange(len(t))] = "amended"
        new.append((key, " ".join(t) + (" and more" if rnd.random() < 0.3 else "")))
    df = lambda rows: spark.createDataFrame([(i, k, "", t) for i, (k, t) in enumerate(rows)], "pos long, key string, citekey string, text string")
    anchors = {k: k for k, t in new[::12] if k in dict(old)}
    mapping = spark.createDataFrame([(k, k, "text") for k in anchors], alignment.MAPPING)
    found = {r["key1"]: r["key2"] for r in alignment.by_neighbours(df(old), df(new), mapping, 5, 0.85).collect()}
    assert {**anchors, **found} == by_queue(old, new, anchors, 5, 0.85)
    assert len(found) > 100


def test_progress_of_an_alignment(spark):
    df = lambda n: spark.range(n).select(F.col("id").alias("pos"), F.concat(F.lit("l_"), F.col("id")).alias("key"))
    mapping = spark.createDataFrame([("l_0", "l_0", "text"), ("l_1", "l_1", "text"), ("l_2", "l_2", "citekey")], alignment.MAPPING)
    assert sorted(map(tuple, alignment.progress(mapping, df(6), df(9)).collect())) == [("all", 3, 0.5), ("citekey", 1, 1 / 6), ("text", 2, 2 / 6)]


def test_short_needles_ask_for_true_finds_only(spark):
    """A gram that many texts share brings no needle to all of them: what is around it is asked for too."""
    rnd = random.Random(8)
    noise = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    gram, window = containment.shape(50)
    made = [noise(rnd.randint(50, 70)) for _ in range(400)]
    needles = [t for t in made if len(containment.marks(t.encode(), gram, window)[0]) == 1][:40]
    place = lambda t: int(containment.marks(t.encode(), gram, window)[0][0])
    hay = [noise(42) + t[place(t) : place(t) + gram] + noise(42) for t in needles for _ in range(30)]
    hay += [noise(rnd.randint(0, 60)) + t + noise(rnd.randint(0, 60)) for t in needles] + needles
    n, h = frame(spark, needles, "n"), frame(spark, hay, "h")
    asking = containment.materialize(containment.needles_of(n, 50))
    bits = joins.key_filter(containment.known_by(asking), "block")
    postings = containment.postings_of(h, bits, 50)
    found = postings.join(asking, postings["block"] == asking["first"]).select("needle", "haystack").distinct().count()
    assert found < 3 * len(needles)  # a gram alone finds some thirty a needle
    want = sorted((f"n{i}", f"h{j}") for i, t in enumerate(needles) for j, x in enumerate(hay) if t in x)
    assert pairs(containment.contained(n, h)) == want and len(needles) == 40 and len(want) == 80


def test_blocks_of_many_texts_are_made_at_once(monkeypatch):
    """Hashes of blocks are made for all texts of a part together, and are those that every text gives alone."""
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("ab cdefgh") for _ in range(rnd.randrange(50, 400))).encode() for _ in range(120)]
    gram, window = containment.shape(50)
    bits, calls, mixed = np.full(8, 255, dtype=np.uint8), [], containment._mixed
    monkeypatch.setattr(containment, "_mixed", lambda x: calls.append(1) or mixed(x))

    def made(part):
        marked = containment.Marks.of(part, gram, window)
        ends, at, bare, short = containment.asked(marked, gram, window)
        posted = sorted((int(o), int(k), int(b)) for key, begin in containment.filed(marked, gram, window, bits) for o, k, b in zip(marked.owner[begin], key, marked.begins(begin), strict=True))
        return [x.T.tolist() for x in (ends, at, np.where(short, bare, 0), short)], posted

    together, n = made(texts), len(calls)
    alone = [made([t]) for t in texts]
    assert together[0] == [sum((a[0][i] for a in alone), []) for i in range(4)]
    assert together[1] == sorted((i, *row[1:]) for i, a in enumerate(alone) for row in a[1])
    assert any(together[0][3]) and not all(together[0][3])
    assert n < len(texts) + 100 < (len(calls) - n) / 10
