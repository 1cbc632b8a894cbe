"""Benchmark decontamination by a stored positional inverted index; DataFrame functions only.

Documents are tokenized once. What is stored are the postings of the benchmark's terms, (document, position, term), as
other terms can't be part of a match; one more posting behind the last word tells the number of words. A benchmark
window is a phrase of consecutive item words. Its terms are ordered by their postings; the list of the rarest is moved
by that term's place in the item, which gives where the item would begin, and is intersected with the list of the
second rarest, moved by its own place. What both agree on is compared with all lists of the item around that place:
runs of matching neighbours that are as long as a window are exact phrases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeloom.llm import common

#: Words of a window, as a fixed value of the task.
WINDOW = 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else; plain ASCII texts take the faster function."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def words_of(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.coalesce(F.regexp_extract_all(lower_ascii(text), F.lit(_WORD), F.lit(0)), F.array().cast("array<string>"))


_KEYS = ["key", "text_hash"]
_END = ""  # no word is empty, so this term stands for the end of a document


def benchmark_texts(bench: DataFrame, item: str, text: str) -> tuple[DataFrame, DataFrame]:
    """``(tid, words)`` of the different texts with any word, and ``(tid, item)`` of the items that have them."""
    w = bench.select(F.col(item).cast("string").alias("item"), words_of(F.col(text)).alias("words")).where(F.size("words") > 0)
    w = common.materialize(w.withColumn("tid", F.md5(F.array_join("words", " "))))
    return w.groupBy("tid").agg(F.min("words").alias("words")), w.select("tid", "item").distinct()


def build_postings(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The index: ``(key, text_hash, pos, id)`` for every occurrence of a term of ``vocabulary(term, id)``, written once.

    ``docs`` has ``key``, ``text_hash`` and ``t``. Exploded words meet the vocabulary in the same stage if it may be
    broadcast; else terms are shuffled, each dealt over several tasks. Positions count from 0; the end of a document has the empty term's id and the number of words as position.
    """
    words = F.concat(words_of(F.col("t")), F.array(F.lit(_END)))
    spread = docs.select(*_KEYS, F.posexplode(words).alias("pos", "term"))
    return common.materialize(common.join_small(spread, vocabulary, ["term"]).select(*_KEYS, "pos", "id"))


def _same_doc(a: DataFrame, b: DataFrame):
    return a["key"].eqNullSafe(b["key"]) & (a["text_hash"] == b["text_hash"])


def _anchors(post: DataFrame, places: DataFrame, size: int) -> DataFrame:
    """``(tid, win, rank, id, at)``: the rarest and second rarest term of every window whose terms all occur, with their places in the item."""
    counts = post.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    n = common.materialize(common.join_small(places, common.materialize(counts), ["id"], "left"))
    per_text = n.groupBy("tid").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "id"))).alias("ts"))  # the words of one item
    wins = per_text.select("tid", "ts", F.explode(F.sequence(F.lit(1), F.size("ts") - F.least(F.lit(size), F.size("ts")) + 1)).alias("win"))
    by = F.expr(f"array_sort(transform(slice(ts, win, {size}), x -> struct(x.n as n, x.at as at, x.id as id)))")
    wins = wins.select("tid", "win", by.alias("by")).where("by[0].n > 0")
    first = wins.select("tid", "win", F.lit(1).alias("rank"), F.col("by")[0]["id"].alias("id"), F.col("by")[0]["at"].alias("at"))
    second = wins.select("tid", "win", F.lit(2).alias("rank"), F.expr("by[least(1, size(by) - 1)]").alias("x")).select("tid", "win", "rank", "x.id", "x.at")
    return common.materialize(first.unionByName(second))


def _moved(post: DataFrame, anchors: DataFrame, rank: int) -> DataFrame:
    """Postings of the anchors of a rank, moved by their places: ``(key, text_hash, tid, begin)``."""
    at = anchors.where(F.col("rank") == rank).select("tid", "id", "at").distinct()
    found = common.join_small(post, at, ["id"])
    return found.select(*_KEYS, "tid", (F.col("pos") - F.col("at")).alias("begin")).distinct()


def _index(docs: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings, and ``(tid, at, id)`` of the words of the benchmark's texts."""
    words = texts.select("tid", F.posexplode("words").alias("at", "term"))
    places = common.materialize(words.withColumn("id", F.xxhash64("term")))
    vocabulary = common.materialize(places.select("term", "id").unionByName(docs.sparkSession.range(1).select(F.lit(_END).alias("term"), F.xxhash64(F.lit(_END)).alias("id"))).distinct())
    if vocabulary.select("id").distinct().count() != vocabulary.count():
        raise ValueError("two terms of the benchmark have one hash")
    return build_postings(docs, vocabulary), places.select("tid", "at", "id")


def phrase_matches(post: DataFrame, places: DataFrame, size: int = WINDOW) -> DataFrame:
    """``(key, text_hash, tid, begin, end)``: the longest runs of words that document and item share, if they hold a window."""
    anchors = _anchors(post, places, size)
    a, b = _moved(post, anchors, 1).alias("a"), _moved(post, anchors, 2).alias("b")
    agree = F.col("a.key").eqNullSafe(F.col("b.key")) & (F.col("a.text_hash") == F.col("b.text_hash")) & (F.col("a.tid") == F.col("b.tid")) & (F.col("a.begin") == F.col("b.begin"))
    length = places.groupBy("tid").agg((F.max("at") + 1).alias("len"))
    cand = common.materialize(common.join_small(a.join(b, agree).select("a.*"), length, ["tid"]))
    inside = _same_doc(post, cand) & (post["pos"] >= cand["begin"]) & (post["pos"] < cand["begin"] + cand["len"])
    near = post.join(cand, inside).select(cand["key"], cand["text_hash"], "tid", "begin", "len", "pos", "id").withColumn("at", F.col("pos") - F.col("begin"))
    hit = common.join_small(near, places, ["tid", "at", "id"]).select(*_KEYS, "tid", "begin", "len", "at").distinct()
    # neighbours share the difference between place and rank
    line = Window.partitionBy(*_KEYS, "tid", "begin").orderBy("at")
    runs = hit.withColumn("run", F.col("at") - F.row_number().over(line)).groupBy(*_KEYS, "tid", "begin", "len", "run").agg(F.min("at").alias("lo"), F.count(F.lit(1)).cast("int").alias("n"))
    return runs.where(F.col("n") >= F.least(F.lit(size), F.col("len"))).select(*_KEYS, "tid", (F.col("begin") + F.col("lo")).alias("begin"), (F.col("begin") + F.col("lo") + F.col("n")).alias("end"))


def proximity_matches(post: DataFrame, places: DataFrame, size: int = WINDOW, slop: int = 3) -> DataFrame:
    """``(key, text_hash, tid, win, begin)``: the two rarest terms of a window occur, moved by their places, within ``slop`` words of one another."""
    anchors = _anchors(post, places, size)
    moved = lambda rank: common.join_small(post, anchors.where(F.col("rank") == rank).select("tid", "win", "id", "at"), ["id"]).select(*_KEYS, "tid", "win", (F.col("pos") - F.col("at")).alias("begin"))
    a, b = moved(1).alias("a"), moved(2).alias("b")
    same = F.col("a.key").eqNullSafe(F.col("b.key")) & (F.col("a.text_hash") == F.col("b.text_hash")) & (F.col("a.tid") == F.col("b.tid")) & (F.col("a.win") == F.col("b.win"))
    return a.join(b, same & (F.abs(F.col("a.begin") - F.col("b.begin")) <= slop)).select("a.*").distinct()


def _source(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("key"), F.xxhash64(F.lit(1), F.col(text)).alias("text_hash"), F.col(text).alias("t"))


def contamination(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", bench_text: str = "text", size: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: ``key, text_hash, n_words, n_hit, items, spans``.

    ``n_hit`` counts the words inside any occurrence of a window, ``items`` are the ids (as strings, sorted) of items
    with an occurring window, ``spans`` the sorted word intervals of the occurrences, joined where windows of an item
    overlap. Null and empty texts have no words and no hits; an empty benchmark hits nothing; items without words
    have no window; items that repeat count by their id. Rows that share key and text are judged alike.
    """
    return common.condensed(lambda: _judged(docs, bench, key, text, item, bench_text, size))


def _judged(docs: DataFrame, bench: DataFrame, key: str, text: str, item: str, bench_text: str, size: int) -> DataFrame:
    src = _source(docs, key, text)
    texts, named = benchmark_texts(bench, item, bench_text)
    post, places = _index(src, texts)
    end = F.col("id") == F.xxhash64(F.lit(_END))
    matches = common.join_small(common.materialize(phrase_matches(post.where(~end), places, size)), named, ["tid"])
    # both kinds of set are bounded by the words of the document and by the benchmark
    per_doc = matches.groupBy(*_KEYS).agg(F.sort_array(F.collect_set(F.struct("begin", "end"))).alias("spans"), F.sort_array(F.collect_set("item")).alias("items"))
    covered = F.expr("aggregate(spans, named_struct('n', 0L, 'to', 0), (a, x) -> named_struct('n', a.n + greatest(0, x.end - greatest(x.begin, a.to)), 'to', greatest(a.to, x.end)), a -> a.n)")
    per_doc = per_doc.withColumn("n_hit", covered).withColumnsRenamed({"key": "k2", "text_hash": "h2"})
    base = post.where(end).select(*_KEYS, F.col("pos").cast("long").alias("n_words"))
    out = base.join(per_doc, base["key"].eqNullSafe(per_doc["k2"]) & (base["text_hash"] == per_doc["h2"]), "left")
    return out.select(
        F.col("key").alias(key),
        "text_hash",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.expr("cast(array() as array<struct<begin:int,end:int>>)")).alias("spans"),
    )


def drop_contaminated(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", bench_text: str = "text", size: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that have no occurrence of any window, with all their columns; null texts stay.

    Only documents that a filter of fixed size lets through, bad ones and few others, are shuffled.
    """

    def found() -> DataFrame:
        post, places = _index(_source(docs, key, text), benchmark_texts(bench, item, bench_text)[0])
        return phrase_matches(post, places, size).select(F.col("key").alias("_bad_key"), F.col("text_hash").alias("_bad_hash")).distinct()

    bad = common.condensed(found)
    marked = docs.withColumn("_bad_key", F.col(f"`{key}`")).withColumn("_bad_hash", F.xxhash64(F.lit(1), F.col(f"`{text}`")))
    sifted = common.with_filter(marked, bad, "_may_be_bad", ["_bad_key", "_bad_hash"]).select(*marked.columns, "_may_be_bad").alias("m")
    same = F.col("m._bad_key").eqNullSafe(F.col("b._bad_key")) & (F.col("m._bad_hash") == F.col("b._bad_hash"))
    checked = sifted.where("_may_be_bad").join(bad.alias("b").hint("merge"), same, "left_anti")
    kept = [F.col(f"`{c}`") for c in docs.columns]
    return sifted.where("not _may_be_bad").select(*kept).unionByName(checked.select(*kept))
