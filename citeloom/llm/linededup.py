"""Line deduplication by prefix doubling over line-ID sequences; DataFrame functions only.

A document is the sequence of its lines that aren't blank. Lines get ranks as IDs; the rank of the run of 2k lines at
a position is made of the ranks of the two runs of k lines there, so after j rounds positions are sorted by their first
2^j lines, as in a suffix array that is built by prefix doubling. A set of positions with equal ranks is an interval
whose common prefix has at least 2^j lines; sets of one position can't share a longer prefix and leave the
rounds. A run of any length is named by two overlapping ranks, those of the power of two that begins it and of the one
that ends it. A repeated run counts from ``min_words`` words on. Every line of a maximal repeated run lies in a least
run of so many words that begins, or one that ends, at a line of it, and whose least runs repeat with it; so the least
runs that occurred before mark exactly the lines that a maximal repeated run has deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeloom.llm import common

#: A repeated run has this many words at least.
MIN_WORDS = 50
_POS = ["doc", "h", "pos"]


def _sequences(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(doc, h, lines)`` with ``lines`` an array of (raw, a, b, w): line index, two line hashes and number of words."""
    raw = docs.select(F.col(key).alias("doc"), F.xxhash64(F.lit(1), F.col(text)).alias("h"), F.split(F.col(text), "\n", -1).alias("ls")).where("ls is not null")
    cols = F.expr(r"filter(transform(ls, (x, i) -> struct(i as raw, xxhash64(x) as a, xxhash64('line', x) as b, regexp_count(x, '\\S+') as w)), x -> x.w > 0)")
    return raw.select("doc", "h", cols.alias("lines")).where(F.size("lines") > 0)


def _least_runs(min_words: int) -> str:
    """For every line, how many lines from it on (or back from it) have ``min_words`` words; 0 if there are fewer."""
    least = f"aggregate(slice({{}}, i + 1, {min_words}), named_struct('s', 0L, 'n', 0), (a, x) -> if(a.s >= {min_words}, a, named_struct('s', a.s + x, 'n', a.n + 1)), a -> if(a.s >= {min_words}, a.n, 0))"
    forward = f"transform(ws, (x, i) -> named_struct('begin', i, 'len', {least.format('ws')}))"
    back = f"transform(reverse(ws), (x, i) -> named_struct('n', {least.format('reverse(ws)')}, 'i', i))"
    backward = f"transform({back}, y -> named_struct('begin', size(ws) - y.i - y.n, 'len', y.n))"
    return f"array_distinct(filter(concat({forward}, {backward}), x -> x.len > 0))"


def repeated_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc, h, begin, len)``: least runs of lines that occurred before, in order of key, text hash and line.

    ``begin`` counts lines that aren't blank, from 0. A line longer than ``min_words`` is a run of its own.
    """
    # texts are cut into lines once; what the rounds read is written
    seqs = _sequences(docs, key, text).withColumn("ws", F.expr("transform(lines, x -> cast(x.w as long))"))
    seqs = common.materialize(seqs.select("doc", "h", F.expr("transform(lines, x -> struct(x.a as a, x.b as b))").alias("ids"), F.expr(_least_runs(min_words)).alias("runs")))
    lines = seqs.select("doc", "h", F.posexplode("ids").alias("pos", "x")).select(*_POS, F.col("x.a").alias("p"), F.col("x.b").alias("q"))
    runs = seqs.select("doc", "h", F.explode("runs").alias("r")).select("doc", "h", "r.begin", "r.len")
    longest = runs.agg(F.max("len")).first()[0]
    ranks, level, found = _rank(lines), 0, []
    while longest and (1 << level) <= longest:
        size = 1 << level
        found.append(_later_runs(runs.where((F.col("len") >= size) & (F.col("len") < 2 * size)), ranks, size))
        if 2 * size > longest:
            break
        # the rank of the run that follows, wherever its first line is still in the game
        following = Window.partitionBy("doc", "h").orderBy("pos").rangeBetween(size, size)
        ranks = _rank(ranks.select(*_POS, F.col("rank").alias("p"), F.min("rank").over(following).alias("q")).where("q is not null"))
        level += 1
    if not found:
        return runs.where(F.lit(False))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _rank(pairs: DataFrame) -> DataFrame:
    """``(doc, h, pos, p, q)`` to ``(doc, h, pos, rank)``: ranks keep the order of (p, q); pairs that occur once are left out.

    Equal pairs are counted before the shuffle and sorted by range; the id that grows along the sorted partitions is
    the rank. It is written, so that it stays the same when an executor is lost.
    """
    named = pairs.groupBy("p", "q").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("p", "q")
    named = common.materialize(named.orderBy("p", "q").withColumn("rank", F.monotonically_increasing_id()))
    return common.materialize(pairs.join(named, ["p", "q"]).select(*_POS, "rank"))


def _later_runs(runs: DataFrame, ranks: DataFrame, size: int) -> DataFrame:
    """Those of ``runs``, of ``size`` to less than twice as many lines, that an equal run comes before."""
    begins = ranks.select("doc", "h", F.col("pos").alias("begin"), F.col("rank").alias("r1"))
    ends = ranks.select("doc", "h", F.col("pos").alias("tail"), F.col("rank").alias("r2"))
    same = lambda a, b, c, d: a["doc"].eqNullSafe(b["doc"]) & (a["h"] == b["h"]) & (a[c] == b[d])
    x = runs.join(begins, same(runs, begins, "begin", "begin")).select(runs["doc"], runs["h"], runs["begin"], "len", "r1")
    x = x.withColumn("tail", F.col("begin") + F.col("len") - size)
    x = x.join(ends, same(x, ends, "tail", "tail")).select(x["doc"], x["h"], x["begin"], "len", "r1", "r2")
    place = F.struct(F.col("doc").isNull().alias("last"), "doc", "h", "begin")
    x = common.materialize(x.withColumn("place", place))
    first = x.groupBy("len", "r1", "r2").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return x.join(first, ["len", "r1", "r2"]).where(F.col("place") > F.col("first")).select("doc", "h", "begin", "len")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of ``docs`` with later copies of repeated runs of lines cut from ``text``; ``n_lines`` and ``n_cut`` are added.

    A run of consecutive lines (blank ones are passed over) with ``min_words`` words or more is cut wherever an equal run
    comes before it: in a document with a smaller key (null keys come last; then by a hash of the text), or higher up
    in its own. The first occurrence stays. Texts without such a run stay as they are, byte by byte; null texts stay
    null with 0 lines; a text that is cut as a whole becomes empty. Rows with equal key and text are one document, and
    all of them keep or lose the same lines. ``n_lines`` counts lines that aren't blank. Columns of ``docs`` with these two
    names are replaced, all others stay; an empty table gives no rows.
    """

    def cuts() -> DataFrame:
        runs = repeated_runs(docs, key, text, min_words)
        grouped = runs.groupBy("doc", "h").agg(F.collect_set(F.struct("begin", "len")).alias("_ld_runs"))  # bounded by the lines of a document
        return grouped.withColumnsRenamed({"doc": "_ld_doc", "h": "_ld_cut"})

    cut = common.condensed(cuts)
    kept = [c for c in docs.columns if c not in ("n_lines", "n_cut")]
    # names of our own beside any columns of the table
    src = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{key}`").alias("_ld_key"), F.xxhash64(F.lit(1), F.col(f"`{text}`")).alias("_ld_hash"))
    # texts are dealt out by key once, at every size alike; the list of cuts grows with the input
    out = src.join(cut.hint("merge"), src["_ld_key"].eqNullSafe(cut["_ld_doc"]) & (src["_ld_hash"] == cut["_ld_cut"]), "left")
    out = out.withColumn("_ld_lines", F.split(F.col(f"`{text}`"), "\n", -1))
    out = out.withColumn("_ld_real", F.expr(r"filter(transform(_ld_lines, (x, i) -> struct(i as i, x as x)), y -> y.x rlike '\\S').i"))
    gone = F.expr("flatten(transform(_ld_runs, r -> slice(_ld_real, r.begin + 1, r.len)))")
    out = out.withColumn("_ld_gone", F.array_distinct(F.coalesce(gone, F.expr("cast(array() as array<int>)"))))
    # the difference of two arrays is taken by a hash set, so long texts with many cuts stay linear
    rest = F.expr("array_join(transform(array_except(sequence(0, size(_ld_lines) - 1), _ld_gone), i -> _ld_lines[i]), '\n')")
    left = F.size("_ld_real") - F.size("_ld_gone")
    new = F.when(F.size("_ld_gone") == 0, F.col(f"`{text}`")).when(left == 0, F.lit("")).otherwise(rest)
    return out.select(
        *(new.alias(c) if c == text else F.col(f"`{c}`") for c in kept),
        F.greatest(F.size("_ld_real"), F.lit(0)).cast("long").alias("n_lines"),
        F.size("_ld_gone").cast("long").alias("n_cut"),
    )
