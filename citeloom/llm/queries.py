"""The ``opN_`` queries: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm import common, decontaminate, html_extract, langid, linededup, neardup, ngramjoin, periodic, piece, quality, tokencount, topk, turnrepair, urlfilter
from citeloom.llm.sql import ORACLES

# The four rules of the task, then host words that block a URL which no rule covers.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
SPAM_WORDS = "ads ads-track adserver bets bonus casino casino-win cheap-pills free-bets gambling jackpot lottery payday-loan pills poker porn slots spam spam-farm viagra xxx".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """A file of the installed vocabularies, which every executor has at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def url_rules() -> list[urlfilter.Rule]:
    return [urlfilter.host_rule(v, r) for v, r in URL_RULES]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_rules() + [urlfilter.word_rule("block", w) for w in SPAM_WORDS]
    judged = urlfilter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    named = [r.name for r in url_rules()]
    # the contract's rule column has the host rules only; word rules are the method's own verdict
    return judged.select("page_id", "host", "path", F.when(F.col("rule").isin(named), F.col("rule")).alias("rule"), "verdict")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece.encode_texts(docs, tokenizer_path("piece_bpe_32k.model")).select("doc_id", "token_ids", "n_tokens", "round_trip")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = tokencount.count_tokens(docs, tokenizer_path("byte_bpe_50k.json"))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    return counted.select("doc_id", n_bytes, "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = common.crc_fold(F.col("doc_id"), 5) == 0
    labels = table(spark, sf_dir, "labels").where(~held)
    scored = quality.score_texts(docs, quality.train(docs, labels))
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest, (F.col("n_hit") > 0).alias("contaminated"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.similar_groups(table(spark, sf_dir, "documents"))


def op8_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_cut", "text")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = common.crc_fold(F.col("doc_id"), 4) == 2
    model = langid.train(docs.where(~held))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 100 == 0, 10)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    damaged = turnrepair.damaged(rows)
    found = common.condensed(lambda: turnrepair.report(damaged, rows))
    digests = common.materialize(turnrepair.digests(turnrepair.repaired(damaged, found)), turnrepair.ROWS)
    own = found.join(digests.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    audit = F.translate("plan", "UAua", "RRII").alias("audit")
    return own.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", audit, F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic.periodic_runs(periodic.with_planted_runs(docs, "doc_id")).withColumn("_best", periodic.strongest())
    best = [F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")]
    milli = F.floor(1000 * F.col("_best.length") / F.col("_best.period")).alias("exponent_milli")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *best, milli, F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_url_filter, op2_html_extract, op3_sentencepiece, op4_token_counts, op5_quality, op6_decontaminate, op7_ngram_join, op8_embedding_neardup, op9_line_dedup, op10_language_id, op11_topk_search, op12_turn_repair, op13_periodic_runs, pipeline)
}
__all__ = ["ORACLES", "QUERIES"]
