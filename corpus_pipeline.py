"""The corpus pipeline: five stages, each one of the corpus operators, from raw documents to token ids."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.llm import common, decontaminate, langid, linededup, ngramjoin, piece
from citeloom.llm.queries import table, tokenizer_path

#: Whole texts that Python gets at once in a session that runs a stage.
BATCH_ROWS = 500
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@F.pandas_udf(T.BooleanType())
def _has_letter(texts: pd.Series) -> pd.Series:
    return texts.map(langid.has_letter, na_action=None).astype(bool)


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands ``BATCH_ROWS`` rows at most to Python at once, which bounds the memory of workers; a smaller bound stays.

    The setting stays with the session, as a stage's result is computed by whoever writes it.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any language (null text, or no letter in it) go; a missing ``lang`` is filled with the predicted one.

    If no document has a label there is no language to predict: texts alone decide, and ``lang`` stays missing.
    """
    small_batches(spark)
    model = langid.train(docs)
    if not model.langs:
        return docs.where(_has_letter("text")).select(*COLUMNS)
    named = langid.identify(docs, model, lang_pred="_lang", score="_score").where(F.col("_lang") != langid.UNKNOWN)
    return named.withColumn("lang", F.coalesce(F.nullif(F.col("lang"), F.lit("")), "_lang")).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines are cut; a document that is cut as a whole goes."""
    cut = linededup.dedup_lines(docs)
    left = cut.where((F.col("n_cut") == 0) | (F.col("n_cut") < F.col("n_lines")))
    n_chars = F.when(F.col("n_cut") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", n_chars).select(*COLUMNS)


def similar_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id."""
    return ngramjoin.keep_one_per_group(docs).select(*COLUMNS)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any window of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left."""
    small_batches(spark)
    return piece.encode_texts(docs, tokenizer_path("piece_bpe_32k.model")).select("doc_id", "lang", "source", "token_ids", "n_tokens", "round_trip")


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("ngram_join", similar_stage),
    ("decontamination", benchmark_stage),
    ("sentencepiece", piece_stage),
]

#: SQL expresses neither the language model nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage leaves is written and read again, which cuts its lineage.

    What a stage has cut for itself, and the rows that it got, go as soon as its result is written; each run knows its
    own tables only. Those that the last stage reads stay until the driver ends.
    """
    docs, name = table(spark, sf_dir, "documents").select(*COLUMNS), uuid.uuid4().hex
    for i, (_, stage) in enumerate(STAGES[:-1]):
        with common.scope(f"{name}-{i}"):
            left = stage(spark, docs, sf_dir)
        with common.scope(f"{name}-{i}-kept"):
            docs = common.materialize(left)
        common.release(f"{name}-{i}")
        common.release(f"{name}-{i - 1}-kept")
    return STAGES[-1][1](spark, docs, sf_dir)
