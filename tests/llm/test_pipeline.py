"""The stages of the corpus pipeline against brute force on a small corpus."""

import random

import corpus_pipeline
from citeloom.llm import common, piece
from citeloom.operators import lineage
from citeloom.llm.queries import tokenizer_path


def test_pipeline(spark, tmp_path):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, clean = text(60), [text(80) for _ in range(6)]
    near = clean[1].split(" ")
    near[40] = "changed"
    item = text(12)
    docs = [(i, t) for i, t in enumerate(clean)] + [(10, clean[0]), (11, " ".join(near)), (12, f"start {text(20)}\n{passage}"), (13, f"{text(70)}\n{passage}\n{text(5)}"), (14, f"{text(20)} {item} {text(20)}"), (15, None), (16, "123 456"), (17, "")]
    rows = [(i, t, "en" if i % 2 else "de", "s", None if t is None else len(t)) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    found = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # 10 is a copy that line dedup takes whole, 11 a near copy, 14 has the benchmark item, 15 to 17 have no language
    assert sorted(found) == [0, 1, 2, 3, 4, 5, 12, 13]
    left = dict(docs) | {13: "\n".join(docs[9][1].split("\n")[::2])}
    c = piece.codec(tokenizer_path("piece_bpe_32k.model"))
    for i, r in found.items():
        assert r["token_ids"] == c.encode([left[i]])[0].tolist() and r["round_trip"] and r["n_tokens"] == len(r["token_ids"])


def test_stages_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:2]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_join", "decontamination", "sentencepiece"]


def test_language_stage_labels(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    unlabelled = [(1, "some words", None, "s", 10), (2, "123", None, "s", 3), (3, None, None, "s", None), (4, "слова", None, "s", 5)]
    out = corpus_pipeline.language_stage(spark, spark.createDataFrame(unlabelled, schema), "").collect()
    assert sorted((r["doc_id"], r["lang"]) for r in out) == [(1, None), (4, None)]
    known = [(10 + i, "слова и дела" if i % 2 else "some more words", "ru" if i % 2 else "en", "s", 12) for i in range(8)]
    out = corpus_pipeline.language_stage(spark, spark.createDataFrame(unlabelled + known, schema), "").collect()
    assert sorted((r["doc_id"], r["lang"]) for r in out) == [(1, "en"), (4, "ru")] + [(k[0], k[2]) for k in known]


def test_condensed_leaves_its_result_only(spark):
    def build():
        return common.materialize(spark.range(1000)).where("id < 3")

    before = {p for _, p, _ in lineage._written}
    out = common.condensed(build)
    assert sorted(r["id"] for r in out.collect()) == [0, 1, 2]
    assert len({p for _, p, _ in lineage._written} - before) == 1
