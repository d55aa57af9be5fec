from __future__ import annotations

import re

import corpus_pipeline
import pytest
from apilens.llm import quality_rules as R
from apilens.llm.byte_bpe import VOCABULARY, tokenizer
from apilens.llm.mixing import mix, tempered_weights
from tests_ngram import brute


def test_stages_against_brute_force(spark):
    import public_tokenizers

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    rules = R.learn_rules(docs, spark.read.parquet(f"{d}/labels.parquet"))
    kept = {r.row.doc_id for r in R.judge(docs, rules).filter("kept").collect()}
    first = {}
    for i in sorted(kept):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i] or ""), i)
    left = [(i, rows[i]) for i in sorted(first.values())]
    stay = {i for i, _, c in brute(left) if i == c}
    bpe = tokenizer(public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, d).collect()}
    assert got == {i: len(bpe.encode(rows[i] or "")) // 4 for i in stay}


def test_each_stage_returns_the_columns_of_documents(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "n-gram join", "mixing", "byte BPE"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, d).columns == docs.columns


def test_mixing_decides_the_order_of_the_result(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    want = {r.row.doc_id: r.mix_position for r in mix(docs, tempered_weights(docs)).collect()}
    corpus_pipeline.mixing(spark, docs, d).write.parquet(str(tmp_path / "mixed"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        got = {r.doc_id: r.mix_position for r in corpus_pipeline.byte_bpe(spark, spark.read.parquet(str(tmp_path / "mixed")), d).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == want
    rows = corpus_pipeline.run(spark, d).collect()
    assert sorted(r.mix_position for r in rows) == list(range(len(rows)))
    kept = docs.join(spark.createDataFrame([(r.doc_id,) for r in rows], "doc_id long"), "doc_id")
    shown = {r.mix_position: r.doc_id for r in rows}
    source = {r.doc_id: r.source for r in kept.collect()}
    want = {r.mix_position: r.row.source for r in mix(kept, tempered_weights(kept)).collect()}
    assert {at: source[i] for at, i in shown.items()} == want


A = " ".join(f"a{i}" for i in range(60))
B = " ".join(f"b{i}" for i in range(60))


def test_stages_work_by_row(spark):
    names = ["mix_position", "_sha", "_stay_id", "row", "at", "rid", "name", "component"]
    extra = [f"x-{n}" for n in names]
    rows = [(3, A), (5, A + " more"), (5, B), (None, B + " more"), (7, None), (7, ""), (8, A), (8, A), (9, "lonely words stand here alone " * 3), (None, "lonely"), (None, "lonely"), (11, "c " + "word" * 100_000)]
    df = spark.createDataFrame([(i, t, "en", "s", *extra) for i, t in rows], ["doc_id", "text", "lang", "source", *names])
    near = corpus_pipeline.ngram_join(spark, df, "")
    assert near.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in near.collect()), key=str) == sorted([(3, A), (5, B), (7, None), (7, ""), rows[8], (None, "lonely"), rows[-1]], key=str)
    exact = corpus_pipeline.exact_dedup(spark, df, "")
    assert exact.columns == df.columns
    got = [tuple(r) for r in exact.collect()]
    assert len(got) == 8 and {(r[0], r[1]) for r in got if r[1]} == {(i, t) for i, t in rows if t and i != 8} and sum(not r[1] for r in got) == 1
    assert all(r[4:] == tuple(extra) for r in got)
    laid = corpus_pipeline.mixing(spark, df, "")
    assert laid.columns == df.columns and laid.count() == len(rows)
    for stage in (corpus_pipeline.ngram_join, corpus_pipeline.exact_dedup, corpus_pipeline.mixing):
        assert stage(spark, df.limit(0), "").count() == 0


@pytest.mark.parametrize("stage", [corpus_pipeline.ngram_join, corpus_pipeline.byte_bpe])
def test_stages_first_have_the_executors_collect_what_others_have_left(spark, stage, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "representatives", lambda docs: docs)
    collectors = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(c.getCollectionCount() for c in collectors if c.getName() in ("G1 Old Generation", "MarkSweepCompact"))
    before = full()
    stage(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "")
    assert full() > before
