from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from apilens.llm import quality_classifier as C
from apilens.llm import quality_rules as R


def brute_stats(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é😀", "#*", "\n", " ", "\t", "\x0b", "c\n", "a b c d e f g h "]), max_size=80).map(" ".join))
def test_stats_like_brute_force(text):
    assert R.text_stats(text)[:5] == brute_stats(text)


def test_null_and_long_stats():
    assert R.text_stats(None)[:5] == (0, 0, 0, 0, 0)
    text = "one two three four five six seven eight nine " * 5000
    assert R.text_stats(text)[:5] == brute_stats(text)


def test_learned_list_separates():
    g = np.random.default_rng(1)
    x = {"a": g.random(900), "b": g.random(900), "c": g.random(900)}
    bad = ((x["a"] > 0.8) & (x["b"] < 0.5)) | (x["c"] > 0.9)
    rules = R.learn(x, bad)
    hit = np.any([r.covers(x) for r in rules], axis=0)
    assert hit[bad].mean() > 0.85 and hit[~bad].mean() < 0.05
    assert R.learn(x, np.zeros(900, bool)) == []


def test_judge_keeps_rows_and_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rules = R.learn_rules(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    odd = docs.withColumnRenamed("n_chars", "n_words").withColumnRenamed("lang", "stats")
    got = R.judge(odd, rules).select("row.*", "stats", "base_failed", "kept", "rule").collect()
    assert len(got) == docs.count()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    wrong = sum(not r.kept for r in got if labels.get(r.doc_id) == 1 and not r.base_failed)
    assert wrong == 0
    edge = spark.createDataFrame([(1, None), (2, ""), (None, "w " * 30)], "doc_id long, text string")
    assert [r.base_failed for r in R.judge(edge, []).orderBy("row.text").collect()] == [True, True, True]
    assert R.judge(edge.limit(0), rules).count() == 0
    assert R.learn_rules(edge, edge.selectExpr("doc_id", "1 AS quality", "0 AS toxic").limit(0)) == []


def chain_brute(emit, trans):
    n = len(emit)
    total, marginal = 0.0, np.zeros(n)
    for ys in itertools.product((0, 1), repeat=n):
        s = np.exp(sum(emit[i][y] for i, y in enumerate(ys)) + sum(trans[a][b] for a, b in itertools.pairwise(ys)))
        total += s
        marginal += s * np.array(ys)
    return marginal / total, np.log(total)


def test_forward_backward_like_enumeration():
    g = np.random.default_rng(3)
    counts, trans = np.array([1, 4, 0, 3, 6]), g.normal(size=(2, 2))
    emit = g.normal(size=(counts.sum(), 2))
    marginal, pairs, log_z = C.forward_backward(emit, counts, trans)
    at, logs = 0, 0.0
    for n in counts:
        if n:
            want, z = chain_brute(emit[at : at + n], trans)
            assert np.allclose(marginal[at : at + n, 1], want)
            logs += z
        at += n
    assert np.isclose(log_z, logs) and np.isclose(pairs.sum(), sum(max(0, n - 1) for n in counts))


def test_classifier_on_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = C.classify(docs, C.train(docs, labels)).join(labels, "doc_id").collect()
    fold = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.predicted == r.quality for r in fold]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_classifier_edges(spark):
    df = spark.createDataFrame([(1, None, 1.0), (None, "", 2.0), (2, "\n \n", 3.0), (2, "x" * 100_000, 4.0)], "doc_id long, text string, score double")
    model = C.LineCRF.train(["good line here.", "### ### |||"], np.array([1, 0]))
    got = C.classify(df, model).collect()
    assert len(got) == 4 and all(r.score is not None for r in got)
    assert C.classify(df.limit(0), model).count() == 0
    texts = ["a b c.\n" * n for n in (1, 9, 0, 30, 2, 2)] + [None]
    assert list(C._parts(texts, 12)) == [slice(0, 2), slice(2, 3), slice(3, 4), slice(4, 7)] and list(C._parts([])) == []
    one = C.LineCRF.train([], np.zeros(0, int))
    assert one.scores([None, "text"]).shape == (2,)
