from __future__ import annotations

import random

import numpy as np

from apilens.llm import ngram_join as J
from apilens.llm.components import components
from tests_ngram import brute


def made(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [[r.choice(words) for _ in range(n)] for n in (5, 6, 7, 8, 9, 12, 20, 40, 90, 200) for _ in range(4)]
    shared = [r.choice(words) for _ in range(60)]
    texts = []
    for b in base:
        texts.append(b)
        for _ in range(r.randint(0, 6)):
            c = b[:]
            for _ in range(r.randint(0, max(1, len(b) // 25))):
                at = r.randrange(len(c))
                c[at : at + r.randint(0, 1)] = [r.choice(words)]
            texts.append(c)
    texts += [shared + [r.choice(words) for _ in range(r.randint(0, 30))] for _ in range(25)]
    rows = [(i * 3 % 1009, " ".join(t)) for i, t in enumerate(texts)]
    rows += [(2001, None), (2002, ""), (2003, " \n"), (2004, "One"), (2005, "one"), (2006, "one two"), (None, rows[0][1]), (None, "nobody else says this at all"), rows[3], (2007, "É a b c d"), (2008, "é a b c d")]
    r.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = made(seed)
        got = J.ngram_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_hot_lists_cells_and_collisions(spark, monkeypatch):
    """With few tokens, small cells and hot keys everywhere, and no leaders but the first, the result stays the same."""
    from apilens.llm import common

    rows = made(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    monkeypatch.setattr(common, "HOT_ROWS", 1)
    monkeypatch.setattr(J, "CELL", 3)
    got = J.ngram_components(df, rounds=1)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_clash_counts_shingles_that_share_a_token(spark):
    text = " ".join(f"w{i}" for i in range(400))
    rows = spark.createDataFrame([(4, text)], "at long, text string")
    low = len(np.unique(J.shingles(text).astype(np.uint32)))
    for buckets in (1, 7):
        got = [r for r in J._postings(rows, np.zeros(0, np.uint64), 0, 75, buckets).collect() if r.node is not None]
        assert [(r.node, r.n) for r in got] == [(4, 396)] and 0 <= got[0].clash <= 396 - low + 396


def test_very_long_text(spark):
    r = random.Random(8)
    long = " ".join(r.choice("abcdefghijkl") * r.randint(1, 9) for _ in range(120_000))
    rows = [(1, long), (2, long + " and more"), (3, "short text that is not like it at all")]
    got = J.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.component_id) for x in got) == [(1, 1), (2, 1), (3, 3)]


def test_empty_table_and_clashing_columns(spark):
    assert J.ngram_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    odd = spark.createDataFrame([(1, "a b c d e f", 1, "t"), (2, "A b c d e f", 2, "u")], "doc_id long, text string, n int, token string")
    assert sorted(tuple(r) for r in J.ngram_components(odd).collect()) == [(1, 2, 1), (2, 2, 1)]


def test_group_of_near_copies_without_all_pairs(spark):
    words = [f"x{i}" for i in range(120)]
    rows = [(i, " ".join(words[: i % 118] + [f"own{i}"] + words[i % 118 :])) for i in range(300)]
    got = J.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.component_id for r in got.collect()} == {0}


def test_hashes_of_chunks_agree(monkeypatch):
    text = "alpha beta  gamma\tdelta " * 500
    whole = J.shingles(text)
    monkeypatch.setattr(J, "CHUNK", 37)
    assert np.array_equal(whole, J.shingles(text))


def test_prefixes_of_linked_sets_share_enough():
    r = random.Random(5)
    for _ in range(300):
        n = r.randint(1, 300)
        x = set(r.sample(range(10_000), n))
        y = set(x)
        for e in r.sample(sorted(x), r.randint(0, n // 8)):
            y.discard(e)
        y |= set(r.sample(range(20_000, 30_000), r.randint(0, n // 8)))
        both = len(x & y)
        if 100 * both < 75 * len(x | y):
            continue
        need, k = J.overlap(len(x), len(y), 75), J.common(min(len(x), len(y)))
        assert both >= need
        px, py = (set(sorted(s)[: len(s) - need + k]) for s in (x, y))
        assert len(px & py) >= min(k, both)
        assert len(x) - need + k <= max(J.prefix_length(len(x), 75), 0) or J.prefix_length(len(x), 75) == len(x)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (200, 201), (201, 200)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_parities_never_exceed_the_difference():
    g = np.random.default_rng(6)
    for _ in range(200):
        x, y = (np.unique(g.integers(0, 1 << 60, g.integers(0, 120)).astype(np.uint64)) for _ in range(2))
        x = np.unique(np.concatenate([x, y[: len(y) // 2]]))
        bits = sum(((a ^ b) & ((1 << 64) - 1)).bit_count() for a, b in zip(J.parities(x), J.parities(y), strict=True))
        assert bits <= len(np.setxor1d(x, y))
