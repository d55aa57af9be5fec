from __future__ import annotations

import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from apilens.llm import mixing
from apilens.llm.mixing import PLACES, mix, mixed, op2_mixing, plan, tempered_weights


def test_plan_keeps_windows_and_lag():
    r = random.Random(1)
    for _ in range(120):
        n = r.randint(1, 8)
        sizes, weights, rows = [r.randint(0, 200) for _ in range(n)], [r.choice([0, 1, 2, 0.5, 7, 0.01]) for _ in range(n)], r.choice([1, 4, 16])
        found = [(slot, phase, i, release, deadline) for i, blocks in enumerate(plan(sizes, weights, rows)) for phase, release, deadline, slot, _ in blocks]
        found.sort()
        assert [x[0] for x in found] == list(range(sum(-(-s // rows) for s in sizes)))
        assert all(release <= slot < deadline for slot, _, _, release, deadline in found)
        left = [-(-s // rows) for s in sizes]
        for phase in sorted({x[1] for x in found}):
            live = [i for i in range(n) if left[i] and weights[i]] or [i for i in range(n) if left[i]]
            share = {i: Fraction(str(weights[i])) or Fraction(1) for i in live}
            total, got = sum(share.values()), Counter()
            for k, x in enumerate((x for x in found if x[1] == phase), 1):
                got[x[2]] += 1
                left[x[2]] -= 1
                assert all(abs(got[i] - k * share[i] / total) < 1 for i in live)


def test_rows_and_positions(spark):
    r = random.Random(2)
    rows = [(i, r.choice(["a"] * 6 + ["b", "c", None]), f"t{i}") for i in range(400)] + [(None, "b", "x"), (5, "a", "t5")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    got = mix(df, {"a": 1.0, "b": 2.0, "c": 1.0}, block_rows=4).select("row.*", *PLACES).collect()
    assert sorted((x.doc_id, x.source, x.text) for x in got if x.doc_id is not None and x.source) == sorted(x for x in rows if x[0] is not None and x[1])
    assert sorted(x.mix_position for x in got) == list(range(len(rows)))
    for x in got:
        assert x.mix_release <= x.mix_slot < x.mix_deadline
    size = Counter((x.source, x.mix_block) for x in got)
    assert max(size.values()) == 4
    order = sorted(got, key=lambda x: x.mix_position)
    by_slot = defaultdict(set)
    for x in order:
        by_slot[x.mix_slot].add((x.source, x.mix_block))
    assert all(len(v) == 1 for v in by_slot.values())
    weighted = [x.mix_position for x in got if x.source in ("a", "b", "c")]
    assert min(x.mix_position for x in got if x.source is None) > max(weighted)


def test_layout_empty_and_clashing(spark):
    names = ["mix_slot", "mix_position", "_drawn", "_source", "_first", "_phase", "_at", "_p", "row", "at", "rank", "block", "of", "a.b"]
    rows = [(i if i % 7 else None, "s%d" % (i % 3), *[f"{n}{i}" for n in names]) for i in range(50)] + [(1, "s1", *["again"] * len(names))] * 2
    df = spark.createDataFrame(rows, ["doc_id", "source", *names])
    got = mixed(df, {"s0": 3, "s1": 1}, block_rows=2)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str)
    assert sorted((tuple(r.row) for r in mix(df, block_rows=2).collect()), key=str) == sorted(rows, key=str)
    assert mix(df.limit(0)).count() == 0 and mixed(df.limit(0)).count() == 0


def test_layout_is_the_plan(spark, tmp_path):
    df = spark.createDataFrame([(i, "abc"[i % 3 if i % 5 else 0], "x" * (200_000 if i == 7 else i)) for i in range(300)], "doc_id long, source string, text string").repartition(3)
    df.write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    weights = tempered_weights(df)
    assert weights == {s: int(n**0.5) * (1 + k) for k, (s, n) in enumerate(sorted(Counter(r.source for r in df.collect()).items()))}
    mixed(df, weights, block_rows=4).write.parquet(str(tmp_path / "out"))
    want = {r.row.doc_id: r.mix_position for r in mix(df, weights, block_rows=4).collect()}
    got = {r.row.doc_id: r.mix_position for r in mixing.laid_out(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert got == want and sorted(got.values()) == list(range(300))


def test_query_gives_whole_rows_in_unequal_shares(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = op2_mixing(spark, sf).collect()
    assert sorted((r.doc_id, r.text, r.source) for r in rows) == sorted((r.doc_id, r.text, r.source) for r in docs.collect())
    assert len(set(tempered_weights(docs).values())) > 1
    assert [r.mix_position for r in rows] == list(range(len(rows)))


def test_too_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 3)
    with pytest.raises(ValueError):
        mix(spark.createDataFrame([(i, f"s{i}") for i in range(9)], "doc_id long, source string"))


def test_blocks_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_BLOCKS", 10)
    got = mix(spark.createDataFrame([(i, "ab"[i % 2]) for i in range(400)], "doc_id long, source string"), block_rows=4).collect()
    assert max(Counter((r.row.source, r.mix_block) for r in got).values()) == 40 and sorted(r.mix_position for r in got) == list(range(400))


@pytest.mark.parametrize("weights, blocks", [
    ([1] * 3, 40_000), ([1] * 6, 20_000), ([1] * 21, 6_000), ([0.0001, 0.9999], 120_000), ([1e-9, 1], 120_000), ([0.1, 0.2, 0.7], 120_000), ([Fraction(1, 3), Fraction(1, 7), Fraction(11, 21)], 120_000), ([2**0.5, 3**0.5, 5**0.5, 0.001], 120_000),
])
def test_lag_against_the_weights_asked_for(weights, blocks):
    asked = [Fraction(str(w)) for w in weights]
    order = sorted((slot, i) for i, own in enumerate(plan([blocks] * len(weights), weights, 1)) for phase, _, _, slot, _ in own if phase == 0)
    assert [t for t, _ in order] == list(range(len(order))) and len(order) >= 100_000
    total, got = sum(asked), [0] * len(weights)
    for k, (_, i) in enumerate(order, 1):
        got[i] += 1
        if k % 97 == 0 or k == len(order):
            assert all(abs(g * total - k * w) < total for g, w in zip(got, asked, strict=True))


def test_rows_of_long_periods(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PIECE_BLOCKS", 8)
    df = spark.createDataFrame([(i, "abc"[i % 3] if i % 10 else None) for i in range(900)], "doc_id long, source string").repartition(3)
    weights = {"a": 2**0.5, "b": 1.0, "c": 1e-9, None: 0.37}
    got = mix(df, weights, block_rows=4).select("row.*", *PLACES).collect()
    assert sorted(x.doc_id for x in got) == list(range(900)) and sorted(x.mix_position for x in got) == list(range(900))
    sources = [None, "a", "b", "c"]
    want = {(sources[i], j): tuple(min(v, 2**63 - 1) for v in x[:4]) for i, own in enumerate(plan([90, 270, 270, 270], [weights[s] for s in sources], 4)) for j, x in enumerate(own)}
    assert {(x.source, x.mix_block): (x.mix_phase, x.mix_release, x.mix_deadline, x.mix_slot) for x in got} == want
