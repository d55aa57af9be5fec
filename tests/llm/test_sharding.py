from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest

from apilens.llm.sharding import permuted, shard


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation(n):
    got = permuted(np.arange(n), n)
    assert sorted(got.tolist()) == list(range(n))
    if n > 60:
        assert (got != np.arange(n)).mean() > 0.9
        assert got.tolist() != permuted(np.arange(n), n, seed=1).tolist()


def test_law_and_slots(spark):
    rows = [(i, "same" if i % 3 else f"t{i}" * (i % 50)) for i in range(500)] + [(None, None), (7, "same"), (7, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = shard(df).collect()
    assert len(got) == len(rows)
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    for s in range(24):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    want = sorted(((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows), key=str)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == want
    again = shard(df.repartition(2)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}


def test_empty_and_clashing(spark):
    assert shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    odd = spark.createDataFrame([(1, "a", "x", 3)], "doc_id long, text string, shard string, _at int")
    assert shard(odd).count() == 1
    long = "é" * 3_000_000
    got = shard(spark.createDataFrame([(1, long)], "doc_id long, text string")).collect()[0]
    assert (got.size, got.text_crc32) == (6_000_008, zlib.crc32(long.encode()))
