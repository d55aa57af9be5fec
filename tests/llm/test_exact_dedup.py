from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from apilens.llm.exact_dedup import deduplicated, exact_dedup

ROWS = [
    (5, "a  b"), (3, "a b"), (9, "a\tb"), (4, None), (2, ""), (7, "x" * 50), (8, "x" * 50), (1, "x" * 49 + "y"), (10, " a b"), (6, "ab" * 40), (11, "ab" * 40),
    (12, "é😀" * 33), (13, "é😀" * 33), (14, "é😀" * 32 + "éé"), (None, "a b"), (None, "lonely"), (15, "twice"), (15, "twice"),
]


def brute(rows):
    groups = {}
    for i, (d, t) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append((d is None, d, i))
    out = []
    for norm, members in groups.items():
        sha = hashlib.sha256(norm.encode()).hexdigest()
        out += [(d, min(members, key=lambda m: (m[0], m[1] or 0))[1], len(members), sha) for _, d, _ in members]
    return sorted(out, key=str)


def check(spark, **kw):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    got = exact_dedup(df, **kw).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(ROWS)
    kept = {}
    for r in got:
        kept.setdefault(r.text_sha256, []).append(r)
    for rows in kept.values():
        assert sum(r.kept for r in rows) == 1
        assert all(r.doc_id == r.keep_id for r in rows if r.kept)


def test_against_brute_force_over_many_blocks(spark):
    check(spark, block_chars=4)


def test_one_block_each(spark):
    check(spark)


def test_hashes_that_collide_do_not_merge_texts(spark):
    check(spark, block_chars=4, block_hash=lambda b: F.length(b).cast("long"))


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup(empty).count() == 0
    odd = spark.createDataFrame([(1, "a", "n", 4), (2, "a", "n", 5)], "doc_id long, text string, name string, rid int")
    assert sorted((r.doc_id, r.kept) for r in exact_dedup(odd).collect()) == [(1, True), (2, False)]


def test_hot_blocks_and_very_long_texts(spark, monkeypatch):
    from apilens.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 2)
    check(spark, block_chars=4)
    long = "one two  three\n" * 100_000
    got = exact_dedup(spark.createDataFrame([(1, long), (2, long.replace("\n", " ")), (3, long + "!")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == [(1, 1, 2), (2, 1, 2), (3, 3, 1)]


def test_names_do_not_depend_on_how_rows_are_dealt_out(spark):
    from apilens.llm.common import addressed
    from apilens.llm.exact_dedup import identities

    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    one, two = ({(r.text_sha256, r.n_blocks, r.name) for r in identities(addressed(df.repartition(n)), block_chars=4).collect()} for n in (1, 5))
    assert one == two


def test_marked_rows(spark, monkeypatch):
    from apilens.llm import common

    rows = spark.range(200_000).select(F.struct("id").alias("row"), F.col("id").alias("at"))
    ids = spark.createDataFrame([(0,), (1,), (7,), (8,), (32767,), (32768,), (32769,), (199_999,), (7,), (500_000,)], "at long")
    for bound in (common.MARKED, 0):
        monkeypatch.setattr(common, "MARKED", bound)
        assert sorted(r["at"] for r in common.marked(rows, ids).collect()) == [0, 1, 7, 8, 32767, 32768, 32769, 199_999]
        assert common.marked(rows, ids, keep=False).count() == 200_000 - 8


def test_deduplicated_keeps_columns(spark):
    df = spark.createDataFrame([(1, "a", "s"), (2, "a", "s"), (3, None, "t"), (4, "", "t"), (5, "q", "s"), (5, "q", "s")], "doc_id long, text string, source string")
    got = deduplicated(df)
    assert got.columns == df.columns
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a", "s"), (3, None, "t"), (5, "q", "s")]
