from __future__ import annotations

import gzip
import hashlib
import zlib

import pytest

from apilens.llm import warc
from apilens.llm.warc import archived, parse_archive, read_archives

BIG, OTHER = "<p>" + "word " * 400, "é" * 700
ROWS = [
    (1, "http://a/x", BIG), (2, "http://a/y\r\nz", BIG), (9, "http://b/", BIG), (3, "http://c/", OTHER), (4, None, "small"), (5, "http://d/", "small"), (6, "http://e/", None), (7, "http://f/", ""),
    (8, "http://g/", "tricky\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nabc"), (9, "http://b/", BIG), (None, "http://h/", BIG), (None, "http://i/", "x" * 1000), (10, "http://j/", "y" * 999), (11, "http://j/", "y" * 999),
]


def test_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/warc"
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(3)
    got = archived(df, path).collect()
    want = []
    for p, _, h in ROWS:
        data = (h or "").encode()
        largest = max((q for q, _, g in ROWS if (g or "") == (h or "") and q is not None), default=None)
        again = len(data) >= 1000 and largest is not None and p != largest
        want.append((p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", largest if again else None, b"" if again else data))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) for r in got), key=str) == sorted(want, key=str)
    assert read_archives(spark, path).count() == len(ROWS)
    files = list((tmp_path / "warc").glob("*.gz"))
    heads = [h for f in files for h, _ in parse_archive(gzip.decompress(f.read_bytes()))]
    ids = {h["warc-record-id"]: h for h in heads}
    assert len(ids) == len(ROWS)
    for f in files:  # a member each: every record can be read from its own offset
        assert f.name.endswith(".warc.gz")
        members, rest = 0, f.read_bytes()
        while rest:
            unpack = zlib.decompressobj(31)
            assert unpack.decompress(rest).startswith(b"WARC/1.1\r\n") and unpack.eof
            members, rest = members + 1, unpack.unused_data
        assert members == len(list(parse_archive(gzip.decompress(f.read_bytes()))))
    assert all(h["warc-refers-to-target-uri"] == ids[h["warc-refers-to"]]["warc-target-uri"] for h in heads if h["warc-type"] == "revisit")
    assert all(h["warc-refers-to"] in ids for h in heads if h["warc-type"] == "revisit")


def test_broken_archive():
    with pytest.raises(ValueError):
        list(parse_archive(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"))


def test_empty_and_clashing(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert archived(empty).count() == 0
    odd = spark.createDataFrame([(1, "http://a/", BIG, "x"), (2, "http://a/", BIG, "y")], "page_id long, url string, html string, payload string")
    assert sorted(r.record_type for r in archived(odd).collect()) == ["response", "revisit"]


def test_very_long_payloads_and_hot_digests(spark, monkeypatch):
    from apilens.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 1)
    long = "0123456789abcdef" * (1 << 20) + "é"  # longer than a member's three length bytes
    df = spark.createDataFrame([(1, "http://a/", long), (2, "http://b/", long), (3, "http://c/", BIG), (4, "http://d/", BIG), (5, "http://e/", BIG)], "page_id long, url string, html string")
    got = {r.page_id: r for r in archived(df).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 5), 4: ("revisit", 5), 5: ("response", None)}
    assert bytes(got[2].payload).decode() == long and len(long) > warc.MEMBER_BYTES
