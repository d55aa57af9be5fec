"""DataFrame operators: against DuckDB, against the kernels, and edge cases."""

from __future__ import annotations

import json

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__
from apilens import __main__ as command_line
from apilens import sql
from apilens.functions import classify as K
from apilens.functions import frameworks as KF
from apilens.functions import shapes, urls
from apilens.kernels import classify, frameworks, urlx
from apilens.operators import crawl, finalize, grep, render, reuse, scan
from apilens.plans import queries
from apilens.sources import store
from apilens.streaming import ingest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def ordered(columns, rows):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted(repr(tuple(r[i] for i in at)) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_like_duckdb(spark, sf, duck, name):
    df = queries.QUERIES[name](spark, sf)
    want = duck.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert ordered(df.columns, [tuple(r) for r in df.collect()]) == ordered(columns, want.fetchall())


def test_every_query_is_registered(spark):
    assert set(queries.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


PIECES = st.lists(st.sampled_from(["/", "a", "ab", "abc", "-", "_", "1", "12345", ".", ".js", ".PNG", ".json", ".d.ts", "?", "#", "=", "&", "{dynamic}", "api", "graphql", "http://", "https://", "h.example", "%3C", "%27", " ", "é", "home", "src", "node_modules", "_next", "[id]", "$", ":", "(g)", "@s", "(..)", "_payload.json", "x.rsc", "_rsc", "\\"]), max_size=9).map("".join)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(PIECES, min_size=120, max_size=200))
def test_columns_like_kernels(spark, texts):
    s = F.col("s")
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = df.select("s", K.is_url_like(s).alias("url"), K.is_api_candidate(s).alias("api"), K.is_client_route(s).alias("route"), K.query_keys(s).alias("keys"), K.api_url(s).alias("bare"), KF.asset_kind(s).alias("kind"), KF.app_route(s).alias("app")).collect()
    for r in got:
        assert (r.url, r.api, r.route) == (classify.is_url_like(r.s), classify.is_api_candidate(r.s), classify.is_client_route(r.s)), r.s
        assert (r["keys"] or []) == classify.query_keys(r.s) and r.bare == classify.api_url(r.s), r.s
        assert r.kind == frameworks.asset_kind(r.s), r.s
        if r.s.startswith("/"):
            assert r.app == frameworks.app_route(r.s), r.s


@pytest.mark.parametrize("name", ["q09_api_shapes", "q10_axios_bodies", "q14_demote", "q16_api_surface", "q36_grep_cap_summary"])
def test_documents_are_scanned_once(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    df.collect()
    assert df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("MapInArrow") == (0 if "grep" in name else 1)


def test_finalize_demotes_and_merges(spark):
    shape = "struct<methods: int, has_body: boolean, has_headers: boolean, content_types: int, auth: boolean, next_server_action: boolean, query_params: array<string>>"
    rows = [
        ("s", 1, "/a/", "route", "literal", None, None), ("s", 2, "/b", "api", "api_call", None, (1, False, False, 0, False, False, ["q"])), ("s", 3, "/b", "api", "api_call", None, (2, True, False, 1, False, False, ["p", "q"])),
        ("s", 4, "/b", "route", "literal", None, None), ("s", 5, "/b", "candidate", "literal", None, None), ("s", 6, "/c", "candidate", "literal", None, None), ("s", 7, "/c?x#y", "route", "literal", None, None), ("t", 8, "/b", "route", "literal", None, None), ("s", 9, "/a", "route", "literal", "nuxt", None),
    ]
    got = finalize.finalize(spark.createDataFrame(rows, f"site_id string, seq int, url string, kind string, channel string, framework string, shape {shape}"), ["site_id"])
    assert sorted((r.site_id, r.url, r.kind, r.framework or "") for r in got.collect()) == [("s", "/a", "route", ""), ("s", "/a", "route", "nuxt"), ("s", "/b", "api", ""), ("s", "/c", "candidate", ""), ("t", "/b", "route", "")]
    api = finalize.api_surface(got, ["site_id"]).collect()[0]
    assert (api.path, api.methods, api.flags, api.shape.query_params) == ("/b", "GET,POST", "body,json,query", ["p", "q"])


def test_scan_passes_over_bad_documents(spark):
    docs = spark.createDataFrame([("s", "https://h.example/", "html", None), ("s", "nowhere", "html", b"x"), ("s", "https://h.example/a.js", "script", b"var a"), ("s", "https://h.example/b.js", "script", b"fetch('/one/two')"), ("s", None, "html", b"x"), ("s", "https://h.example/", "odd", b"x")], "site_id string, url string, kind string, body binary")
    got = scan.scan_documents(docs)
    assert {r.url for r in scan.evidence(got).collect()} == {"/one/two"}
    assert scan.scan_documents(docs.limit(0)).count() == 0


def test_crawl_depth_caps_and_warnings(spark):
    root = [("s", "https://h.example/", b'<script src="/c0.js"></script><script src="/vendor1.js"></script><script src="/vendor2.js"></script><script src="/gone.js"></script>')]
    chain = [("s", f"https://h.example/c{i}.js", 200, f'import("./c{(i + 1) % 7}.js");fetch("/deep/{i}/end")'.encode()) for i in range(7)]
    chain += [("s", "https://h.example/vendor1.js", 200, b"fetch('/v/one')"), ("s", "https://h.example/vendor2.js", 403, None)]
    roots, files = spark.createDataFrame(root, "site_id string, url string, body binary"), spark.createDataFrame(chain, "site_id string, url string, status int, body binary")
    got = crawl.crawl(roots, files)
    stats = got.stats.collect()[0]
    assert (stats.discovered, stats.failed, stats.unauthorized, stats.capped) == (10, 2, 1, False)
    assert {f"/deep/{i}/end" for i in range(7)} <= {r.url for r in got.evidence.filter("kind = 'api'").collect()}
    assert [r.warning for r in render.warnings(got.stats).collect()] == ["failed to read 2 assets (1 auth-gated, 1 other); results may be incomplete"]
    low = crawl.crawl(roots, files, max_low=1)
    assert low.stats.collect()[0].discovered == 10 and "/v/one" in {r.url for r in low.evidence.collect()}
    few = crawl.crawl(roots, files, max_assets=2).stats.collect()[0]
    assert few.capped and few.discovered == 2


def test_grep_native_like_kernel(spark):
    texts = ["aa\naaa\n", "é a\n\na", "", "b", "a" * 7, "x\na\\Ea"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    for pattern in ("a", "aa", "\n", "a\\E", "\na"):
        one = sorted(map(tuple, grep.grep_native(df, pattern, ["id"], "body").collect()))
        two = sorted((r.id, r["at"], r.line, r.col) for r in grep.grep(df, pattern, ["id"]).collect())
        assert one == two, pattern


def test_render_and_reuse(spark):
    apis = spark.createDataFrame([("s", "/users", "GET", "query"), ("s", "/users/:id", "DELETE,PATCH", ""), ("s", "/a‮b", "POST", "body,json")], "site_id string, path string, methods string, flags string")
    text = [r.text for r in render.rendered(apis, ["site_id"]).orderBy("group", "path").collect()]
    assert text == ["/a\\u{202e}b  POST  · body json", "/users  GET      · query", "  /:id  DEL PAT"]
    assert spark.range(1).select(render.format_duration(F.lit(1500)), grep.format_bytes(F.lit(2048))).first()[:] == ("1.5ms", "2.0KB")
    line = render.stats_line(F.lit(5), F.lit("fresh"), F.lit(7), F.lit("Nuxt"), F.lit(2))
    assert spark.range(1).select(line).first()[0] == "5µs  cache=fresh(7s)  framework=Nuxt  apis=2"
    docs = spark.createDataFrame([(1, "fetch('/x1/y')"), (2, "fetch('/x1/y')"), (3, "nothing")], "id long, body string")
    assert sorted(r.id for r in reuse.scan_distinct(docs, "id", "body").filter("kind = 'api'").collect()) == [1, 2]
    assert reuse.upserted(docs, docs.filter("id = 1").withColumn("body", F.lit("new")), ["id"]).filter("body = 'new'").count() == 1
    assert [r[0] for r in spark.range(1).select(shapes.confidence(F.lit("literal"), F.lit("nuxt"))).collect()] == ["parsed"]


@pytest.mark.parametrize("url, ok", [("http://8.8.8.8/", True), ("http://127.0.0.1/", False), ("http://[::1]/", False), ("http://[fd00::1]/", False), ("http://[2001:db9::1]/", True), ("ftp://h.example/", False), ("http://a.localhost/", False), ("https://printer.local./", False), ("https://h.example/", True), ("nothing", False)])
def test_address_policy(spark, url, ok):
    assert spark.range(1).select(urls.is_allowed(F.lit(url))).first()[0] is ok


def test_store_and_redirects(spark, tmp_path):
    typed = spark.createDataFrame([("h.example/a",), ("http://10.0.0.1/",), ("gopher://x/",), ("https://k.example/",)], "url string")
    assert sorted(r.url for r in store.fetchable(typed).collect()) == ["https://h.example/a", "https://k.example/"]
    hops = spark.createDataFrame([(f"u{i}", f"u{i + 1}") for i in range(12)], "url string, location string")
    got = {r.start: (r.url, r.hops, r.final) for r in store.resolved_redirects(spark.createDataFrame([("u0",), ("u9",), ("z",)], "url string"), hops).collect()}
    assert got == {"u0": ("u10", 10, False), "u9": ("u12", 3, True), "z": ("z", 0, True)}
    path = f"file://{tmp_path}/cache"
    spark.sql("SELECT 's' AS site_id, 'r1' AS revision, 1 AS x UNION ALL SELECT 's', 'r2', 2").write.partitionBy("revision").parquet(path)
    hit = reuse.revision_hits(spark.createDataFrame([("s", "r2")], "site_id string, revision string"), spark.read.parquet(path)).collect()
    assert [r.x for r in hit] == [2]


def test_scan_documents_of_the_command_line(spark, tmp_path, capsys):
    assert "".join(render.json_document([], [])) == '{"apis":[],"warnings":[]}\n'
    assert "".join(render.text_document([("/a", "/a"), ("/a", "  /b"), ("/c", "/c")])) == "/a\n  /b\n\n/c\n"
    site, gone = "https://h.example/", '<script src="/gone.js"></script>'
    root = f'{gone}<script>fetch("/api/items",{{method:"POST"}});fetch("/users/list")</script>'.encode()
    spark.createDataFrame([("s", site, 200, root)], "site_id string, url string, status int, body binary").write.parquet(f"{tmp_path}/store")
    assert command_line.main(["scan", f"{tmp_path}/store", site, "--json"]) == 0
    out, err = capsys.readouterr()
    got = json.loads(out)
    assert [(x["path"], "POST" in x["methods"]) for x in got["apis"]] == [("/api/items", True), ("/users/list", False)]
    assert len(got["warnings"]) == 1 and got["warnings"][0] in err


def test_native_join_equals_kernel(spark):
    bases = ["https://H.example:443/a/b?q=1#f", "http://u:p@h.example:8080/", "https://h.example", "https://[::1]:80/x/", "not absolute", "https://bad host/"]
    refs = ["", "c", "../c", "/c/./d/..", "//M.example/z", "?p", "#g", "https://o.example/../x", "http:broken", "a?b#c", "é/ü?ñ", "./", "..", "/x:y", "//", "c//d"]

    def known(base, ref):
        try:
            return str(urlx.parse(base).join(ref))
        except urlx.BadUrl:
            return None

    rows = spark.createDataFrame([(b, r, known(b, r)) for b in bases for r in refs] + [(None, "x", None), ("https://h.example/", None, None)], "base string, ref string, known string")
    got = rows.select("base", "ref", "known", urls.joined(F.col("base"), F.col("ref")).alias("got")).collect()
    assert [(r.base, r.ref, r.got) for r in got if r.got != r.known] == []


def test_redirects_join_and_stop(spark):
    base = "https://h.example/a/"
    moves = spark.createDataFrame([(base + "1", "2"), ("https://H.example:443/a/2", "/b"), (base + "p", "http://10.0.0.1/"), (base + "m", "mailto:x"), (base + "n", None)], "url string, location string")
    starts = spark.createDataFrame([(base + x,) for x in "1pmn"] + [("http://localhost/",)], "url string")
    got = {r.start: (r.url, r.hops, r.final) for r in store.resolved_redirects(starts, moves, allowed=urls.is_allowed).collect()}
    assert got == {
        base + "1": ("https://h.example/b", 2, True),
        base + "p": ("http://10.0.0.1/", 1, False),
        base + "m": (base + "m", 0, False),
        base + "n": (base + "n", 0, True),
        "http://localhost/": ("http://localhost/", 0, False),
    }
    ring = spark.createDataFrame([(base + "x", "y"), (base + "y", "x")], "url string, location string")
    assert store.resolved_redirects(starts.limit(0), ring).count() == 0
    assert store.resolved_redirects(ring.select("url").limit(1), ring, 3).collect()[0][1:] == (base + "y", 3, False)


def test_table_functions(spark, sf):
    sql.register(spark, {"pages": f"{sf}/pages.parquet"})
    n = spark.sql("SELECT count(DISTINCT p.page_id, e.url) FROM pages p, LATERAL scan_endpoints(p.html) e WHERE e.kind = 'route'").first()[0]
    assert n > 200
    assert spark.sql("SELECT line, col FROM grep('a\nba', 'a')").collect()[1][:] == (2, 2)
    assert spark.sql("SELECT url FROM scan_assets('https://h.example/', '<script src=x.js>', 'html')").first()[0] == "https://h.example/x.js"


def test_stream_like_batch(spark, tmp_path):
    schema = "site_id string, url string, kind string, body binary, fetched_at timestamp"
    rows = [("s", f"https://h.example/{i % 5}.js", "script", f"fetch('/part/{i % 5}/x')".encode()) for i in range(12)]
    df = spark.createDataFrame(rows, "site_id string, url string, kind string, body binary").withColumn("fetched_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df.write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    ingest.scanned_to(stream, out, str(tmp_path / "state")).awaitTermination()
    raw = spark.read.parquet(out)
    assert raw.filter("channel = 'api_call'").count() == 5
    batch = finalize.finalize(scan.evidence(scan.scan_documents(df.drop("fetched_at"))).drop("doc_url"), ["site_id"])
    pick = lambda d: sorted((r.url, r.kind, r.channel) for r in d.collect())
    assert pick(ingest.current(raw)) == pick(batch)


def test_crawls_over_whole_tables(spark, sf):
    orders, parts = spark.read.parquet(f"{sf}/orders.parquet"), spark.read.parquet(f"{sf}/part.parquet")
    reached = {r.url for r in queries.QUERIES["q49_crawl_closure_orders"](spark, sf).collect()}
    assert {u for u in reached if u[0] == "o"} == {f"o{r.o_orderkey}" for r in orders.collect()}
    sites = queries.QUERIES["q50_crawl_chunks"](spark, sf).collect()
    assert sorted(a for r in sites for a in r.apis.split(",") if a.startswith("/parts/")) == sorted(f"/parts/item-{r.p_partkey}" for r in parts.collect())
