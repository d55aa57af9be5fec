"""The engine's queries over the supplied tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from apilens import policy
from apilens.functions import classify, frameworks, shapes, urls
from apilens.operators import crawl, finalize, grep, render, reuse, scan
from apilens.plans import corpora as C
from apilens.plans.corpora import table
from apilens.sources import store

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _evidence(docs: DataFrame, kind: str | None = None) -> DataFrame:
    found = finalize.finalize(scan.evidence(scan.scan_documents(docs)), ["site_id"])
    return found if kind is None else found.filter(F.col("kind") == kind)


def _shown(rows: DataFrame) -> DataFrame:
    s = F.col("shape")
    return rows.select("site_id", "url", shapes.methods_csv(s).alias("methods"), shapes.flags_csv(s).alias("flags"), F.array_join(s["query_params"], ",").alias("params"))


# --- pages -------------------------------------------------------------------

_EXT = "(" + "|".join("\\" + e for e in policy.ROUTE_BAD_EXT) + ")$"


def _route_sql(x: str) -> str:
    """The client-route rules for strings with a leading slash, in DuckDB."""
    path = f"regexp_extract({x}, '^[^?#]*')"
    return f"""({x} = '/' OR (octet_length(encode({x})) BETWEEN 2 AND 512 AND regexp_matches({x}, '^/([^/]|$)') AND regexp_matches({x}, '[0-9A-Za-z]')
      AND NOT regexp_matches({path}, '(?i){_EXT}') AND NOT regexp_matches({x}, '[<>"'' \\n\\r\\t]|%3[cCeE]|%2[27]')
      AND NOT regexp_matches({x}, '^/(api|graphql|trpc|_next|_nuxt|_app|_astro)')
      AND NOT regexp_matches({path}, '^/(home|src|tmp|dev|proc|opfs|vfs)$|^/(ROOT|home|src)/|/node_modules/|/\\.(next|bun)/|/\\.(git|env|staging)|/(proc|dev)/')
      AND NOT regexp_matches({path}, '(?i)\\.(ts|tsx|jsx|vue|svelte|md|mdx|cjs)$|\\.config$|/__delete|/rmx:')
      AND NOT (regexp_matches({path}, '^/*[A-Za-z0-9_\\-!$*+\\\\]{{12,}}/*$') AND regexp_matches({path}, '[_!$*+\\\\]'))
      AND len(list_filter(string_split({path}, '/'), lambda p: p <> '' AND NOT regexp_matches(p, '^[0-9]+$') AND (octet_length(encode(p)) >= 3 OR regexp_matches(p, '[-_]')))) > 0))"""


_PAGE_ROUTES = f"""
raw AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS v FROM pages),
found AS (SELECT page_id, v FROM raw UNION SELECT page_id, regexp_extract(v, '^[^ \\t\\n\\f\\r"''`<>()\\[\\]{{}},;=]*') FROM raw),
routes AS (SELECT DISTINCT page_id, coalesce(nullif(regexp_replace(regexp_extract(v, '^[^?#]*'), '/+$', ''), ''), '/') AS route FROM found WHERE starts_with(v, '/') AND {_route_sql('v')})
"""


def _page_routes(spark, d) -> DataFrame:
    found = scan.scan_bodies(table(spark, d, "pages"), "page_id", "html")
    return finalize.finalize(found, ["id"]).filter("kind = 'route'").select(F.col("id").alias("page_id"), F.col("url").alias("route")).distinct()


@query(f"WITH {_PAGE_ROUTES} SELECT page_id, route FROM routes")
def q01_page_routes(spark, d):
    return _page_routes(spark, d)


@query(f"WITH {_PAGE_ROUTES} SELECT page_id, route, CAST(row_number() OVER (PARTITION BY page_id ORDER BY route) AS BIGINT) AS place FROM routes QUALIFY place <= 5")
def q02_routes_per_page_topk(spark, d):
    w = Window.partitionBy("page_id").orderBy("route")
    return _page_routes(spark, d).withColumn("place", F.row_number().over(w).cast("long")).filter("place <= 5")


@query(f"WITH {_PAGE_ROUTES} SELECT lower(regexp_extract(url, '^[^:]*://([^/?#]*)', 1)) AS host, count(*) AS routes, count(DISTINCT page_id) AS pages FROM routes JOIN pages USING (page_id) GROUP BY 1")
def q03_route_host_rollup(spark, d):
    hosts = table(spark, d, "pages").select("page_id", urls.parsed(F.col("url"))["host"].alias("host"))
    return _page_routes(spark, d).join(hosts, "page_id").groupBy("host").agg(F.count(F.lit(1)).alias("routes"), F.countDistinct("page_id").alias("pages"))


@query("SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) AS scheme, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, CASE WHEN regexp_matches(url, '^[^#]*\\?') THEN regexp_extract(url, '\\?([^#]*)', 1) END AS query, CASE WHEN contains(url, '#') THEN regexp_extract(url, '#(.*)$', 1) END AS fragment FROM pages")
def q04_url_components(spark, d):
    u = F.col("u")
    return table(spark, d, "pages").select("page_id", urls.parsed(F.col("url")).alias("u")).select("page_id", *[u[k].alias(k) for k in ("scheme", "host", "path", "query", "fragment")])


@query("WITH p AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+://[^/?#]*[^?#]*)', 1) AS b, regexp_extract(url, '\\?([^#]*)', 1) AS q FROM pages) SELECT page_id, regexp_replace(b, '/$', '') || CASE WHEN q = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(q, '&')), '&') END AS cache_key FROM p")
def q05_url_cache_key(spark, d):
    return table(spark, d, "pages").select("page_id", urls.cache_key(F.col("url")).alias("cache_key"))


@query("SELECT DISTINCT page_id, regexp_extract(p, '^[^=]*') AS key FROM (SELECT page_id, unnest(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&')) AS p FROM pages) WHERE p <> ''")
def q06_query_params(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(classify.query_keys(F.col("url"))).alias("key"))


# --- calls and clients ---------------------------------------------------------


@query("SELECT CAST(user_id AS VARCHAR) AS site_id, '/api/' || event_type || '/u' || user_id AS url FROM events GROUP BY ALL")
def q07_api_candidates(spark, d):
    body = C.text('x="/api/', F.col("event_type"), "/u", F.col("user_id"), "?k=", F.col("event_id"), '#top"')
    docs = C.documents(table(spark, d, "events"), F.col("user_id"), C.text("https://e.example/", F.col("event_id"), ".js"), "script", body)
    return _evidence(docs, "candidate").select("site_id", "url").distinct()


@query("SELECT CAST(user_id AS VARCHAR) AS site_id, '/shop/' || event_type || '/' || user_id AS url, CAST(count(*) AS BIGINT) AS calls FROM events GROUP BY ALL")
def q08_api_calls(spark, d):
    found = scan.evidence(scan.scan_documents(C.calls(spark, d))).filter("channel = 'api_call'")
    return found.groupBy("site_id", "url").agg(F.count(F.lit(1)).alias("calls"))


_SHAPES = "CASE WHEN bool_or(event_type = 'purchase') THEN 'POST' ELSE 'GET' END AS methods, CASE WHEN bool_or(event_type = 'purchase') THEN 'body,headers,query' ELSE 'query' END AS flags"


@query(f"SELECT CAST(user_id AS VARCHAR) AS site_id, '/shop/' || event_type || '/' || user_id AS url, {_SHAPES}, 'k' AS params FROM events GROUP BY user_id, event_type")
def q09_api_shapes(spark, d):
    return _shown(_evidence(C.calls(spark, d), "api"))


@query("""SELECT CAST(o_custkey AS VARCHAR) AS site_id, '/orders/of-' || o_custkey AS path,
  concat_ws(',', CASE WHEN bool_or(o_orderstatus = 'F') THEN 'GET' END, CASE WHEN bool_or(o_orderstatus = 'O') THEN 'POST' END, CASE WHEN bool_or(o_orderstatus NOT IN ('F', 'O')) THEN 'PUT' END) AS methods,
  CASE WHEN bool_or(o_orderstatus <> 'F') THEN 'body,json' ELSE '' END AS flags FROM orders GROUP BY o_custkey""")
def q10_axios_bodies(spark, d):
    return finalize.api_surface(_evidence(C.axios(spark, d)), ["site_id"]).select("site_id", "path", "methods", "flags")


@query("SELECT CAST(s_nationkey AS VARCHAR) AS site_id, '/vendors/v-' || s_suppkey AS url, 'PUT' AS methods FROM supplier")
def q11_generic_clients(spark, d):
    k = F.col("s_suppkey")
    body = C.text('list.put("/shelf/v-', k, '");', F.lit(" " * 80), 'this.apiClient.put("/vendors/v-', k, '",x)')
    own = C.documents(table(spark, d, "supplier"), F.col("s_nationkey"), C.text("https://g.example/", k, ".js"), "script", body)
    return _shown(_evidence(own, "api")).select("site_id", "url", "methods")


@query("SELECT CAST(c_nationkey AS VARCHAR) AS site_id, '/api/n' || c_nationkey || '/people/p-' || c_custkey AS url, 'DELETE' AS methods FROM customer")
def q12_bindings(spark, d):
    body = C.text('const base="/api/n', F.col("c_nationkey"), '",rest=base+"/people";$fetch(`${rest}/p-', F.col("c_custkey"), '`,{method:"DELETE"});')
    docs = C.documents(table(spark, d, "customer"), F.col("c_nationkey"), C.text("https://b.example/", F.col("c_custkey"), ".js"), "script", body)
    return _shown(_evidence(docs, "api")).select("site_id", "url", "methods")


_PATH = "'/customers/' || lower(c_mktsegment) || '/c-' || c_custkey"


@query(f"SELECT CAST(c_custkey AS VARCHAR) AS site_id, {_PATH} AS url FROM customer")
def q13_router_calls(spark, d):
    found = scan.evidence(scan.scan_documents(C.routers(spark, d)))
    return found.filter("channel = 'route_call'").select("site_id", "url")


@query(f"SELECT CAST(c_custkey AS VARCHAR) AS site_id, {_PATH} AS url, CASE WHEN c_custkey % 3 = 0 THEN 'api' ELSE 'route' END AS kind FROM customer")
def q14_demote(spark, d):
    return _evidence(C.routers(spark, d)).select("site_id", "url", "kind").distinct()


@query(f"SELECT CAST(c_custkey AS VARCHAR) AS site_id, {_PATH} AS url, channel FROM customer, (VALUES ('route_call'), ('literal')) t(channel)")
def q15_compact(spark, d):
    found = finalize.canonicalised(scan.evidence(scan.scan_documents(C.routers(spark, d))))
    return finalize.compacted(found.filter("kind = 'route'"), ["site_id"]).select("site_id", "url", "channel")


@query(f"SELECT '/shop/' || event_type || '/' || user_id AS path, {_SHAPES} FROM events GROUP BY event_type, user_id")
def q16_api_surface(spark, d):
    docs = C.calls(spark, d).withColumn("site_id", F.lit("shop"))
    return finalize.api_surface(_evidence(docs), ["site_id"]).select("path", "methods", "flags")


# --- assets ----------------------------------------------------------------------


@query("SELECT CAST(p_partkey AS VARCHAR) AS site_id, 'https://p.example/static/part-' || p_partkey || '.js' AS url, 'script' AS kind, 'html_script' AS source FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'https://p.example/shop/lib/' || p_size || '.mjs', 'script', 'html_preload' FROM part")
def q17_html_assets(spark, d):
    return scan.assets(scan.scan_documents(C.html_pages(spark, d))).select("site_id", "url", "kind", "source")


_NAMES = ("/_next/static/b{k}/_buildManifest.js", "/x/p{k}.rsc", "/app/main-{k}.MJS", "/img/{k}.png", "/data/{k}/_payload.json?h=1", "/_nuxt/builds/meta/{k}.json")
_KINDS = ("manifest", "payload", "script", None, "payload", "manifest")


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{n.partition('{k}')[0]}' || p_partkey || '{n.partition('{k}')[2]}' AS url, {repr(k) if k else 'CAST(NULL AS VARCHAR)'} AS kind FROM part" for n, k in zip(_NAMES, _KINDS, strict=True)) + ")")
def q18_asset_classify(spark, d):
    named = [C.text(n.partition("{k}")[0], F.col("p_partkey"), n.partition("{k}")[2]) for n in _NAMES]
    return table(spark, d, "part").select(F.explode(F.array(*named)).alias("url")).select("url", frameworks.asset_kind(F.col("url")).alias("kind"))


@query("SELECT CAST(p_size AS VARCHAR) AS site_id, 'https://w.example/lib/' || p_size || '.js' AS url, CAST(count(*) AS BIGINT) AS mentions, CASE WHEN min(p_partkey) % 2 = 0 THEN 'html_script' ELSE 'new_url' END AS source FROM part GROUP BY p_size")
def q19_asset_first_wins(spark, d):
    rows = table(spark, d, "part").select(F.col("p_size").cast("string").alias("site_id"), C.text("https://w.example/lib/", F.col("p_size"), ".js").alias("url"), F.lit("script").alias("kind"), F.when(F.col("p_partkey") % 2 == 0, "html_script").otherwise("new_url").alias("source"), F.col("p_partkey").alias("seq"))
    counts = rows.groupBy("site_id", "url").agg(F.count(F.lit(1)).alias("mentions"))
    return finalize.first_assets(rows, ["site_id"]).join(counts, ["site_id", "url"]).select("site_id", "url", "mentions", "source")


@query("""SELECT p_partkey, CAST(CASE p_partkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 ELSE CASE WHEN p_size % 3 = 0 THEN 5 WHEN p_size % 3 = 1 THEN 8 ELSE 6 END END AS INT) AS priority FROM part""")
def q20_asset_priority(spark, d):
    k = F.col("p_partkey") % 6
    kind = F.when(k == 1, "manifest").when(k == 3, "payload").otherwise("script")
    source = F.when(k == 0, "next_manifest").when(k == 2, "html_script").when(k == 4, "new_url").otherwise("literal")
    path = F.when(F.col("p_size") % 3 == 0, "/x/app-1.js").when(F.col("p_size") % 3 == 1, "/x/vendor.js").otherwise("/x/1.js")
    return table(spark, d, "part").select("p_partkey", frameworks.priority(kind, source, path).alias("priority"))


# --- frameworks --------------------------------------------------------------------

_MARKS = ("__NUXT_DATA__", "__sveltekit_x", "<astro-island>", "__remixContext", "<app-root>", "/_next/static/", "plain")
_FOUND = ("nuxt", "sveltekit", "astro", "remix", "angular", "next", "")


@query("SELECT s_suppkey, CASE s_suppkey % 7 " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(_FOUND)) + " END AS frameworks FROM supplier")
def q21_detect_framework(spark, d):
    marks = F.array(*map(F.lit, _MARKS))
    return table(spark, d, "supplier").select("s_suppkey", F.array_join(frameworks.detected(F.get(marks, (F.col("s_suppkey") % 7).cast("int")), F.lit("/")), ",").alias("frameworks"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS site_id, 'next' AS \"primary\", 'Next.js (build build' || s_suppkey || ')' AS label, 'build' || s_suppkey AS revision FROM supplier")
def q22_next_config(spark, d):
    return scan.sites(scan.scan_documents(C.next_pages(spark, d))).select("site_id", "primary", "label", "revision")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS site_id, 'https://s.example/n' || s_nationkey || '/_next/static/build' || s_suppkey || '/' || a AS url FROM supplier, (VALUES " + ", ".join(f"('{a}')" for a in policy.NEXT_ARTIFACTS) + ") t(a)")
def q23_next_manifests(spark, d):
    return scan.assets(scan.scan_documents(C.next_pages(spark, d))).filter("source = 'next_manifest'").select("site_id", "url")


_NATION = "lower(regexp_replace(n_name, '[^A-Za-z]', '-', 'g'))"


@query(f"SELECT DISTINCT site_id, url FROM (SELECT CAST(n_nationkey AS VARCHAR) AS site_id, unnest(['/' || {_NATION}, '/' || {_NATION} || '/deep-' || n_regionkey, '/' || {_NATION} || '-slot']) AS url FROM nation)")
def q24_app_manifest_routes(spark, d):
    found = scan.evidence(scan.scan_documents(C.app_manifests(spark, d)))
    return found.filter("channel = 'manifest'").select("site_id", "url").distinct()


@query("SELECT CAST(s_suppkey AS VARCHAR) AS site_id, '/shop-' || s_suppkey AS url, 'POST' AS methods, 'body,next-action' AS flags FROM supplier")
def q25_server_actions(spark, d):
    return _shown(_evidence(C.next_pages(spark, d), "api")).select("site_id", "url", "methods", "flags")


@query("SELECT p_partkey, '/shop/p' || p_partkey || '/item' AS route FROM part")
def q26_normalize_app_route(spark, d):
    raw = C.text("/(group)/shop/@modal/(..)p", F.col("p_partkey"), "/(a)/item")
    return table(spark, d, "part").select("p_partkey", frameworks.app_route(raw).alias("route"))


@query("SELECT CAST(p_size AS VARCHAR) AS site_id, '/aisle-' || p_size || '/item-' || p_partkey AS url FROM part")
def q27_flight_routes(spark, d):
    return scan.evidence(scan.scan_documents(C.flights(spark, d))).filter("channel = 'flight'").select("site_id", "url")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS site_id, '/api/v' || s_nationkey || '/stock/of-' || s_suppkey AS url FROM supplier")
def q28_nuxt_endpoints(spark, d):
    return _evidence(C.nuxt_pages(spark, d), "api").filter("framework = 'nuxt'").select("site_id", "url")


@query("SELECT CAST(c_custkey AS VARCHAR) AS site_id, unnest(['/account-' || c_custkey, '/account-' || c_custkey || '/[tab]', '/orders-' || c_custkey || '/[order]']) AS url FROM customer")
def q29_svelte_routes(spark, d):
    found = scan.evidence(scan.scan_documents(C.svelte_pages(spark, d)))
    return found.filter("framework = 'sveltekit' AND kind = 'route'").select("site_id", "url").distinct()


@query("SELECT CAST(c_custkey AS VARCHAR) AS site_id, '/account-' || c_custkey || '/save' AS url, 'POST' AS methods, 'body' AS flags FROM customer")
def q30_svelte_actions(spark, d):
    return _shown(_evidence(C.svelte_pages(spark, d), "api")).select("site_id", "url", "methods", "flags")


@query("SELECT CAST(p_partkey AS VARCHAR) AS site_id, '/parts/' || p_partkey || '/sizes' AS url FROM part")
def q31_angular_maps(spark, d):
    return _evidence(C.angular_pages(spark, d), "api").select("site_id", "url")


@query("SELECT CAST(p_partkey AS VARCHAR) AS site_id, '/_actions/buy-' || p_partkey AS url, 'POST' AS methods, 'body' AS flags FROM part")
def q32_astro_actions(spark, d):
    return _shown(_evidence(C.astro_pages(spark, d), "api")).select("site_id", "url", "methods", "flags")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS site_id, '/vendors/' || s_suppkey || '-shop' AS url FROM supplier")
def q33_remix_data(spark, d):
    found = scan.evidence(scan.scan_documents(C.remix_data(spark, d)))
    return found.filter("framework = 'remix' AND kind = 'route'").select("site_id", "url")


# --- grep ------------------------------------------------------------------------------

_HITS = """
parts AS (SELECT conv_id, turn, string_split(text, 'the') AS p FROM conversations WHERE contains(text, 'the')),
cuts AS (SELECT conv_id, turn, unnest(range(1, len(p))) AS k, p FROM parts),
hits AS (SELECT conv_id, turn, k, array_to_string(p[1:k], 'the') AS before FROM cuts),
placed AS (SELECT conv_id, turn, CAST(octet_length(encode(before)) AS BIGINT) AS "at", CAST(1 + length(before) - length(replace(before, chr(10), '')) AS BIGINT) AS line,
  CAST(1 + octet_length(encode(string_split(before, chr(10))[-1])) AS BIGINT) AS col FROM hits)
"""


@query(f"WITH {_HITS} SELECT * FROM placed")
def q34_grep_hits(spark, d):
    return grep.grep_native(table(spark, d, "conversations"), "the", ["conv_id", "turn"], "text").select("conv_id", "turn", "at", "line", "col")


@query(f"WITH {_HITS} SELECT conv_id, turn, \"at\", line, col, rtrim(string_split(text, chr(10))[line], chr(10)) AS snippet FROM placed JOIN conversations USING (conv_id, turn)")
def q35_grep_context(spark, d):
    found = grep.grep(table(spark, d, "conversations"), "the", ["conv_id", "turn"], "text", context=0, max_bytes=None)
    return found.select("conv_id", "turn", "at", "line", "col", "snippet")


@query(f"WITH {_HITS}, r AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn, \"at\") AS n FROM placed) SELECT CAST(count(*) FILTER (n > 50) AS BIGINT) AS hits_not_printed, CAST(count(DISTINCT (conv_id, turn)) FILTER (n > 50) AS BIGINT) AS files_with_hits_not_printed FROM r")
def q36_grep_cap_summary(spark, d):
    found = grep.grep(table(spark, d, "conversations"), "the", ["conv_id", "turn"], "text")
    return grep.capped(found, ["conv_id", "turn"])[1].select("hits_not_printed", "files_with_hits_not_printed")


# --- crawl, reuse, render -----------------------------------------------------------------

_EDGES = """
e(src, dst) AS (SELECT DISTINCT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem UNION SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey FROM lineitem
  UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'n' || n_nationkey, 'n' || ((n_nationkey + 1) % 25) FROM nation)
"""


def _edges(spark, d):
    item, s, n = table(spark, d, "lineitem"), table(spark, d, "supplier"), table(spark, d, "nation")
    edge = lambda df, a, b: df.select(a.alias("src"), b.alias("dst")).distinct()
    t, c = C.text, F.col
    edges = edge(item, t("o", c("l_orderkey")), t("p", c("l_partkey"))).unionByName(edge(item, t("p", c("l_partkey")), t("s", c("l_suppkey"))))
    return edges.unionByName(edge(s, t("s", c("s_suppkey")), t("n", c("s_nationkey")))).unionByName(edge(n, t("n", c("n_nationkey")), t("n", (c("n_nationkey") + 1) % 25)))


@query(f"WITH RECURSIVE {_EDGES}, r(url) AS (SELECT 'o' || l_orderkey FROM lineitem WHERE l_linenumber = 1 AND l_quantity >= 50 UNION SELECT dst FROM r JOIN e ON r.url = e.src) SELECT 'all' AS site_id, url FROM r")
def q37_crawl_closure(spark, d):
    roots = table(spark, d, "lineitem").filter("l_linenumber = 1 AND l_quantity >= 50").select(F.lit("all").alias("site_id"), C.text("o", F.col("l_orderkey")).alias("url"))
    return crawl.closure(store.checkpointed(_edges(spark, d)), roots).select("site_id", "url")


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS site_id, CAST(4 AS BIGINT) AS discovered, CAST(1 AS BIGINT) AS failed, CAST(0 AS BIGINT) AS unauthorized, false AS capped,
  '/deep/one-' || n_nationkey || ',/deep/three-' || n_nationkey || ',/deep/two-' || n_nationkey AS apis FROM nation""")
def q38_crawl(spark, d):
    n = table(spark, d, "nation")
    k = F.col("n_nationkey")
    roots = n.select(k.cast("string").alias("site_id"), C.text("https://k.example/", k, "/").alias("url"), C.text('<script src="/', k, '/one.js"></script><script src="/', k, '/lost.js"></script>').cast("binary").alias("body"))
    chain = (("one", "two"), ("two", "three"), ("three", "one"))
    files = n.select(k.cast("string").alias("site_id"), F.explode(F.array(*[F.struct(C.text("https://k.example/", k, f"/{a}.js").alias("url"), C.text(f'import("./{b}.js");fetch("/deep/{a}-', k, '")').alias("body")) for a, b in chain])).alias("f"))
    found = crawl.crawl(roots, files.select("site_id", "f.url", F.lit(200).alias("status"), F.col("f.body").cast("binary").alias("body")))
    apis = found.evidence.filter("kind = 'api'").groupBy("site_id").agg(F.array_join(F.array_sort(F.collect_set("url")), ",").alias("apis"))
    return found.stats.join(apis, "site_id").select("site_id", F.col("discovered").cast("long"), F.col("failed").cast("long"), F.col("unauthorized").cast("long"), "capped", "apis")


@query(f"WITH {_PAGE_ROUTES} SELECT page_id, CAST(count(*) AS BIGINT) AS routes FROM routes GROUP BY page_id")
def q39_content_reuse(spark, d):
    found = reuse.scan_distinct(table(spark, d, "pages"), "page_id", "html")
    return finalize.finalize(found, ["id"]).filter("kind = 'route'").select("id", "url").distinct().groupBy(F.col("id").alias("page_id")).agg(F.count(F.lit(1)).alias("routes"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'miss' WHEN event_id % 2 = 0 THEN CASE WHEN age < 86400 THEN 'hit' WHEN age < 2592000 THEN 'stale_revalidate' ELSE 'revalidate' END WHEN age < 300 THEN 'hit' ELSE 'revalidate' END AS action
  FROM (SELECT event_id, CAST(floor(value * 1000) AS BIGINT) AS age FROM events)""")
def q40_cache_actions(spark, d):
    age = F.when(F.col("event_id") % 5 != 0, F.floor(F.col("value") * 1000))
    return table(spark, d, "events").select("event_id", reuse.cache_action(F.when(F.col("event_id") % 2 == 0, "script").otherwise("payload"), age, F.col("event_id") % 2 == 0).alias("action"))


@query(f"""SELECT '/shop/' || event_type || '/' || user_id AS path, '{{"path":"/shop/' || event_type || '/' || user_id || '","methods":"' || methods || '","flags":"' || flags || '"}}' AS json
  FROM (SELECT event_type, user_id, {_SHAPES} FROM events GROUP BY event_type, user_id)""")
def q41_render_json(spark, d):
    docs = C.calls(spark, d).withColumn("site_id", F.lit("shop"))
    return render.api_json(finalize.api_surface(_evidence(docs), ["site_id"])).select("path", "json")


@query(f"""WITH a AS (SELECT user_id, event_type, {_SHAPES} FROM events GROUP BY user_id, event_type),
l AS (SELECT user_id, '  /' || event_type || '/' || user_id AS label, methods, replace(flags, ',', ' ') AS flags FROM a UNION ALL SELECT DISTINCT user_id, '/shop', '', '' FROM a)
SELECT CAST(user_id AS VARCHAR) AS site_id, CASE WHEN methods = '' THEN label ELSE rpad(label, CAST(max(length(label)) OVER (PARTITION BY user_id) AS INT), ' ') || '  ' || rpad(methods, CAST(max(length(methods)) OVER (PARTITION BY user_id) AS INT), ' ') || '  · ' || flags END AS text FROM l""")
def q42_render_groups(spark, d):
    return render.rendered(finalize.api_surface(_evidence(C.calls(spark, d)), ["site_id"]), ["site_id"]).select("site_id", "text")


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS site_id, w AS warning FROM (SELECT s_suppkey, unnest(list_filter([
  CASE WHEN s_suppkey % 4 = 0 THEN NULL WHEN s_nationkey = s_suppkey % 4 THEN (s_suppkey % 4) || ' assets blocked by auth (401/403); scan limited to public bundle surface' ELSE 'failed to read ' || (s_suppkey % 4) || ' assets; results may be incomplete' END,
  CASE WHEN s_suppkey % 3 = 0 THEN 'stopped after 2048 discovered assets; results may be incomplete' END], lambda x: x IS NOT NULL)) AS w FROM supplier)""")
def q43_warnings(spark, d):
    failed = F.col("s_suppkey") % 4
    stats = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("site_id"), F.lit(2048).alias("discovered"), failed.alias("failed"), F.when(F.col("s_nationkey") == failed, failed).otherwise(0).alias("unauthorized"), (F.col("s_suppkey") % 3 == 0).alias("capped"))
    return render.warnings(stats)


@query("""SELECT p_partkey, a || '.' || (p_partkey % 256) || '.' || p_size || '.9' AS host,
  NOT (a IN (0, 10, 127, 224, 250) OR (a = 172 AND p_partkey % 256 BETWEEN 16 AND 31) OR (a = 192 AND p_partkey % 256 = 168) OR (a = 192 AND p_partkey % 256 = 0 AND p_size = 2) OR (a = 169 AND p_partkey % 256 = 254)) AS allowed
  FROM (SELECT p_partkey, p_size, [0, 10, 127, 224, 250, 172, 192, 169, 8, 93][1 + p_partkey % 10] AS a FROM part)""")
def q44_private_address_policy(spark, d):
    first = F.get(F.array(*map(F.lit, (0, 10, 127, 224, 250, 172, 192, 169, 8, 93))), (F.col("p_partkey") % 10).cast("int"))
    host = C.text(first, ".", F.col("p_partkey") % 256, ".", F.col("p_size"), ".9")
    return table(spark, d, "part").select("p_partkey", host.alias("host"), urls.is_allowed(C.text("http://", host, "/x")).alias("allowed"))


@query("SELECT page_id, 'https://' || regexp_extract(url, '://(.*)$', 1) AS typed FROM pages")
def q45_typed_addresses(spark, d):
    return table(spark, d, "pages").select("page_id", urls.with_scheme(F.regexp_extract("url", "(?s)://(.*)$", 1)).alias("typed"))


@query("""WITH RECURSIVE r(start, url, hops) AS (SELECT n_nationkey, n_nationkey, 0 FROM nation UNION ALL SELECT start, url + 1, hops + 1 FROM r WHERE url % 5 <> 4)
  SELECT 'u' || start AS start, 'u' || max(url) AS url, CAST(max(hops) AS INT) AS hops, true AS final FROM r GROUP BY start""")
def q46_redirects(spark, d):
    n = table(spark, d, "nation")
    starts = n.select(C.text("u", F.col("n_nationkey")).alias("url"))
    redirects = n.filter("n_nationkey % 5 <> 4").select(C.text("u", F.col("n_nationkey")).alias("url"), C.text("u", F.col("n_nationkey") + 1).alias("location"))
    return store.resolved_redirects(starts, redirects)


@query("SELECT p_partkey, '/a/c/p' || p_partkey || '/' AS path FROM part")
def q47_clean_path(spark, d):
    return table(spark, d, "part").select("p_partkey", urls.clean_path(C.text("/a//b/../c/./p", F.col("p_partkey"), "/x/..")).alias("path"))


@query("SELECT kind, channel, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'route' AS kind, 'route_call' AS channel FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT 'route', 'literal' FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT 'api', 'api_call' FROM customer WHERE c_custkey % 3 = 0) GROUP BY 1, 2")
def q48_evidence_profile(spark, d):
    return _evidence(C.routers(spark, d)).groupBy("kind", "channel").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH RECURSIVE {_EDGES}, r(url) AS (SELECT 'o' || o_orderkey FROM orders UNION SELECT dst FROM r JOIN e ON r.url = e.src) SELECT 'all' AS site_id, url FROM r")
def q49_crawl_closure_orders(spark, d):
    """The closure from every order, with or without lines."""
    roots = table(spark, d, "orders").select(F.lit("all").alias("site_id"), C.text("o", F.col("o_orderkey")).alias("url"))
    return crawl.closure(store.checkpointed(_edges(spark, d)), roots).select("site_id", "url")


@query("""WITH RECURSIVE own AS (SELECT p_partkey // 100 AS site, p_partkey, p_size FROM part), held AS (SELECT DISTINCT p_size AS s FROM part),
  r(site, s) AS (SELECT site, p_size FROM own UNION SELECT site, CASE WHEN s >= 50 THEN 1 ELSE s + 1 END FROM r JOIN held USING (s)),
  f AS (SELECT site, '/parts/item-' || p_partkey AS url, true AS found FROM own UNION ALL SELECT site, '/sizes/all-' || s, s IN (SELECT s FROM held) FROM r)
  SELECT CAST(site AS VARCHAR) AS site_id, count(*) AS discovered, count(*) FILTER (NOT found) AS failed, CAST(0 AS BIGINT) AS unauthorized, false AS capped, string_agg(url, ',' ORDER BY url) FILTER (found) AS apis FROM f GROUP BY site""")
def q50_crawl_chunks(spark, d):
    """The crawl of the chunk store: a page per part, a site per hundred part keys, each with its own copy of the shared scripts."""
    site = F.floor(F.col("p_partkey") / 100).cast("string")
    pages = table(spark, d, "part").select(site.alias("site_id"), F.col("p_partkey"))
    roots = pages.select("site_id", C.text("https://g.example/", F.col("p_partkey"), "/").alias("url"), C.text('<script src="/part-', F.col("p_partkey"), '.js"></script>').cast("binary").alias("body"))
    chunks, leaf = C.chunk_store(spark, d), pages.select("site_id", C.text("https://g.example/part-", F.col("p_partkey"), ".js").alias("url"))
    sizes = F.transform(F.sequence(F.lit(1), F.lit(50)), lambda k: C.text("https://g.example/size-", k, ".js"))
    shared = pages.select("site_id").distinct().select("site_id", F.explode(sizes).alias("url")).join(chunks, "url")
    found = crawl.crawl(roots, chunks.join(leaf, "url").unionByName(shared))
    apis = found.evidence.filter("kind = 'api'").groupBy("site_id").agg(F.array_join(F.array_sort(F.collect_set("url")), ",").alias("apis"))
    return found.stats.join(apis, "site_id").select("site_id", F.col("discovered").cast("long"), F.col("failed").cast("long"), F.col("unauthorized").cast("long"), "capped", "apis")


@query("""SELECT 'https://R.example:443/shop/' || s_suppkey AS start, CASE s_suppkey % 6 WHEN 0 THEN 'https://r.example/new/' || s_suppkey WHEN 1 THEN 'https://r.example/old/' || s_suppkey || '?v=1'
  WHEN 2 THEN 'https://m.example/' || s_suppkey WHEN 3 THEN 'https://r.example/shop/' || s_suppkey || '?page=2' WHEN 4 THEN 'http://127.0.0.1/' || s_suppkey ELSE 'https://r.example/shop/' || s_suppkey END AS url,
  CAST(CASE WHEN s_suppkey % 6 < 5 THEN 1 ELSE 0 END AS INT) AS hops, s_suppkey % 6 <> 4 AS final FROM supplier""")
def q51_relative_redirects(spark, d):
    """Locations from the root, beside the address, of another host, of a query alone, and of a private address; every sixth has none."""
    k = F.col("s_suppkey")
    forms = F.array(C.text("/new/", k), C.text("../old/./", k, "?v=1"), C.text("//m.example/", k), F.lit("?page=2"), C.text("http://127.0.0.1/", k))
    rows = table(spark, d, "supplier").select(k, F.get(forms, (k % 6).cast("int")).alias("location"))
    redirects = rows.filter("location IS NOT NULL").select(C.text("https://r.example/shop/", k).alias("url"), "location")
    starts = rows.select(C.text("https://R.example:443/shop/", k).alias("url"))
    return store.resolved_redirects(starts, redirects, allowed=urls.is_allowed)
