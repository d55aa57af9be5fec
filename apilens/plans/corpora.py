"""Documents written from table rows, so that what a scan must find is known from the columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(*parts: Column | str) -> Column:
    """Literals and columns joined."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def c(name: str) -> Column:
    return F.col(name)


def documents(rows: DataFrame, site: Column, url: Column, kind: str, body: Column) -> DataFrame:
    return rows.select(site.cast("string").alias("site_id"), url.alias("url"), F.lit(kind).alias("kind"), body.cast("binary").alias("body"))


def calls(spark: SparkSession, d: str) -> DataFrame:
    """A fetch per event: purchases post a JSON body, the others only ask."""
    post = text("fetch('/shop/", c("event_type"), "/", c("user_id"), "?k=", c("event_id"), "',{method:'POST',headers:{},body:b})")
    get = text("fetch('/shop/", c("event_type"), "/", c("user_id"), "?k=", c("event_id"), "')")
    return documents(table(spark, d, "events"), c("user_id"), text("https://e.example/", c("event_id"), ".js"), "script", F.when(c("event_type") == "purchase", post).otherwise(get))


def axios(spark: SparkSession, d: str) -> DataFrame:
    """A client call per order: read, written or replaced by its status."""
    verb = F.when(c("o_orderstatus") == "F", "get").when(c("o_orderstatus") == "O", "post").otherwise("put")
    return documents(table(spark, d, "orders"), c("o_custkey"), text("https://o.example/", c("o_orderkey"), ".js"), "script", text("axios.", verb, '("/orders/of-', c("o_custkey"), '",{status:"', c("o_orderstatus"), '"})'))


def routers(spark: SparkSession, d: str) -> DataFrame:
    """A page's navigation per customer; every third customer's path is fetched as well, in another script."""
    path = text("/customers/", F.lower(c("c_mktsegment")), "/c-", c("c_custkey"))
    rows = table(spark, d, "customer")
    pushed = documents(rows, c("c_custkey"), text("https://c.example/", c("c_custkey"), ".js"), "script", text('router.push("', path, '")'))
    fetched = documents(rows.filter("c_custkey % 3 = 0"), c("c_custkey"), text("https://c.example/", c("c_custkey"), "-api.js"), "script", text('fetch("', path, '")'))
    return pushed.unionByName(fetched)


def html_pages(spark: SparkSession, d: str) -> DataFrame:
    """A page per part with a script, a preloaded module, the script again, a stylesheet and an image."""
    k = c("p_partkey")
    body = text('<SCRIPT src="/static/part-', k, '.js"></SCRIPT><link rel="modulepreload" href="lib/', c("p_size"), '.mjs"><script src="/static/part-', k, '.js"></script><link rel="stylesheet" href="/s.css"><img src="/img/', k, '.png">')
    return documents(table(spark, d, "part"), k, text("https://p.example/shop/", k), "html", body)


def next_pages(spark: SparkSession, d: str) -> DataFrame:
    """A Next page per supplier with build, base path and locales, and a server action."""
    k = c("s_suppkey")
    body = text('<script id="__NEXT_DATA__" type="application/json">{"buildId":"build', k, '","basePath":"/n', c("s_nationkey"), '","locales":["en","fr"]}</script><input name="$ACTION_ID_', k, '">')
    return documents(table(spark, d, "supplier"), k, text("https://s.example/n", c("s_nationkey"), "/fr/shop-", k), "html", body)


def app_manifests(spark: SparkSession, d: str) -> DataFrame:
    """An app manifest per nation: a page in a group, a nested route, a slot."""
    name = F.lower(F.regexp_replace("n_name", "[^A-Za-z]", "-"))
    body = text('{"pages":{"/(shop)/', name, '/page":["a.js"],"/', name, '/deep-', c("n_regionkey"), '/route":[],"/@side/', name, '-slot/layout":[]}}')
    return documents(table(spark, d, "nation"), c("n_nationkey"), text("https://n.example/_next/static/b", c("n_nationkey"), "/app-build-manifest.json"), "manifest", body)


def flights(spark: SparkSession, d: str) -> DataFrame:
    body = text('self.__next_f.push([1,"0:{\\"href\\":\\"/aisle-', c("p_size"), "/item-", c("p_partkey"), '\\"}\\n"])</script>')
    return documents(table(spark, d, "part"), c("p_size"), text("https://f.example/", c("p_partkey")), "html", text("<script>", body))


def nuxt_pages(spark: SparkSession, d: str) -> DataFrame:
    k = c("s_suppkey")
    body = text('<script>window.__NUXT_DATA__={public:{apiBase:"/api/v', c("s_nationkey"), '"},endpoints:{list:"stock/of-', k, '",icon:"images/of-', k, '"}}</script>')
    return documents(table(spark, d, "supplier"), k, text("https://u.example/", k), "html", body)


def svelte_pages(spark: SparkSession, d: str) -> DataFrame:
    k = c("c_custkey")
    body = text('<div data-sveltekit><form action="/account-', k, '/save"></form><script>x={id:"/account-', k, '/[tab]"};y={pattern:/^\\/orders-', k, '\\/([^/]+?)$/,params:["order"]}</script></div>')
    return documents(table(spark, d, "customer"), k, text("https://v.example/home-", k), "html", body)


def angular_pages(spark: SparkSession, d: str) -> DataFrame:
    body = text('<app-root></app-root><script>endpoints={"one":"/parts/', c("p_partkey"), '/sizes?s=', c("p_size"), '","two":"/pics/', c("p_partkey"), '.png"}</script>')
    return documents(table(spark, d, "part"), c("p_partkey"), text("https://a.example/", c("p_partkey")), "html", body)


def astro_pages(spark: SparkSession, d: str) -> DataFrame:
    body = text('<astro-island component-url="/_astro/Card.', c("p_size"), '.js" renderer-url="/_astro/client.x.js"></astro-island><script>go("/_actions/buy-', c("p_partkey"), '")</script>')
    return documents(table(spark, d, "part"), c("p_partkey"), text("https://t.example/", c("p_partkey")), "html", body)


def remix_data(spark: SparkSession, d: str) -> DataFrame:
    return documents(table(spark, d, "supplier"), c("s_suppkey"), text("https://r.example/vendors/", c("s_suppkey"), "-shop?_data=routes"), "payload", text('{"a":"x"}__remixContext'))


def chunk_store(spark: SparkSession, d: str) -> DataFrame:
    """A script per part that imports its size's shared script; each shared script imports the next, the last the first."""
    parts = table(spark, d, "part")
    own = parts.select(text("https://g.example/size-", c("p_size"), ".js").alias("url"), c("p_partkey"), c("p_size"))
    leaf = own.select(text("https://g.example/part-", c("p_partkey"), ".js").alias("url"), text('import("./size-', c("p_size"), '.js");fetch("/parts/item-', c("p_partkey"), '")').alias("body"))
    ring = parts.select(c("p_size").alias("s")).distinct().select(text("https://g.example/size-", c("s"), ".js").alias("url"), text('import("./size-', F.when(c("s") >= 50, F.lit(1)).otherwise(c("s") + 1), '.js");fetch("/sizes/all-', c("s"), '")').alias("body"))
    return leaf.unionByName(ring).select("url", F.lit(200).alias("status"), F.col("body").cast("binary").alias("body"))
