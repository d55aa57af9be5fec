"""python -m apilens scan STORE SITE | grep STORE SITE PATTERN [-C N] [--max-hits N] [--max-bytes-per-hit N] [-a]

STORE is a Parquet table (site_id, url, status, body) of a stored web; SITE is
the address of the site's root in it.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from apilens import policy
from apilens.operators import crawl, finalize, render, scan
from apilens.operators import grep as search


def arguments(args: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="apilens", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    verbs = p.add_subparsers(dest="verb", required=True)
    s = verbs.add_parser("scan")
    g = verbs.add_parser("grep")
    for v in (s, g):
        v.add_argument("store")
        v.add_argument("site")
    s.add_argument("--json", action="store_true")
    g.add_argument("pattern")
    g.add_argument("-C", "--context", type=int, default=policy.GREP_CONTEXT)
    g.add_argument("--max-hits", type=int, default=policy.GREP_HITS)
    g.add_argument("--max-bytes-per-hit", type=int, default=policy.GREP_BYTES)
    g.add_argument("-a", "--all", action="store_true", help="all hits, whole contexts")
    return p.parse_args(args)


def main(args: list[str]) -> int:
    a = arguments(args)
    spark = SparkSession.builder.appName("apilens").getOrCreate()
    store = spark.read.parquet(a.store)
    roots = store.filter((F.col("url") == a.site) & F.col("body").isNotNull()).select("site_id", "url", "body")
    if roots.isEmpty():
        print(f"no document at {a.site}", file=sys.stderr)
        return 2
    if a.verb == "scan":
        found = crawl.crawl(roots, store)
        apis = finalize.api_surface(found.evidence, ["site_id"])
        warnings = [r.warning for r in render.warnings(found.stats).collect()]  # two a site at most
        if a.json:
            rows = render.api_json(apis).orderBy("path").select("json").toLocalIterator()
            sys.stdout.writelines(render.json_document((r.json for r in rows), warnings))
        else:
            rows = render.rendered(apis, ["site_id"]).orderBy("group", "path").select("group", "text").toLocalIterator()
            sys.stdout.writelines(render.text_document(rows))
        for w in warnings:
            print(f"warning: {w}", file=sys.stderr)
        return 0
    assets = scan.assets(scan.scan_documents(roots.select("site_id", "url", F.lit("html").alias("kind"), "body"))).select("site_id", "url", F.col("seq") + 1)
    files = roots.select("site_id", "url", F.lit(0).alias("place")).unionByName(assets.toDF("site_id", "url", "place").orderBy("place", "url").limit(policy.MAX_ASSETS))
    docs = files.join(store.select("site_id", "url", "body"), ["site_id", "url"])
    hits = search.grep(docs, a.pattern, ["place", "url"], "body", a.context, None if a.all else a.max_bytes_per_hit)
    if a.all:
        shown, counts = hits.orderBy("place", "at"), None
    else:
        shown, counts = search.capped(hits, ["place", "url"], a.max_hits)
        shown = shown.orderBy("place", "at")
    n = 0
    for r in search.printed(shown).toLocalIterator():
        print(r[0])
        n += 1
    if counts is not None and (c := counts.first()).hits_not_printed:
        print(f"{c.hits_not_printed} more hits in {c.files_with_hits_not_printed} files", file=sys.stderr)
    return 0 if n else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
