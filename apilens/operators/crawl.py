"""Following a site's assets through a stored document set, level by level."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from apilens import policy
from apilens.functions import frameworks, urls
from apilens.operators import finalize, scan
from apilens.sources.store import checkpointed


@dataclass
class Crawl:
    evidence: DataFrame  # final, by site
    assets: DataFrame  # site_id, url, kind, source, depth, seq, status
    stats: DataFrame  # site_id, discovered, failed, unauthorized, capped


def closure(edges: DataFrame, roots: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(site_id, url, depth): what each site's roots reach over (src, dst), cycles included, at its least depth.

    Semi-naive: each round joins the newest level alone; levels are written to
    the shared folder, so lineage stays short and survives lost executors.
    """
    level = checkpointed(roots.select("site_id", "url").distinct().withColumn("depth", F.lit(0)))
    reached, depth = level, 0
    while not level.isEmpty() and (max_rounds is None or depth < max_rounds):
        depth += 1
        nxt = level.join(edges, level["url"] == edges["src"]).select("site_id", F.col("dst").alias("url")).distinct()
        level = checkpointed(nxt.join(reached, ["site_id", "url"], "left_anti").withColumn("depth", F.lit(depth)))
        reached = reached.unionByName(level)
    return reached


def admitted(found: DataFrame, visited: DataFrame, most: int, most_low: int) -> DataFrame:
    """New assets of one level with their turn and whether they are taken.

    A site's assets are taken up to ``most`` in all, of the low-signal scripts
    up to ``most_low``; low-signal ones beyond count as seen but aren't read.
    """
    path = urls.part(F.col("url"), 3)
    new = finalize.first_assets(found, ["site_id"]).join(visited.select("site_id", "url"), ["site_id", "url"], "left_anti")
    counts = visited.groupBy("site_id").agg(F.count(F.lit(1)).alias("_seen"), F.count_if("low").alias("_low"))
    new = new.join(counts, "site_id", "left").fillna(0, ["_seen", "_low"]).withColumns({"low": frameworks.is_low_signal(F.col("kind"), path), "priority": frameworks.priority(F.col("kind"), F.col("source"), path)})
    site = Window.partitionBy("site_id").orderBy("seq", "url")
    turn = F.row_number().over(site)
    low_turn = F.sum(F.col("low").cast("int")).over(site.rowsBetween(Window.unboundedPreceding, 0))
    placed = new.withColumns({"_turn": turn + F.col("_seen"), "_low_turn": low_turn + F.col("_low")})
    inside = F.col("_turn") <= most
    return placed.withColumns({"inside": inside, "read": inside & ~(F.col("low") & (F.col("_low_turn") > most_low))}).drop("_turn", "_low_turn", "_seen", "_low")


def crawl(roots: DataFrame, store: DataFrame, max_assets: int = policy.MAX_ASSETS, max_low: int = policy.MAX_LOW_SIGNAL) -> Crawl:
    """Scans each site's root document and, without a limit on depth, all assets reached.

    ``roots``: site_id, url, body; ``store``: site_id, url, status, body. Levels
    are synchronous and ordered by priority, then place, so results don't depend
    on timing. Settings of the root's page reach all its assets. A missing
    manifest isn't a failure; 401 and 403 are counted apart.
    """
    documents = roots.select("site_id", "url", F.lit("html").alias("kind"), "body")
    scanned = checkpointed(scan.scan_documents(documents))
    evidence, level = scan.evidence(scanned).withColumn("depth", F.lit(0)), scan.assets(scanned)
    seen = checkpointed(roots.sparkSession.createDataFrame([], "site_id string, url string, kind string, source string, seq int, low boolean, read boolean, depth int"))
    capped = seen.select("site_id").distinct()
    read, depth = None, 0
    while True:
        depth += 1
        found = checkpointed(admitted(level, seen, max_assets, max_low))
        if found.isEmpty():
            break
        capped = capped.unionByName(found.filter("NOT inside").select("site_id").distinct())
        seen = seen.unionByName(found.filter("inside").select("site_id", "url", "kind", "source", "seq", "low", "read").withColumn("depth", F.lit(depth)))
        wanted = found.filter("read").select("site_id", "url", "kind", "priority", "seq")
        got = checkpointed(wanted.join(store.select("site_id", "url", "status", "body"), ["site_id", "url"], "left"))
        read = got.select("site_id", "url", "kind", "status", F.col("body").isNotNull().alias("found")) if read is None else read.unionByName(got.select("site_id", "url", "kind", "status", F.col("body").isNotNull().alias("found")))
        good = got.filter("body IS NOT NULL AND status BETWEEN 200 AND 299 AND octet_length(body) <= %d" % policy.MAX_BODY)
        scanned = checkpointed(scan.scan_documents(good.select("site_id", "url", "kind", "body")))
        order = got.select("site_id", F.col("url").alias("doc_url"), F.row_number().over(Window.partitionBy("site_id").orderBy("priority", "seq", "url")).alias("_place"))
        evidence = evidence.unionByName(scan.evidence(scanned).withColumn("depth", F.lit(depth)))
        nxt = scan.assets(scanned).join(order, ["site_id", "doc_url"])
        level = nxt.withColumn("seq", F.row_number().over(Window.partitionBy("site_id").orderBy("_place", "seq"))).drop("_place")
    ordered = evidence.withColumn("seq", F.struct("depth", "doc_url", "seq")).drop("depth")
    final = finalize.finalize(ordered, ["site_id"])
    stats = roots.select("site_id").distinct().join(seen.groupBy("site_id").agg(F.count(F.lit(1)).alias("discovered")), "site_id", "left")
    if read is not None:
        bad = (~F.coalesce(F.col("found"), F.lit(False)) | ~F.col("status").between(200, 299)) & ~((F.col("kind") == "manifest") & (F.coalesce(F.col("status"), F.lit(404)) == 404))
        stats = stats.join(read.filter(bad).groupBy("site_id").agg(F.count(F.lit(1)).alias("failed"), F.count_if(F.col("status").isin(401, 403)).alias("unauthorized")), "site_id", "left")
    else:
        stats = stats.withColumns({"failed": F.lit(0), "unauthorized": F.lit(0)})
    stats = stats.join(capped.distinct().withColumn("capped", F.lit(True)), "site_id", "left").fillna(0, ["discovered", "failed", "unauthorized"]).fillna(False, ["capped"])
    return Crawl(final, seen, stats)
