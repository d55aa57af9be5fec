"""Reusing earlier results: by content, by age, by revision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apilens import policy
from apilens.operators import scan


def content_hash(body: Column) -> Column:
    return F.sha2(body.cast("binary"), 256)


def scan_distinct(docs: DataFrame, id_col: str, body_col: str) -> DataFrame:
    """Evidence per document, each distinct body scanned once: the scan is joined back by content hash."""
    keyed = docs.select(F.col(id_col).alias("id"), content_hash(F.col(body_col)).alias("hash"), F.col(body_col).alias("body"))
    bodies = keyed.select("hash", "body").dropDuplicates(["hash"])
    return keyed.select("id", "hash").join(scan.scan_bodies(bodies, "hash", "body").withColumnRenamed("id", "hash"), "hash").drop("hash")


def cache_action(kind: Column, age_s: Column, by_chunk: Column) -> Column:
    """hit, stale_revalidate, revalidate or miss, by age in seconds (null: not cached)."""
    chunk = (kind == "script") & by_chunk
    return F.when(age_s.isNull(), "miss").when(chunk & (age_s < policy.CHUNK_FRESH_S), "hit").when(chunk & (age_s < policy.CHUNK_STALE_S), "stale_revalidate").when(age_s < policy.FRESH_S, "hit").otherwise("revalidate")


def with_cache_action(assets: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """``assets`` (url, kind) with what to do for each, by a cache table (url, fetched_at, by_chunk)."""
    joined = assets.join(cache.select("url", "fetched_at", "by_chunk"), "url", "left")
    age = now.cast("long") - F.col("fetched_at").cast("long")
    return joined.withColumn("action", cache_action(F.col("kind"), age, F.coalesce("by_chunk", F.lit(False)))).drop("fetched_at", "by_chunk")


def revision_hits(sites: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored results of sites whose revision hasn't changed."""
    return stored.join(sites.filter("revision IS NOT NULL").select("site_id", "revision"), ["site_id", "revision"], "left_semi")


def upserted(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """``stored`` with the rows of ``fresh`` in place of those with the same keys."""
    return stored.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)
