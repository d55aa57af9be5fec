"""The stored web: pages and assets as Parquet tables, redirects, caches."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from apilens import policy
from apilens.functions import urls


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``; where it is unset, a temporary one if all runs in one process, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "apilens-checkpoints")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage is cut, executors may be lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/apilens/level-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Raw pages as documents of their own sites: site_id, url, kind, body."""
    return spark.read.parquet(path).select(F.col("page_id").cast("string").alias("site_id"), "url", F.lit("html").alias("kind"), F.col("html").cast("binary").alias("body"))


def readable(store: DataFrame, most: int = policy.MAX_BODY) -> DataFrame:
    """Documents that came back well and aren't too large; the filters reach the scan."""
    return store.filter(F.col("status").between(200, 299) & F.col("body").isNotNull() & (F.octet_length("body") <= most))


def fetchable(addresses: DataFrame, url_col: str = "url", allow_private: bool = False) -> DataFrame:
    """Typed addresses with a scheme, those that policy forbids left out."""
    typed = addresses.withColumn(url_col, urls.with_scheme(F.col(url_col)))
    return typed.filter(F.col(url_col).isNotNull() & urls.is_allowed(F.col(url_col), allow_private))


def resolved_redirects(starts: DataFrame, redirects: DataFrame, hops: int = 10, allowed: Callable[[Column], Column] | None = None) -> DataFrame:
    """(start, url, hops, final): where addresses lead over (url, location), ``hops`` redirects at most.

    A location is joined to the address that answered with it; addresses are
    compared and returned in one spelling (``urls.absolute``). Names without
    ``://`` are followed as they stand. Not final are chains that go on
    after ``hops`` requests, those whose location can't be joined, and those that
    reach an address that ``allowed`` forbids (checked before each request, the
    start's included).
    """
    spelt = F.coalesce(urls.absolute(F.col("url")), F.col("url"))
    moves = redirects.select(spelt.alias("url"), F.col("location").alias("_to")).filter("_to IS NOT NULL")
    at = starts.select(F.col("url").alias("start"), spelt.alias("url"), F.lit(0).alias("hops"))
    barred = ~F.coalesce(allowed(F.col("url")), F.lit(False)) if allowed else F.lit(False)
    target = F.when(F.col("url").contains("://"), urls.joined(F.col("url"), F.col("_to"))).otherwise(F.col("_to"))
    done = None
    for _ in range(hops):
        step = checkpointed(at.join(moves, "url", "left").select("start", "url", "hops", "_to", barred.alias("_barred"), target.alias("_next")))
        on = ~F.col("_barred") & F.col("_next").isNotNull()
        ended = step.filter(~on).select("start", "url", "hops", (~F.col("_barred") & F.col("_to").isNull()).alias("final"))
        done = ended if done is None else done.unionByName(ended)
        at = step.filter(on).select("start", F.col("_next").alias("url"), (F.col("hops") + 1).alias("hops"))
        if at.isEmpty():
            return done
    last = at.withColumn("final", F.lit(False))
    return last if done is None else done.unionByName(last)


def fresh(cache: DataFrame, now, ttl_s: int = policy.FRESH_S) -> DataFrame:
    """Cached rows younger than ``ttl_s``; the filter is on the stored column, so it reaches the scan."""
    return cache.filter(F.col("fetched_at") > now - F.expr(f"INTERVAL {ttl_s} SECONDS"))


def write_results(results: DataFrame, path: str, by: tuple[str, ...] = ("revision",)) -> None:
    """Results by revision, so that a later lookup reads one partition."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
