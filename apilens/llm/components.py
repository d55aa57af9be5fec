"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apilens.llm.common import HOT_KEYS, discard, hot_join, written

HUB = 100_000  # edges of 16 bytes that may well meet in one task


def _starred(edges: DataFrame, large: bool, rows: int) -> DataFrame:
    """One star step on distinct (u, v), u > v: neighbours are handed to the smallest one."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c")).withColumn("m", F.least("u", "m"))
    if 2 * rows > HUB:  # there may be hubs, whose neighbours mustn't meet in one task
        joined = hot_join(both, least, least.filter(F.col("c") > max(HUB, 2 * rows // HOT_KEYS)), ["u"])
    else:
        joined = both.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node that it reaches.

    Each round is written, so that no plan grows; the number of rounds is
    logarithmic. Hubs are pre-aggregated, their neighbours never collected.
    """
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    print_of = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
    before = print_of(edges)
    while before[0]:
        last, edges = edges, written(_starred(_starred(edges, True, before[0]), False, before[0]), "stars")
        discard(last)
        now = print_of(edges)
        if now == before:
            break
        before = now
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out._scratch = edges._scratch
    return out
