"""From raw evidence to results: canonical routes, demotion, compaction, the API surface."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from apilens.functions import classify, shapes, urls


def canonicalised(evidence: DataFrame) -> DataFrame:
    return evidence.withColumn("url", F.when(F.col("kind") == "route", classify.canonical_route(F.col("url"))).otherwise(F.col("url")))


def demoted(evidence: DataFrame, scope: list[str]) -> DataFrame:
    """Without candidates that are APIs, and routes that are APIs or candidates, by URL within the scope; one pass over the evidence."""
    own = Window.partitionBy(*scope, "url")
    held = lambda kind: F.max(F.col("kind") == kind).over(own)
    said = evidence.withColumns({"_api": held("api"), "_candidate": held("candidate")})
    drop = ((F.col("kind") == "candidate") & F.col("_api")) | ((F.col("kind") == "route") & (F.col("_api") | F.col("_candidate")))
    return said.filter(~drop).drop("_api", "_candidate")


def compacted(evidence: DataFrame, scope: list[str], order: str = "seq") -> DataFrame:
    """One row per URL, kind, channel and framework, shapes merged, at its first place."""
    return evidence.groupBy(*scope, "url", "kind", "channel", "framework").agg(F.min(order).alias(order), shapes.merged(F.col("shape")).alias("shape"))


def finalize(evidence: DataFrame, scope: list[str], order: str = "seq") -> DataFrame:
    """Canonical, demoted, compacted. Compaction first merges what is equal, so that demotion joins less."""
    return demoted(compacted(canonicalised(evidence), scope, order), scope)


def by_kind(evidence: DataFrame, scope: list[str], kind: str) -> DataFrame:
    """The map of one kind: URL to merged shape (null but for APIs)."""
    return evidence.filter(F.col("kind") == kind).groupBy(*scope, "url").agg(shapes.merged(F.col("shape")).alias("shape"))


def api_surface(evidence: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, path, shape, methods, flags): APIs by path."""
    found = evidence.filter("kind = 'api' AND shape IS NOT NULL").withColumn("path", urls.surface_path(F.col("url")))
    return found.groupBy(*scope, "path").agg(shapes.merged(F.col("shape")).alias("shape")).withColumns({"methods": shapes.methods_csv(F.col("shape")), "flags": shapes.flags_csv(F.col("shape"))})


def first_assets(assets: DataFrame, scope: list[str], order: str = "seq") -> DataFrame:
    """The first mention of each asset URL keeps kind and source."""
    first = F.min(F.struct(order, "kind", "source")).alias("_f")
    return assets.groupBy(*scope, "url").agg(first).select(*scope, "url", f"_f.{order}", "_f.kind", "_f.source")


def ranked(assets: DataFrame, scope: list[str], order: list[str]):
    return assets.withColumn("rank", F.row_number().over(Window.partitionBy(*scope).orderBy(*order)))
