"""The API surface as text and JSON."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apilens.functions import shapes, urls


def escaped(s: Column) -> Column:
    """Control, bidirectional, zero-width and byte-order characters spelt out."""
    odd = r"[\x00-\x1f\x7f-\x9f\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{feff}]"
    chars = F.transform(F.split(s, "(?<=.)(?=.)|(?<=\\n)|(?=\\n)"), lambda c: F.when(F.regexp_like(c, F.lit(f"(?s)^{odd}$")), F.concat(F.lit("\\u{"), F.lower(F.regexp_replace(F.hex(F.encode(c, "UTF-16BE")), "^0+(?=.)", "")), F.lit("}"))).otherwise(c))
    return F.when(F.regexp_like(s, F.lit(odd)), F.array_join(chars, "")).otherwise(s)


def surface_rows(apis: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, group, place, label, methods, flags): a header for each first segment, then its paths."""
    rows = apis.select(*scope, urls.first_segment(F.col("path")).alias("group"), "path", shapes.short_methods(F.col("methods")).alias("methods"), F.replace("flags", F.lit(","), F.lit(" ")).alias("flags"))
    own = rows.filter(F.col("path") == F.col("group"))
    heads = rows.select(*scope, "group").distinct().join(own.drop("path"), [*scope, "group"], "left").withColumn("path", F.lit("")).fillna("", ["methods", "flags"])
    rest = rows.filter(F.col("path") != F.col("group"))
    both = heads.unionByName(rest)
    label = F.when(F.col("path") == "", escaped(F.col("group"))).otherwise(F.concat(F.lit("  "), escaped(F.when(F.col("path").startswith(F.col("group")), F.expr("substring(path, length(group) + 1)")).otherwise(F.col("path")))))
    return both.select(*scope, "group", "path", label.alias("label"), "methods", "flags")


def rendered(apis: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, group, path, text): lines padded within their group."""
    w = Window.partitionBy(*scope, "group")
    rows = surface_rows(apis, scope).withColumns({"_l": F.max(F.char_length("label")).over(w), "_m": F.max(F.char_length("methods")).over(w)})
    some = (F.col("methods") != "") | (F.col("flags") != "")
    left = F.when(some, F.concat(F.rpad("label", F.col("_l"), " "), F.lit("  "), F.col("methods"))).otherwise(F.col("label"))
    pad = F.repeat(F.lit(" "), (F.col("_m") - F.char_length("methods")).cast("int"))
    text = F.when(F.col("flags") != "", F.concat(left, pad, F.lit("  · "), F.col("flags"))).otherwise(left)
    return rows.select(*scope, "group", "path", text.alias("text"))


def api_json(apis: DataFrame) -> DataFrame:
    """One JSON object per API; lines, so that no task holds a site's whole list."""
    return apis.select(*[c for c in apis.columns if c not in ("path", "methods", "flags", "shape")], "path", F.to_json(F.struct("path", "methods", "flags")).alias("json"))


def format_duration(us: Column) -> Column:
    return F.when(us < 1000, F.format_string("%dµs", us)).when(us < 1_000_000, F.format_string("%.1fms", us / 1000)).otherwise(F.format_string("%.2fs", us / 1_000_000))


def stats_line(elapsed_us: Column, cache: Column, age_s: Column, framework: Column, apis: Column) -> Column:
    """Elapsed time, cache state, framework and count, two spaces between."""
    state = F.when(age_s.isNotNull(), F.format_string("cache=%s(%ds)", cache, age_s)).otherwise(F.concat(F.lit("cache="), cache))
    return F.concat_ws("  ", format_duration(elapsed_us), state, F.concat(F.lit("framework="), framework), F.concat(F.lit("apis="), apis.cast("string")))


def warnings(stats: DataFrame) -> DataFrame:
    """(site_id, warning) of a crawl's counts."""
    total, auth = F.col("failed"), F.col("unauthorized")
    failed = (
        F.when(total == 0, F.lit(None).cast("string"))
        .when(auth == total, F.format_string("%d assets blocked by auth (401/403); scan limited to public bundle surface", total))
        .when(auth > 0, F.format_string("failed to read %d assets (%d auth-gated, %d other); results may be incomplete", total, auth, total - auth))
        .otherwise(F.format_string("failed to read %d assets; results may be incomplete", total))
    )
    capped = F.when(F.col("capped"), F.format_string("stopped after %d discovered assets; results may be incomplete", F.col("discovered")))
    return stats.select("site_id", F.explode(F.array_compact(F.array(failed, capped))).alias("warning"))


def json_document(apis: Iterable[str], warnings: Iterable[str]) -> Iterator[str]:
    """One JSON object of a site, piece by piece: its APIs (objects, in their order) and its warnings."""
    yield '{"apis":['
    for i, api in enumerate(apis):
        yield "," * (i > 0) + api
    yield '],"warnings":[' + ",".join(json.dumps(w, ensure_ascii=False) for w in warnings) + "]}\n"


def text_document(rows: Iterable[tuple[str, str]]) -> Iterator[str]:
    """Lines of (group, text), sorted by group, with an empty line between groups."""
    last = None
    for group, text in rows:
        if last is not None and group != last:
            yield "\n"
        yield text + "\n"
        last = group
