"""Literal text search with line, byte column and context."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apilens import policy
from apilens.sources.store import checkpointed

HITS = "at long, line long, col long, snippet string, shortened boolean, hidden_bytes long, shown_bytes long"


def window(data: bytes, low: int, high: int, at: int, size: int, most: int) -> tuple[int, int]:
    """At most about ``most`` bytes of [low, high) around a match, on character borders."""
    if high - low <= most:
        return low, high
    if size >= most:
        start, end = at, at + most
    else:
        start = max(low, at - (most - size) // 2)
        end = min(high, at + size + (most - size + 1) // 2)
        if start == low:
            end = min(high, start + most)
        elif end == high:
            start = max(low, end - most)
        while start > low and data[start] & 0xC0 == 0x80:
            start -= 1
    while end < high and data[end] & 0xC0 == 0x80:
        end += 1
    return start, end


def grep_bytes(data: bytes, pattern: bytes, context: int = policy.GREP_CONTEXT, most: int | None = policy.GREP_BYTES) -> list[tuple]:
    """(at, line, column, snippet, shortened, hidden bytes, bytes of the context) of every match, from left to right without overlaps."""
    out, starts = [], [0, *(np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1).tolist()]
    at = data.find(pattern) if pattern else -1
    while at >= 0:
        line = int(np.searchsorted(starts, at, "right")) - 1
        low = starts[max(0, line - context)]
        after = line + context + 1
        high = starts[after] if after < len(starts) else len(data)
        start, end = (low, high) if most is None else window(data, low, high, at, len(pattern), most)
        text = data[start:end].decode("utf-8", "replace").rstrip("\n").replace("\n", " ")
        cut = start > low or end < high
        out.append((at, line + 1, at - starts[line] + 1, ("…" if start > low else "") + text + ("…" if end < high else ""), cut, (high - low) - (end - start), high - low))
        at = data.find(pattern, at + len(pattern))
    return out


def grep(docs: DataFrame, pattern: str, keys: list[str], body_col: str = "body", context: int = policy.GREP_CONTEXT, max_bytes: int | None = policy.GREP_BYTES) -> DataFrame:
    """All matches, one row each. Bodies without the literal are pruned by the scan itself, before Python."""
    some = docs.filter(F.col(body_col).cast("string").contains(pattern)).select(*keys, F.col(body_col).cast("binary").alias("_body"))
    needle = pattern.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [grep_bytes(x.as_py(), needle, context, max_bytes) for x in batch.column(len(keys))]
            owner = pa.array([i for i, hits in enumerate(found) for _ in hits], pa.int64())
            parts = list(zip(*(h for hits in found for h in hits), strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(owner) for i in range(len(keys))), *(pa.array(p, k) for p, k in zip(parts, kinds, strict=True))], names=[*keys, "at", "line", "col", "snippet", "shortened", "hidden_bytes", "shown_bytes"])

    return some.mapInArrow(run, ", ".join(f"{k} {some.schema[k].dataType.simpleString()}" for k in keys) + ", " + HITS)


def grep_native(docs: DataFrame, pattern: str, keys: list[str], body_col: str) -> DataFrame:
    """Line and byte column of all matches by DataFrame expressions alone: the text between matches, summed up."""
    body = F.col(body_col).cast("string")
    parts = docs.filter(body.contains(pattern)).select(*keys, F.split(body, "\\Q" + pattern.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1).alias("_parts"))
    size = len(pattern.encode())
    lines = pattern.count("\n")
    state = F.struct(F.lit(0).cast("long").alias("at"), F.lit(1).cast("long").alias("line"), F.lit(0).cast("long").alias("bol"), F.expr("cast(array() as array<struct<at:long,line:long,col:long>>)").alias("hits"))

    def step(acc, p):
        end = acc["at"] + F.octet_length(p)
        newlines = F.octet_length(p) - F.octet_length(F.replace(p, F.lit("\n"), F.lit("")))
        bol = F.when(newlines > 0, end - F.octet_length(F.substring_index(p, "\n", -1))).otherwise(acc["bol"])
        line = acc["line"] + newlines
        after = F.when(F.lit(lines > 0), end + size - F.lit(len(pattern.rpartition("\n")[2].encode()))).otherwise(bol)
        hit = F.struct(end.alias("at"), line.alias("line"), (end - bol + 1).alias("col"))
        return F.struct((end + size).cast("long").alias("at"), (line + lines).cast("long").alias("line"), after.cast("long").alias("bol"), F.concat(acc["hits"], F.array(hit.cast("struct<at:long,line:long,col:long>"))).alias("hits"))

    hits = F.aggregate(F.slice(F.col("_parts"), F.lit(1), F.size("_parts") - 1), state, step)
    return parts.select(*keys, F.explode(hits["hits"]).alias("h")).select(*keys, "h.*")


def capped(hits: DataFrame, order: list[str], most: int = policy.GREP_HITS) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` hits in file order (the feature's limit), and one row that counts what isn't shown.

    The limit is a top-k, not a ranking of all hits: what is shown is small and
    is told from the rest by its place. The hits are written once, so that the
    documents are searched once for both.
    """
    hits = checkpointed(hits)
    shown = hits.orderBy(*order, "at").limit(most)
    keys = [*order, "at"]
    marked = hits.join(F.broadcast(shown.select(*keys).withColumn("_shown", F.lit(True))), keys, "left")
    hidden = F.col("_shown").isNull()
    files = F.countDistinct(F.when(hidden, F.struct(*order)))
    counts = marked.agg(
        F.count_if(hidden).alias("hits_not_printed"),
        files.alias("files_with_hits_not_printed"),
        F.count_if(~hidden & F.col("shortened")).alias("snippets_shortened"),
        F.coalesce(F.sum(F.when(hidden, F.col("shown_bytes")).otherwise(F.col("hidden_bytes"))), F.lit(0)).alias("bytes_not_displayed_estimate"),
    )
    return shown, counts


def format_bytes(n):
    """B, KB or MB with one decimal."""
    return F.when(n >= 1 << 20, F.format_string("%.1fMB", n / (1 << 20))).when(n >= 1024, F.format_string("%.1fKB", n / 1024)).otherwise(F.format_string("%dB", n))


def printed(hits: DataFrame, url_col: str = "url") -> DataFrame:
    return hits.select(F.format_string("%s:%d:%d\t%s", F.col(url_col), "line", "col", "snippet").alias("text"))
