"""Scanning documents: one Arrow pass per document set, after native pruning."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apilens import policy, schema
from apilens.kernels import urlx
from apilens.kernels.discover import ASSETS, scan_document
from apilens.kernels.endpoints import LITERALS, scan_endpoints
from apilens.kernels.frameworks import NextConfig

_SHAPE = pa.struct([("methods", pa.int32()), ("has_body", pa.bool_()), ("has_headers", pa.bool_()), ("content_types", pa.int32()), ("auth", pa.bool_()), ("next_server_action", pa.bool_()), ("query_params", pa.list_(pa.string()))])
_SITE = pa.struct([("active", pa.list_(pa.string())), ("primary", pa.string()), ("label", pa.string()), ("revision", pa.string())])
_OUT = pa.schema([
    ("site_id", pa.string()), ("doc_url", pa.string()), ("seq", pa.int32()), ("tag", pa.string()), ("url", pa.string()), ("kind", pa.string()), ("channel", pa.string()),
    ("framework", pa.string()), ("shape", _SHAPE), ("source", pa.string()), ("site", _SITE),
])


def shape_dict(shape) -> dict | None:
    return None if shape is None else {f.name: getattr(shape, f.name) for f in _SHAPE}


def scannable(docs: DataFrame) -> DataFrame:
    """Without scripts that hold nothing to find; a native filter, beneath the Python pass."""
    some = "|".join(sorted({p for p in [LITERALS.pattern.decode(), ASSETS.pattern.decode(), *map(re.escape, ("import(", "new URL(", *policy.DATA_MARKERS, *policy.CONTEXT_MARKERS))]}))
    return docs.filter((F.col("kind") != "script") | F.regexp_like(F.col("body").cast("string"), F.lit(some)))


def scan_documents(docs: DataFrame, parents: bool = False) -> DataFrame:
    """schema.SCANNED rows of (site_id, url, kind, body), and of ``parent`` (a struct of Next settings) on request.

    A document with a null body, an unknown kind or a URL that isn't one gives no rows.
    """
    columns = ["site_id", "url", "kind", F.col("body").cast("binary").alias("body")] + ["parent"] * parents
    rows = scannable(docs.filter("body IS NOT NULL AND kind IN ('html', 'script', 'manifest', 'payload')")).select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                base = urlx.try_parse(row["url"] or "")
                if base is None:
                    continue
                held = row.get("parent")
                config = NextConfig(**{**held, "locales": tuple(held["locales"] or ())}) if held else None
                found = scan_document(row["body"], base, row["kind"], config)
                key = {"site_id": row["site_id"], "doc_url": row["url"]}
                for i, (url, kind, channel, framework, shape) in enumerate(found.findings.rows):
                    out.append(key | {"seq": i, "tag": "evidence", "url": url, "kind": kind, "channel": channel, "framework": framework, "shape": shape_dict(shape)})
                for i, (url, kind, source) in enumerate(found.assets):
                    out.append(key | {"seq": i, "tag": "asset", "url": url, "kind": kind, "source": source})
                site = found.site
                out.append(key | {"seq": 0, "tag": "site", "site": {"active": [f for f in policy.FRAMEWORKS if f in site.active], "primary": site.primary, "label": site.label, "revision": found.revision}})
                if len(out) >= 8192:
                    yield pa.RecordBatch.from_pylist(out, schema=_OUT)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_OUT)

    return rows.mapInArrow(run, schema.SCANNED)


def scan_bodies(docs: DataFrame, id_col: str, body_col: str) -> DataFrame:
    """(id, seq, evidence columns) of bare bodies: the endpoint scan alone. Equal bodies are scanned as often as they come."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(body_col).cast("binary").alias("body")).filter("body IS NOT NULL")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = batch.column(0), [scan_endpoints(x.as_py()).rows for x in batch.column(1)]
            flat = [(i, k, *r) for i, rows_ in enumerate(found) for k, r in enumerate(rows_)]
            at, seq, url, what, channel, framework, shape = zip(*flat, strict=True) if flat else ((),) * 7
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(at, pa.int64())), pa.array(seq, pa.int32()), pa.array(url, pa.string()), pa.array(what, pa.string()), pa.array(channel, pa.string()), pa.array(framework, pa.string()), pa.array([shape_dict(s) for s in shape], _SHAPE)],
                names=["id", "seq", "url", "kind", "channel", "framework", "shape"],
            )

    return rows.mapInArrow(run, f"id {kind}, seq int, {schema.EVIDENCE}")


def evidence(scanned: DataFrame) -> DataFrame:
    return scanned.filter("tag = 'evidence'").select("site_id", "doc_url", "seq", "url", "kind", "channel", "framework", "shape")


def assets(scanned: DataFrame) -> DataFrame:
    return scanned.filter("tag = 'asset'").select("site_id", "doc_url", "seq", "url", "kind", "source")


def sites(scanned: DataFrame) -> DataFrame:
    return scanned.filter("tag = 'site'").select("site_id", "doc_url", "site.*")
