"""SQL face of the engine: table functions and views.

    from apilens import sql
    sql.register(spark)
    spark.sql("SELECT p.page_id, e.url FROM pages p, LATERAL scan_endpoints(p.html) e WHERE e.kind = 'route'")
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from apilens import policy
from apilens.kernels import urlx
from apilens.kernels.discover import scan_document
from apilens.kernels.endpoints import scan_endpoints
from apilens.kernels.evidence import METHOD_BIT, Shape
from apilens.operators.grep import grep_bytes


def _data(body) -> bytes:
    return body.encode() if isinstance(body, str) else bytes(body or b"")


def methods_csv(shape: Shape | None) -> str | None:
    return None if shape is None else ",".join(m for m, bit in METHOD_BIT.items() if shape.methods & bit)


@udtf(returnType="url string, kind string, channel string, methods string")
class ScanEndpoints:
    """scan_endpoints(body): evidence of bare bytes or text."""

    def eval(self, body) -> Iterator[tuple]:
        for url, kind, channel, _, shape in scan_endpoints(_data(body)).rows:
            yield url, kind, channel, methods_csv(shape)


@udtf(returnType="url string, kind string, channel string, framework string, methods string")
class ScanDocument:
    """scan_document(url, body, kind): evidence with what the document's framework tells."""

    def eval(self, url: str, body, kind: str) -> Iterator[tuple]:
        base = urlx.try_parse(url or "")
        for found, what, channel, framework, shape in scan_document(_data(body), base, kind).findings.rows if base else ():
            yield found, what, channel, framework, methods_csv(shape)


@udtf(returnType="url string, kind string, source string")
class ScanAssets:
    """scan_assets(url, body, kind): what a document refers to."""

    def eval(self, url: str, body, kind: str) -> Iterator[tuple]:
        base = urlx.try_parse(url or "")
        yield from scan_document(_data(body), base, kind).assets if base else ()


@udtf(returnType="line long, col long, snippet string")
class Grep:
    """grep(body, pattern): matches of a literal with their context."""

    def eval(self, body, pattern: str) -> Iterator[tuple]:
        for _, line, col, snippet, *_ in grep_bytes(_data(body), pattern.encode(), policy.GREP_CONTEXT, policy.GREP_BYTES):
            yield line, col, snippet


FUNCTIONS = {"scan_endpoints": ScanEndpoints, "scan_document": ScanDocument, "scan_assets": ScanAssets, "grep": Grep}


def register(spark: SparkSession, tables: dict[str, str] | None = None) -> None:
    """Registers the table functions, and views over Parquet paths by name."""
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)
    for name, path in (tables or {}).items():
        spark.read.parquet(path).createOrReplaceTempView(name)
