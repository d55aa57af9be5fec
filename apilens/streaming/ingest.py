"""Documents as a stream: duplicates dropped within a watermark, scanned, merged into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from apilens.operators import finalize, scan


def deduplicated(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each (site, url, content) once within the watermark; state older than that is dropped."""
    keyed = stream.withColumn("content", F.sha2("body", 256)).withWatermark("fetched_at", delay)
    return keyed.dropDuplicatesWithinWatermark(["site_id", "url", "content"]).drop("content")


def scanned_to(stream: DataFrame, path: str, checkpoint: str, delay: str = "1 hour") -> StreamingQuery:
    """Appends raw evidence of new documents to ``path``, a folder per batch, so that a repeated batch replaces itself."""

    def each(batch: DataFrame, number: int) -> None:
        found = scan.evidence(scan.scan_documents(batch.select("site_id", "url", "kind", "body")))
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return deduplicated(stream, delay).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(evidence: DataFrame) -> DataFrame:
    """The finalised evidence of all batches so far, by site."""
    return finalize.finalize(evidence.drop("doc_url", "batch"), ["site_id"])
