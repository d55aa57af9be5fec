"""WARC archives with revisit resolution.

Headers (row, id, digest, size; no payload) are shuffled by payload digest to
find each payload's original and joined to it. Then the archives are written
with fresh headers: revisits from headers alone, responses from the rows that
aren't revisits, each record as a gzip member of its own. Payloads are never
shuffled. Archives are read back by the lengths that headers state.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from apilens.llm.common import addressed, discard, hot_join, hot_over, map_arrow, marked, scratch, table, written

LEAST_BYTES = 1000  # payloads below are never revisits
FILE_BYTES = 24 << 20  # payload bytes of an archive, on average
MEMBER_BYTES = (1 << 24) - 1  # a gzip member's length field ends with a zero byte up to this
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _payload(html_col: str) -> Column:
    return F.coalesce(F.col("row")[html_col], F.lit("")).cast("binary")


def payload_headers(rows: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Of ``rows`` (``row`` and ``at``): at, page_id, url, payload_bytes, payload_digest (SHA-1 in hex); a null payload is empty."""
    payload = _payload(html_col)
    return rows.select("at", F.col("row")[id_col].cast("long").alias("page_id"), F.col("row")[url_col].alias("url"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("payload_digest"))


def revisits(headers: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """The headers of payloads that another record has, with ``original`` (page_id, at, url).

    Counts and originals are pre-aggregated before the shuffle by digest; those
    of digests that very many records share are broadcast.
    """
    large = headers.filter(F.col("payload_bytes") >= least_bytes)
    original = F.max(F.struct("page_id", "at", "url")).alias("original")
    groups = written(large.groupBy("payload_digest").agg(original, F.count(F.lit(1)).alias("n")).filter("n > 1 AND original.page_id IS NOT NULL"), "originals")
    found = hot_join(large, groups, groups.filter(F.col("n") > hot_over(headers.count())), ["payload_digest"]).drop("n")
    return found.filter(~F.col("page_id").eqNullSafe(F.col("original.page_id")))


def _record_id(page_id: Column, at: Column) -> Column:
    """A UUID of the row's record, stable for the same table."""
    h = F.md5(F.concat_ws(":", F.lit("record"), page_id.cast("string"), at.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4"), F.substring(h, 14, 3), F.lit("-8"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def _record(kind: str, date: Column, payload: Column) -> Column:
    """A record's bytes."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    url = lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), r"[\r\n]", "%0A")
    again, original = kind == "revisit", F.col("original")
    head = [
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.lit(kind)),
        line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("at"))),
        line("WARC-Date", date),
        line("WARC-Target-URI", url(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.upper("payload_digest"))),
        line("X-Page-ID", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        line("X-Payload-Bytes", F.col("payload_bytes").cast("string")),
    ]
    if again:
        head += [line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _record_id(original["page_id"], original["at"])), line("WARC-Refers-To-Target-URI", url(original["url"])), line("X-Refers-To-Page", original["page_id"].cast("string"))]
    head += [line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.lit("0") if again else F.col("payload_bytes").cast("string")), F.lit("\r\n")]
    return F.concat(F.concat(*head).cast("binary"), payload, F.lit(b"\r\n\r\n"))


def gzip_member(record: bytes) -> bytes:
    """A gzip member (with an empty one behind, if the record is so long that its length field doesn't end with a zero byte)."""
    out = zlib.compress(record, 6, 31)
    return out if len(record) <= MEMBER_BYTES else out + zlib.compress(b"", 6, 31)


def write_archives(records: DataFrame, path: str, records_per_file: int) -> None:
    """Records (bytes) as archives under ``path``, a gzip member each, through Spark's committed writer.

    Each member ends with a zero byte, which the writer adds as its line end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([gzip_member(x.as_py())[:-1] for x in batch.column(0)], pa.binary())], names=["value"])

    members = map_arrow(records, run, "value binary").select(F.col("value").cast("string"))
    members.write.option("maxRecordsPerFile", records_per_file).option("lineSep", "\0").option("compression", "none").text(path)
    spark = records.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for k, status in enumerate(fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part-*.txt"))):
        fs.rename(status.getPath(), spark._jvm.org.apache.hadoop.fs.Path(folder, f"{k:06d}.warc.gz"))


def records_of(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a gzipped archive, member by member; what is unpacked at once is one member."""
    rest, held = data, b""
    while rest:
        member = zlib.decompressobj(31)
        held += member.decompress(rest)
        if not member.eof:
            raise ValueError("the archive ends within a member")
        rest = member.unused_data
        if held:
            yield from parse_archive(held)
        held = b""


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record, cut by the stated lengths."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        size = int(head["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} has a wrong length")
        yield head, block
        at = end + 8 + size


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to of all archives under ``path``.

    A response's size and digest are those of the block read; a revisit's are
    those its header states.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for head, block in records_of(content.as_py()):
                    kind, number = head["warc-type"], lambda k, head=head: int(head[k]) if head.get(k) else None
                    stated = head["warc-payload-digest"].removeprefix("sha1:").lower()
                    digest = stated if kind == "revisit" else hashlib.sha1(block).hexdigest()
                    if digest != stated:
                        raise ValueError(f"record {head['warc-record-id']} doesn't have its digest")
                    rows.append((number("x-page-id"), head.get("warc-target-uri", ""), block, number("x-payload-bytes") if kind == "revisit" else len(block), digest, kind, number("x-refers-to-page")))
                    size += len(block)
                    if size >= 4 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    return map_arrow(files, run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])


def archived(pages: DataFrame, path: str | None = None, least_bytes: int = LEAST_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str | None = None) -> DataFrame:
    """Writes deduplicated archives and reads them back (see read_archives); one record per input row.

    Of equal payloads of at least ``least_bytes`` bytes the record with the
    largest page_id is the response, the others revisit it; smaller ones are all
    responses. Null html is an empty payload, a null url an empty target (line
    breaks in urls are written as %0A). Rows that repeat the largest id with the
    same payload are responses, all of them, with record ids of their own; rows
    with a null id are revisits where the payload has any id. Very long payloads
    are kept whole. An empty table gives an empty result; other columns, whatever
    their names, aren't read. Payload bytes are kept exactly, whatever they hold.
    Records are dated ``date`` (default: the time of writing).
    """
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    rows = addressed(pages)
    headers = written(payload_headers(rows, id_col, url_col, html_col), "warc-headers")
    again = written(revisits(headers, least_bytes), "revisits")
    first = marked(rows, again, keep=False)
    when = F.lit(date) if date else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    plain = first.select("at", F.col("row")[id_col].cast("long").alias("page_id"), F.col("row")[url_col].alias("url"), _payload(html_col).alias("payload"))
    plain = plain.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    mean = headers.agg(F.avg("payload_bytes")).first()[0] or 1
    records = plain.select(_record("response", when, F.col("payload")).alias("record")).unionByName(again.select(_record("revisit", when, F.lit(b"")).alias("record")))
    write_archives(records, path, max(1, int(FILE_BYTES / mean)))
    discard(headers, again)
    return read_archives(spark, path)


def op4_warc(spark, sf_dir):
    return archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes >= 1000) AS original FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> original THEN original END AS refers_to
FROM m
"""
