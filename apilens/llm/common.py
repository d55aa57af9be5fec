"""Shared helpers: tables, the shared folder, written intermediates, row numbers, hot keys."""

from __future__ import annotations

import ctypes
import os
import re
import sys
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOT_KEYS = 10_000  # a key is hot if it has more than one in so many of all rows,
HOT_ROWS = 256  # and more rows than this
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"
MARKED = 1 << 14  # bitmaps (of 32768 row numbers, 4 KB each) up to which they are broadcast: 64 MB


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder is set if all runs in one
    process (tests); on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{os.path.join(tempfile.gettempdir(), 'apilens-checkpoints')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends if not discarded before."""
    path = f"{shared_dir(spark)}/apilens/{tag}-{uuid.uuid4().hex}"
    fs, at = _hadoop(spark, path)
    fs.deleteOnExit(at)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there.

    What it holds no longer depends on the executors that computed it, and
    values such as row numbers are fixed once and for all.
    """
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes tables that ``written`` gave, once nothing reads them any more."""
    for df in frames:
        fs, at = _hadoop(df.sparkSession, df._scratch)
        fs.delete(at, True)


def map_arrow(rows: DataFrame, run, schema) -> DataFrame:
    """``rows.mapInArrow`` by batches of at most BATCH_BYTES or one row: rows may be long, and Spark's default is 64 MB.

    The session keeps the bound, unless it has set one itself. Workers live on
    after a task, so what the task has freed goes back to the system at its end.
    """
    conf = rows.sparkSession.conf
    if conf.get(BATCH_CONF) == "67108864b":
        conf.set(BATCH_CONF, BATCH_BYTES)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return rows.mapInArrow(task, schema)


def collected(spark: SparkSession) -> None:
    """Asks the executors' JVMs to collect their garbage, so that they give heap they don't use back to the system.

    A heap stays as large as the busiest stage has made it, and direct buffers
    stay until their owners are collected; Python workers need room beside both.
    One task a core, so that each executor gets one. No result depends on it.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).collect()


def local_frame(spark: SparkSession, schema: pa.Schema, rows: list[tuple]) -> DataFrame:
    """Rows of the driver's as a frame, handed over as Arrow: no Python worker takes part."""
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema))


def column(name: str) -> Column:
    """The column of that very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(df: DataFrame, by: list[str], name: str, tag: str) -> tuple[DataFrame, int]:
    """``df`` with gapless row numbers from 0 in the order of ``by``, and the count.

    Ranges of the key are sorted apart; only the number of rows of each range
    (one number per partition) meets on the driver.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *by).sortWithinPartitions(*by)
    kept = written(ranged.withColumn("_at", F.monotonically_increasing_id()), tag)
    part = F.shiftright("_at", 33)
    counts = sorted(kept.groupBy(part.alias("p")).count().collect())
    starts, total = [], 0
    for p, c in counts:
        starts.append((p, total))
        total += c
    offsets = local_frame(spark, pa.schema([("_p", pa.int64()), ("_start", pa.int64())]), starts)
    within = F.col("_at").bitwiseAND((1 << 33) - 1)
    out = kept.withColumn("_p", part).join(F.broadcast(offsets), "_p").withColumn(name, F.col("_start") + within).drop("_at", "_p", "_start")
    out._scratch = kept._scratch
    return out, total


def _as_read(docs: DataFrame) -> bool:
    """Whether ``docs`` is a table as read from files, so that its rows keep file and index."""
    node = docs._jdf.queryExecution().analyzed()
    while node.getClass().getSimpleName() in ("Project", "SubqueryAlias"):
        node = node.child()
    return node.getClass().getSimpleName() == "LogicalRelation"


def addressed(docs: DataFrame) -> DataFrame:
    """(row, at): every row whole, as a struct, and its number, gapless from 0 in the order of files and of rows in them.

    The struct keeps any column name of the caller's apart from ours. Numbers
    follow from the files alone, so they are the same in each reading; frames
    that don't come straight from files are written first. One row per file
    meets on the driver, as in Spark's own list of files.
    """
    spark, meta = docs.sparkSession, None
    if _as_read(docs):
        try:
            meta = docs.metadataColumn("_metadata")
            docs.select(meta["row_index"])
        except AnalysisException:
            meta = None
    if meta is None:
        docs = written(docs, "rows")
        meta = docs.metadataColumn("_metadata")
    places = docs.select(meta["file_path"].alias("f"), meta["row_index"].alias("i"))
    files = places.groupBy("f").agg((F.max("i") + 1).alias("n")).withColumn("h", F.xxhash64("f")).collect()
    files.sort(key=lambda r: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", r.f)])
    if len({r.h for r in files}) < len(files):
        raise ValueError("two files share a hash; rename one")
    starts, at = [], 0
    for r in files:
        starts.append((r.h, at))
        at += r.n
    offsets = local_frame(spark, pa.schema([("h", pa.int64()), ("start", pa.int64())]), starts)
    rows = docs.select(F.struct(*[column(c) for c in docs.columns]).alias("row"), F.xxhash64(meta["file_path"]).alias("h"), meta["row_index"].alias("i"))
    return rows.join(F.broadcast(offsets), "h").select("row", (F.col("start") + F.col("i")).alias("at"))


def marked(rows: DataFrame, ids: DataFrame, keep: bool = True) -> DataFrame:
    """The rows whose ``at`` is among those of ``ids`` (with ``keep=False``: is not).

    Numbers become bitmaps, an eighth of a byte each, so that what is large
    needn't be shuffled to be picked from. Up to MARKED bitmaps are broadcast;
    beyond, rows and numbers are joined.
    """
    bucket = F.bitmap_bucket_number("at")
    marks = written(ids.groupBy(bucket.alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("_marks")), "marks")
    if marks.count() > MARKED:
        return rows.join(ids.select("at").distinct(), "at", "left_semi" if keep else "left_anti")
    joined = rows.withColumn("_bucket", bucket).join(F.broadcast(marks), "_bucket", "inner" if keep else "left")
    hit = F.expr("shiftright(cast(conv(hex(substring(_marks, cast(1 + bitmap_bit_position(at) div 8 as int), 1)), 16, 10) as int), cast(bitmap_bit_position(at) % 8 as int)) & 1 = 1")
    return joined.filter(hit if keep else F.col("_marks").isNull() | ~hit).select(*rows.columns)


def hot_over(rows: int) -> int:
    """A key with more of all ``rows`` than this is hot; there are HOT_KEYS such keys at most."""
    return max(HOT_ROWS, rows // HOT_KEYS)


def hot_join(left: DataFrame, right: DataFrame, hot: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined to ``right`` (one row a key; inner or left_semi) with its hot keys split.

    ``hot``: the rows of ``right`` for keys that are hot in ``left`` (``hot_over``
    bounds their number). They are broadcast, so that the rows of a hot key stay
    where they are; only the others are dealt out by key.
    """
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right, keys, how)
    return left.join(F.broadcast(hot), keys, how).unionByName(rest)
