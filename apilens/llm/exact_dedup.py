"""Exact dedup by deterministic block naming, in DataFrame operations only.

Every normalised text is cut into blocks of a fixed number of characters. The
distinct blocks are sorted (by their hashes) and get integer names; then
adjacent names are paired, the distinct pairs sorted and named, and so on, until
each document has one name. Equal (number of blocks, name) means equal text: names stand for
contents, so there are no collisions.

The text is shuffled once, for the distinct blocks (map-side combined, so that
a block found in a third of all rows arrives once per map task). Occurrences
look their names up by the block's 64-bit hash; should two different blocks
share a hash, those alone are looked up by content. Names that very many rows
share are broadcast, so that no task gathers them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from apilens.llm.common import addressed, discard, hot_join, hot_over, marked, numbered, table, written

BLOCK_CHARS = 4096


def normalised(text: Column | str) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _blocks(norm: str, chars: int) -> Column:
    """A text's blocks in order; the empty text has one empty block."""
    cut = F.regexp_extract_all(norm, F.lit(f"(?s).{{1,{chars}}}"), 0)
    return F.when(F.col(norm) == "", F.array(F.lit(""))).otherwise(cut)


def column_of(name: str) -> Column:
    """A column of the caller's row."""
    return F.col("row")[name]


def _block_hash(block: Column) -> Column:
    return F.xxhash64(block)


def _first_names(blocks: DataFrame, block_hash) -> tuple[DataFrame, int]:
    """(h, c, name) of the distinct blocks, sorted by hash, with the number of times each is found, and the sum of these."""
    found = blocks.select(F.explode("blocks").alias("block")).groupBy("block").agg(F.count(F.lit(1)).alias("c"))
    names, _ = numbered(found.select(block_hash(F.col("block")).alias("h"), "c"), ["h"], "name", "block-names")
    return names, names.agg(F.sum("c")).first()[0] or 0


def _by_hash(found: DataFrame, names: DataFrame, clash: DataFrame | None, blocks: DataFrame, block_hash, hot: int) -> DataFrame:
    """(rid, pos, h) with names; blocks in ``clash``, whose hash others share, are looked up by content."""
    if clash is not None:
        order = Window.partitionBy("h")
        again = blocks.select("rid", F.posexplode("blocks").alias("pos", "block")).withColumn("h", block_hash(F.col("block"))).join(clash, "h", "left_semi")
        by_text = again.select("h", "block").distinct().withColumn("nth", F.row_number().over(order.orderBy("block")))
        by_name = names.join(clash, "h", "left_semi").withColumn("nth", F.row_number().over(order.orderBy("name")))
        exact = by_text.join(by_name, ["h", "nth"]).select("h", "block", "name")
        names = names.join(clash, "h", "left_anti")
        clashing = again.join(exact, ["h", "block"]).select("rid", "pos", "name")
    plain = hot_join(found, names, names.filter(F.col("c") > hot), ["h"]).select("rid", "pos", "name")
    return plain if clash is None else plain.unionByName(clashing)


def _pair_names(names: Column) -> Column:
    """Adjacent names in pairs; a last one without a partner is paired with -1."""
    half = F.sequence(F.lit(0), F.floor((F.size(names) - 1) / 2).cast("int"))
    return F.transform(half, lambda i: F.struct(names[i * 2].alias("a"), F.coalesce(F.get(names, i * 2 + 1), F.lit(-1)).alias("b")))


def _gathered(found: DataFrame) -> DataFrame:
    """A row's names in order: at most as many as its text has blocks."""
    in_order = F.sort_array(F.collect_list(F.struct("pos", "name")))
    return found.groupBy("rid").agg(F.transform(in_order, lambda x: x["name"]).alias("names"))


def identities(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, block_hash=_block_hash) -> DataFrame:
    """One row per row of ``rows`` (``row`` and ``at``, see ``addressed``): rid (at), doc_id, text_sha256, n_blocks, name.

    (n_blocks, name) is equal for equal normalised texts and for no others.
    Names count the sorted distinct blocks, then the sorted distinct pairs, so
    they depend on the texts alone, however these are dealt out.
    """
    norm = rows.select(F.col("at").alias("rid"), column_of(id_col).alias("doc_id"), normalised(column_of(text_col)).alias("norm"))
    blocks = norm.withColumn("blocks", _blocks("norm", block_chars))
    names, total = _first_names(blocks, block_hash)
    clash = written(names.groupBy("h").count().filter("count > 1").select("h"), "block-clashes")
    docs = written(
        blocks.select("rid", "doc_id", F.sha2("norm", 256).alias("text_sha256"), F.size("blocks").alias("n_blocks"), F.transform("blocks", block_hash).alias("hashes")),
        "block-rows",
    )
    found = docs.select("rid", F.posexplode("hashes").alias("pos", "h"))
    level = written(_gathered(_by_hash(found, names, None if clash.isEmpty() else clash, blocks, block_hash, hot_over(total))), "names-0")
    discard(names, clash)
    used, done = [level], level.filter(F.size("names") == 1)
    left = docs.agg(F.max("n_blocks")).first()[0] or 0
    while left > 1:
        left = (left + 1) // 2
        pairs = level.filter(F.size("names") > 1).select("rid", F.posexplode(_pair_names(F.col("names"))).alias("pos", "pair")).select("rid", "pos", "pair.a", "pair.b")
        named, _ = numbered(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c")), ["a", "b"], "name", "pair-names")
        level = written(_gathered(hot_join(pairs, named, named.filter(F.col("c") > hot_over(total)), ["a", "b"]).select("rid", "pos", "name")), f"names-{left}")
        used += [named, level]
        done = done.unionByName(level.filter(F.size("names") == 1))
    out = written(docs.drop("hashes").join(done.select("rid", F.col("names")[0].alias("name")), "rid"), "identities")
    discard(docs, *used)
    return out


def _grouped(rows: DataFrame, id_col: str, text_col: str, block_chars: int, block_hash) -> DataFrame:
    """Every row's identity with its group's size and first row (null ids last; of equal ids the first as read)."""
    ids = identities(rows, id_col, text_col, block_chars, block_hash)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("rid").alias("at")))
    groups = written(ids.groupBy("n_blocks", "name").agg(first.alias("first"), F.count(F.lit(1)).cast("long").alias("group_size")), "groups")
    return hot_join(ids, groups, groups.filter(F.col("group_size") > hot_over(ids.count())), ["n_blocks", "name"])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, block_hash=_block_hash) -> DataFrame:
    """Groups of equal texts: doc_id, keep_id, group_size, kept, text_sha256; one row per input row.

    Texts are equal when they are identical after replacing each run of ASCII
    white space by one space. Of equal texts the row with the smallest id
    stays. Null texts count as empty and are equal to empty ones; very long
    texts are read whole, as many blocks as they have. A null id comes after all
    others, so its row stays only where the group has no other; keep_id is then
    null. Where a row is repeated with the same id, exactly one of the repeats
    stays. An empty table gives an empty result; other columns of ``docs``,
    whatever their names, aren't read.
    """
    found = _grouped(addressed(docs), id_col, text_col, block_chars, block_hash)
    return found.select("doc_id", F.col("first.id").alias("keep_id"), "group_size", (F.col("rid") == F.col("first.at")).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, block_hash=_block_hash) -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged, whatever their names: one of each group, by row.

    Nulls, ties, repeats and very long texts are as in ``exact_dedup``: of rows
    that share id and text one stays; rows of one id with different texts all
    stay. An empty table gives an empty result.
    """
    rows = addressed(docs)
    gone = _grouped(rows, id_col, text_col, block_chars, block_hash).filter(F.col("rid") != F.col("first.at")).select(F.col("rid").alias("at"))
    return marked(rows, gone, keep=False).select("row.*")


def op10_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size, sha256(norm) AS text_sha256
  FROM n
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
