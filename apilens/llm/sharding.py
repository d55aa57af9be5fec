"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows get gapless numbers in the order of (id, size, checksum); a keyed Feistel
network permutes 0..n-1, walking on while a value falls outside. Value v goes to
shard v mod k, slot v div k: shard sizes differ by one row at most, and both are
computable from the row's number alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apilens.llm.common import map_arrow, numbered, table

SHARDS = 24
SEED = 20240229
ROUNDS = 6


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift steps); numpy wraps around."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _network(x: np.ndarray, half: int, seed: int) -> np.ndarray:
    """A balanced Feistel network on 2 * half bits."""
    mask, bits = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> bits, x & mask
    for k in range(ROUNDS):
        key = np.uint64((seed * 0x9E3779B97F4A7C15 + k * 0xD1B54A32D192ED03) % (1 << 64))
        left, right = right, left ^ (_mix(right ^ key) & mask)
    return (left << bits) | right


def permuted(numbers: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """A permutation of 0..n-1 applied to ``numbers``.

    The network acts on at most 4n values and is one cycle structure on them, so
    walking from a number below n always comes back below n.
    """
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    out = _network(numbers.astype(np.uint64), half, seed)
    while (far := out >= np.uint64(n)).any():
        out[far] = _network(out[far], half, seed)
    return out.astype(np.int64)


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, row_number, shard, slot, grown_shard; one row per input row.

    The law is ``rows``: shard counts differ by one at most, whatever the rows
    hold, so that groups of equal texts spread like any other rows. Null texts
    have size 8 and the checksum of nothing; very long ones are measured whole.
    Null ids are numbered first; repeated rows get different slots. An empty table gives an empty result;
    other columns aren't read. ``grown_shard`` is null under this law.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows, n = numbered(rows, ["doc_id", "size", "text_crc32"], "row_number", "shard-rows")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = permuted(b.column("row_number").to_numpy(), n, seed)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((at % shards).astype(np.int32)), pa.array(at // shards)], names=[*b.schema.names, "shard", "slot"])

    placed = map_arrow(rows, place, "doc_id long, size long, text_crc32 long, row_number long, shard int, slot long")
    return placed.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def op8_sharding(spark, sf_dir):
    return shard(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "row_number")
