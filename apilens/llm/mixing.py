"""Mixing sources to target weights by Pfair scheduling of source blocks.

A source of weight w (a share of one) owns blocks of rows; its block j, counted
from the start of a phase, has release time floor(j / w) and deadline
ceil((j + 1) / w), in slots of one block. Earliest deadline first among the
released blocks fills the slots; every block then runs between its release and
its deadline, so that after any number of slots each source is less than one
block away from its share. A phase ends with the slot in which a source gives
its last block; the others go on with their weights, so that no row is lost.

Weights are kept as the exact fractions the caller gives. The blocks are
planned on the driver: at most MAX_BLOCKS of them and MAX_SOURCES sources,
whatever the number of rows, as blocks grow with it. Rows find their places by
DataFrame expressions; only their numbers are ordered, then each whole row is
joined to its place.
"""

from __future__ import annotations

import heapq
from fractions import Fraction
from math import gcd, isqrt, lcm

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apilens.llm.common import addressed, local_frame, numbered, table

BLOCK_ROWS = 16  # rows of a block, at least
MAX_BLOCKS = 1 << 18  # more rows than these blocks hold make larger blocks
MAX_SOURCES = 1000
PIECE_BLOCKS = 1024  # the plan is looked up in pieces of so many blocks of a source
LAST = 2**63 - 1  # a later deadline is given as this
SEED = 7
PLACES = ("mix_phase", "mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_position")


def exact(weight) -> Fraction:
    """The weight as written: a float's shortest decimal form, so that 0.1 is a tenth."""
    return Fraction(repr(float(weight))) if isinstance(weight, float) else Fraction(weight)


def reduced(weights: list[Fraction]) -> list[int]:
    """The least whole numbers in the ratios of the weights."""
    scale = lcm(*(w.denominator for w in weights))
    parts = [int(w * scale) for w in weights]
    return [p // gcd(*parts) for p in parts]


def phase_slots(parts: list[int], left: list[int]) -> list[list[tuple[int, int, int]]]:
    """(release, deadline, slot) of each source's blocks: earliest deadline first among the released ones,
    up to the slot in which a source gives the last of the blocks it has ``left``."""
    total, out, slot = sum(parts), [[] for _ in parts], 0
    waiting, ready = [(0, i) for i in range(len(parts))], []  # by release; by deadline
    while True:
        while waiting and waiting[0][0] <= slot:
            release, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(len(out[i]) + 1) * total // parts[i]), i, release))
        deadline, i, release = heapq.heappop(ready)
        out[i].append((release, deadline, slot))
        if len(out[i]) == left[i]:
            return out
        heapq.heappush(waiting, (len(out[i]) * total // parts[i], i))
        slot += 1


def plan(sizes: list[int], weights: list, block_rows: int = BLOCK_ROWS) -> list[list[tuple[int, int, int, int, int]]]:
    """Per source, per block: phase, release, deadline, slot, and the rows that blocks before the slot lack.

    Sources of no weight come after all others, in equal shares.
    """
    left = [-(-n // block_rows) for n in sizes]
    asked = {i: exact(w) for i, w in enumerate(weights) if w > 0}
    out, start, missing, phase = [[] for _ in sizes], 0, 0, 0
    while any(left):
        live = [i for i in range(len(sizes)) if left[i] and i in asked] or [i for i in range(len(sizes)) if left[i]]
        slots = phase_slots(reduced([asked.get(i, Fraction(1)) for i in live]), [left[i] for i in live])
        for i, own in zip(live, slots, strict=True):
            out[i] += [(phase, start + r, start + d, start + s, missing) for r, d, s in own]
            left[i] -= len(own)
            if own and not left[i]:
                ended = i
        missing += -sizes[ended] % block_rows
        start, phase = start + sum(map(len, slots)), phase + 1
    return out


_ARRAYS = ("phases", "releases", "deadlines", "slots", "missing")
_PIECES = pa.schema([("of", pa.string()), ("piece", pa.int64()), ("begin", pa.int64()), *((c, pa.list_(pa.int64())) for c in _ARRAYS)])


def _source_rows(counts: DataFrame) -> list[tuple[str | None, int]]:
    """(source, rows), the null source first; an error beyond MAX_SOURCES."""
    found = counts.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: group them first")
    return sorted(map(tuple, found), key=lambda x: (x[0] is not None, x[0] or ""))


def tempered_weights(docs: DataFrame, source_col: str = "source", emphasis: tuple[int, ...] = (1, 2, 3, 4)) -> dict[str | None, int]:
    """Target weights by rule: the whole square root of a source's rows, so that large sources give relatively less,
    times the ``emphasis`` that sources get in turn, in the order of their names (null first)."""
    counts = _source_rows(docs.groupBy(F.col(source_col).cast("string").alias("s")).count())
    return {s: isqrt(n) * emphasis[k % len(emphasis)] for k, (s, n) in enumerate(counts)}


def _placed(rows: DataFrame, weights: dict | None, block_rows: int, seed: int, id_col: str, source_col: str) -> tuple[DataFrame, int]:
    """(at, PLACES) of all ``rows`` (``row`` and ``at``), and their number."""
    spark, row = rows.sparkSession, F.col("row")
    drawn = F.xxhash64(F.lit(seed), row[id_col].cast("string"))
    keys = rows.select(row[source_col].cast("string").alias("source"), drawn.alias("drawn"), "at")
    keys, total = numbered(keys, ["source", "drawn", "at"], "rank", "mix-rows")
    counts = _source_rows(keys.groupBy("source").count())
    size = max(block_rows, -(-total // MAX_BLOCKS))
    pieces, begin = [], 0
    places = plan([n for _, n in counts], [1 if weights is None else weights.get(s, 0) for s, _ in counts], size)
    for (s, n), blocks in zip(counts, places, strict=True):
        for k in range(0, len(blocks), PIECE_BLOCKS):
            pieces.append((s, k // PIECE_BLOCKS, begin, *([min(x, LAST) for x in c] for c in zip(*blocks[k : k + PIECE_BLOCKS], strict=True))))
        begin += n
    begins = local_frame(spark, pa.schema([("of", pa.string()), ("begin", pa.int64())]), [p[:1] + p[2:3] for p in pieces if p[1] == 0])
    own = keys.join(F.broadcast(begins), F.col("source").eqNullSafe(F.col("of"))).select("source", "at", (F.col("rank") - F.col("begin")).alias("rank"))
    own = own.withColumn("block", F.expr(f"rank div {size}"))
    listed = F.broadcast(local_frame(spark, _PIECES, pieces).drop("begin"))
    found = own.join(listed, F.col("source").eqNullSafe(F.col("of")) & (F.expr(f"block div {PIECE_BLOCKS}") == F.col("piece")))
    of = lambda name: F.element_at(name, (F.col("block") % PIECE_BLOCKS + 1).cast("int"))
    position = of("slots") * size - of("missing") + F.col("rank") % size
    values = (of("phases"), F.col("block"), of("releases"), of("deadlines"), of("slots"), position)
    return found.select("at", *[v.cast("long").alias(c) for c, v in zip(PLACES, values, strict=True)]), total


def mix(docs: DataFrame, weights: dict | None = None, block_rows: int = BLOCK_ROWS, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """row, mix_phase, mix_block, mix_release, mix_deadline, mix_slot, mix_position; one row per input row.

    ``row`` is the whole input row as a struct, whatever its columns' names;
    ``mix_position`` its place in the mixed order, gapless from 0. Rows of a
    source are dealt to its blocks in an order drawn by ``seed``. Without
    ``weights`` all sources weigh the same; a source that has none, or 0, comes
    after all weighted ones. Weights are numbers of any size; a float counts as
    its shortest decimal form, and fractions are exact. A null source is a
    source of its own. Rows with null, equal or repeated ids are ordered by
    their place in ``docs``; texts may be null, empty or very long. An empty
    table gives an empty result. Nothing is dropped when a source ends; the
    phase tells which rows follow the full target. More than MAX_SOURCES
    sources are an error.
    """
    rows = addressed(docs)
    return rows.join(_placed(rows, weights, block_rows, seed, id_col, source_col)[0], "at").drop("at")


def mixed(docs: DataFrame, weights: dict | None = None, block_rows: int = BLOCK_ROWS, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` laid out in the mixed order, partition by partition; columns unchanged, edge cases as in ``mix``."""
    rows = addressed(docs)
    places, total = _placed(rows, weights, block_rows, seed, id_col, source_col)
    return _in_order(rows.join(places, "at"), total).select("row.*")


def _in_order(rows: DataFrame, total: int) -> DataFrame:
    """Rows dealt to partitions of equal size by position, as gapless positions allow without sampling, and sorted in them."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = max(1, -(-total // n))
    return rows.repartitionById(n, F.expr(f"mix_position div {each}").cast("int")).sortWithinPartitions("mix_position")


def laid_out(docs: DataFrame) -> DataFrame:
    """(row, mix_position) of what ``mixed`` laid out, read back from its files: the place follows from file and row."""
    return addressed(docs).withColumnRenamed("at", "mix_position")


def op2_mixing(spark, sf_dir):
    """All documents, whole, laid out to tempered target weights."""
    rows = addressed(docs := table(spark, sf_dir, "documents"))
    places, total = _placed(rows, tempered_weights(docs), BLOCK_ROWS, SEED, "doc_id", "source")
    return _in_order(rows.join(places, "at"), total).select("row.*", *PLACES)
