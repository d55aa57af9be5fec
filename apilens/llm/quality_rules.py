"""Quality rules: base statistics, a base filter, and a learned decision list.

The list is learned by sequential covering: a rule (a conjunction of thresholds)
grows by information gain on two thirds of the labelled rows still uncovered, is
pruned on the last third, and is kept if precise enough there. The rules are
emitted as one ordered Spark conditional expression.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apilens.llm.common import map_arrow, table

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MAX_LABELS = 4000  # bound of the labelled sample that the list is learned from
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_distinct_words", "n_echo_words", "n_upper", "n_digits", "n_marks", "n_bars")
_UPPER, _DIGITS, _MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?"
_BLANK = " \t\n\v\f\r"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words stand in a window of ``window`` words that the text has twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    ids = ids * np.uint64(0x9E3779B97F4A7C15)
    ids ^= ids >> np.uint64(32)
    keys = np.zeros(n, np.uint64)
    for k in range(window):
        keys = keys * np.uint64(0xD1B54A32D192ED03) + ids[k : k + n]
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    # Windows whose keys agree are compared themselves.
    at = np.flatnonzero(np.isin(keys, twice)).tolist()
    seen = Counter(tuple(words[i : i + window]) for i in at)
    covered = np.zeros(len(words) + 1, np.int64)
    for i in at:
        if seen[tuple(words[i : i + window])] > 1:
            covered[i] += 1
            covered[i + window if i + window < len(covered) else -1] -= 1
    return int((np.cumsum(covered[:-1]) > 0).sum())


def text_stats(text: str | None) -> tuple[int, ...]:
    """The counts named in STATS. Words are runs without ASCII white space."""
    text = text or ""
    data = text.encode()
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    count = lambda chars: len(data) - len(data.translate(None, chars))
    return (
        len(words),
        len(text) - sum(text.count(c) for c in _BLANK),
        sum(text.count(c) for c in SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(text),
        len(lines),
        len(set(words)),
        sum(map(eq, words, words[1:])),
        count(_UPPER),
        count(_DIGITS),
        count(_MARKS),
        data.count(b"|"),
    )


def with_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, stats): every input row whole, as a struct, and its statistics. Null texts count as empty."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).field(text_col)
            found = [text_stats(x.as_py()) for x in texts]
            columns = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * len(STATS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.StructArray.from_arrays(columns, names=list(STATS))], names=["row", "stats"])

    counts = T.StructType([T.StructField(s, T.LongType()) for s in STATS])
    return map_arrow(packed, run, T.StructType([T.StructField("row", packed.schema["row"].dataType), T.StructField("stats", counts)]))


def features(stats: str = "stats") -> dict[str, Column]:
    """The ratios that rules set thresholds on; 0 where there is nothing to divide by."""
    s = lambda name: F.col(f"{stats}.{name}")
    over = lambda a, b: F.when(s(b) > 0, s(a) / s(b)).otherwise(0.0)
    return {
        "n_words": s("n_words").cast("double"),
        "word_length": over("word_chars", "n_words"),
        "symbols_per_word": over("n_symbols", "n_words"),
        "bars_per_word": over("n_bars", "n_words"),
        "marks_per_word": over("n_marks", "n_words"),
        "dup_line_share": over("n_dup_lines", "n_lines"),
        "repeat_share": over("n_repeat_words", "n_words"),
        "distinct_share": over("n_distinct_words", "n_words"),
        "echo_share": over("n_echo_words", "n_words"),
        "upper_share": over("n_upper", "n_chars"),
        "digit_share": over("n_digits", "n_chars"),
    }


@dataclass(frozen=True)
class Rule:
    """Rejects where every (feature, is it at least, threshold) holds."""

    conditions: tuple[tuple[str, bool, float], ...]

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        hit = np.ones(len(next(iter(x.values()))), bool)
        for name, least, at in self.conditions:
            hit &= x[name] >= at if least else x[name] <= at
        return hit

    def column(self, columns: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, least, at in self.conditions:
            out = out & ((columns[name] >= F.lit(at)) if least else (columns[name] <= F.lit(at)))
        return out

    def __str__(self) -> str:
        return " AND ".join(f"{name} {'>=' if least else '<='} {at:.6g}" for name, least, at in self.conditions)


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, steps: int, cuts: int) -> list[tuple[str, bool, float]]:
    """Adds the threshold with the best information gain while there are good rows inside."""
    inside, out = np.ones(len(bad), bool), []
    while len(out) < steps and (~bad & inside).any() and (bad & inside).any():
        p, n = (bad & inside).sum(), (~bad & inside).sum()
        before, best = np.log2(p / (p + n)), (1e-9, None)
        for name, v in x.items():
            for at in np.unique(np.quantile(v[inside], np.linspace(0, 1, cuts), method="nearest")):
                for least in (True, False):
                    hit = inside & (v >= at if least else v <= at)
                    p1, n1 = (bad & hit).sum(), (~bad & hit).sum()
                    if p1 and (gain := p1 * (np.log2(p1 / (p1 + n1)) - before)) > best[0]:
                        best = (gain, (name, least, float(at)))
        if best[1] is None:
            break
        out.append(best[1])
        inside &= Rule((best[1],)).covers(x)
    return out


def learn(x: dict[str, np.ndarray], bad: np.ndarray, max_rules: int = 12, steps: int = 4, cuts: int = 48, precision: float = 0.95, least: int = 3) -> list[Rule]:
    """An ordered list of rules for the rows in ``bad``; empty if a class is missing."""
    rules, left = [], np.ones(len(bad), bool)
    order = np.random.default_rng(7).permutation(len(bad))
    third = np.zeros(len(bad), bool)
    third[order[: len(bad) // 3]] = True
    while len(rules) < max_rules and (bad & left).sum() >= least:
        grow, prune = left & ~third, left & third
        if not (bad & grow).any() or not (bad & prune).any():
            break
        conditions = _grow({k: v[grow] for k, v in x.items()}, bad[grow], steps, cuts)
        best, worth = None, -1.0
        for k in range(1, len(conditions) + 1):
            hit = Rule(tuple(conditions[:k])).covers(x) & prune
            p, n = (bad & hit).sum(), (~bad & hit).sum()
            if p and (p - n) / (p + n) > worth:
                best, worth = Rule(tuple(conditions[:k])), (p - n) / (p + n)
        if best is None:
            break
        hit = best.covers(x) & left
        if (bad & hit).sum() < precision * hit.sum() or hit.sum() < least:
            break
        rules.append(best)
        left &= ~hit
    return rules


def learn_rules(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, id_col: str = "doc_id", text_col: str = "text", **kw) -> list[Rule]:
    """Rules learned from at most ``max_labels`` labelled rows (those with the smallest hashes of the id)."""
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels).select(F.col("doc_id").alias("_labelled"), "quality")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(sample), F.col("doc_id") == F.col("_labelled")).select("doc_id", "quality", "text")
    columns = features()
    found = with_stats(rows).select(F.col("row.doc_id").alias("doc_id"), F.col("row.quality").alias("quality"), *[c.alias(k) for k, c in columns.items()]).toPandas()
    if found.empty:
        return []
    found = found.sort_values(["doc_id", *columns]).reset_index(drop=True)
    return learn({k: found[k].to_numpy(float) for k in columns}, found["quality"].to_numpy() == 0, **kw)


def base_failed(stats: str = "stats") -> Column:
    """Fewer than 20 words, or over 30 in 100 words in repeated windows."""
    n, again = F.col(f"{stats}.n_words"), F.col(f"{stats}.n_repeat_words")
    return (n < 20) | (100 * again > 30 * n)


def verdict(rules: list[Rule], stats: str = "stats") -> Column:
    """The number of the first rule that rejects, in order; 0 where none does."""
    columns, out = features(stats), None
    for k, rule in enumerate(rules, 1):
        hit = rule.column(columns)
        out = F.when(hit, k) if out is None else out.when(hit, k)
    return F.lit(0) if out is None else out.otherwise(0)


def judge(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """(row, stats, base_failed, rule, kept) of every input row.

    Null and empty texts have no words and fail the base filter; very long texts
    are read whole. Repeated rows are judged alike and all returned. An empty
    table gives an empty result. Without labels the list is empty and the base
    filter alone decides. Other columns stay inside ``row``, whatever their names.
    """
    judged = with_stats(docs, text_col).withColumns({"base_failed": base_failed(), "rule": verdict(rules)})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def op6_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = learn_rules(docs, table(spark, sf_dir, "labels"))
    shown = [F.col(f"stats.{s}").alias(s) for s in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judge(docs, rules).select("row.doc_id", *shown, "base_failed", "kept", "rule")
