"""Quality classifier: a linear-chain conditional random field over lines.

Each line gets features of its own and of its neighbours; a chain with two
states (bad, good) is trained by gradient ascent on the conditional likelihood,
every line of a labelled document carrying that document's label. A document's
score is the mean of its lines' forward-backward marginals, weighted by length.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apilens.llm.common import map_arrow, table

MAX_LABELS = 2000  # bound of the labelled sample that the chain is trained on,
MAX_BYTES = 1 << 16  # and of the bytes of a text in it
LINES = 1 << 14  # lines of texts that are scored at once, if these are more than one
SYMBOLS = b"#*$%&<>"
_UPPER, _DIGITS, _MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?"
OWN = 12  # features of a line
SHARED = 9  # the first of them are also seen from the neighbouring lines


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and lengths of the lines that hold a word; length in characters."""
    rows, lengths, seen = [], [], set()
    for line in text.split("\n"):
        data = line.encode()
        words = data.split()
        if not words:
            continue
        n, size = len(words), len(data)
        count = lambda chars, data=data, size=size: size - len(data.translate(None, chars))
        rows.append((
            min(2.0, count(SYMBOLS) / n),
            min(2.0, data.count(b"|") / n),
            min(2.0, count(_MARKS) / n),
            count(_UPPER) / size,
            len(set(words)) / n,
            sum(map(eq, words, words[1:])) / n,
            float(data in seen),
            count(_DIGITS) / size,
            np.log1p(n),
            min(20.0, size / n),
            float(n <= 3),
            float(data[-1:] in b".!?"),
        ))
        seen.add(data)
        lengths.append(len(line))
    return np.asarray(rows, float).reshape(-1, OWN), np.asarray(lengths, float)


def chained(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of all texts with those of their neighbours, lengths, and lines per text."""
    found = [line_features(t or "") for t in texts]
    counts = np.array([len(n) for _, n in found], int)
    own = np.concatenate([f for f, _ in found]) if found else np.zeros((0, OWN))
    lengths = np.concatenate([n for _, n in found]) if found else np.zeros(0)
    starts = np.repeat(np.cumsum(counts) - counts, counts)
    at = np.arange(len(own))
    first, last = at == starts, at == starts + np.repeat(counts, counts) - 1
    before = np.where(first[:, None], 0.0, np.roll(own[:, :SHARED], 1, axis=0)) if len(own) else own[:, :SHARED]
    after = np.where(last[:, None], 0.0, np.roll(own[:, :SHARED], -1, axis=0)) if len(own) else own[:, :SHARED]
    return np.column_stack([own, before, after, first, last, np.ones(len(own))]), lengths, counts


def forward_backward(emit: np.ndarray, counts: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of every line, summed pair marginals, and the log partition of all chains together.

    ``emit`` is (lines, 2). Chains run side by side, the longest first, so that
    each step works on all chains that reach that far.
    """
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 0]
    start, n = (np.cumsum(counts) - counts)[order], counts[order]
    alpha, beta = emit.copy(), np.zeros_like(emit)
    reach = [int(np.searchsorted(-n, -k)) for k in range(int(n[0]) if len(n) else 0)]  # chains longer than k
    for k in range(1, len(reach)):
        at = start[: reach[k]] + k
        prev = alpha[at - 1]
        for s in (0, 1):
            alpha[at, s] += np.logaddexp(prev[:, 0] + trans[0, s], prev[:, 1] + trans[1, s])
    for k in range(len(reach) - 2, -1, -1):
        at = start[: reach[k + 1]] + k
        nxt = beta[at + 1] + emit[at + 1]
        for s in (0, 1):
            beta[at, s] = np.logaddexp(nxt[:, 0] + trans[s, 0], nxt[:, 1] + trans[s, 1])
    final = alpha[start + n - 1]
    log_z = np.logaddexp(final[:, 0], final[:, 1])
    z = np.zeros(len(counts))
    z[order] = log_z
    per_line = np.repeat(z, counts)
    marginal = np.exp(alpha + beta - per_line[:, None])
    pairs, inner = np.zeros((2, 2)), np.ones(len(emit), bool)
    inner[start] = False
    at = np.flatnonzero(inner)
    for a in (0, 1):
        for b in (0, 1):
            pairs[a, b] = np.exp(alpha[at - 1, a] + trans[a, b] + emit[at, b] + beta[at, b] - per_line[at]).sum()
    return marginal, pairs, float(log_z.sum())


class LineCRF:
    """Weights of the chain; ``prior`` is the score of a text without lines."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, trans: np.ndarray, prior: float):
        self.mean, self.scale, self.weights, self.trans, self.prior = mean, scale, weights, trans, prior

    @classmethod
    def train(cls, texts: list[str], labels: np.ndarray, steps: int = 80, rate: float = 0.1, ridge: float = 1e-3) -> LineCRF:
        """Adam on the mean conditional log-likelihood of lines with a ridge penalty."""
        x, _, counts = chained(texts)
        labels = np.asarray(labels, int)
        prior = float(labels.mean()) if len(labels) else 0.5
        if not len(x) or labels.min() == labels.max():
            return cls(np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros(x.shape[1]), np.zeros((2, 2)), prior)
        mean, scale = x.mean(0), x.std(0)
        mean[-1], scale[-1] = 0.0, 1.0
        scale[scale == 0] = 1.0
        x = (x - mean) / scale
        y = np.repeat(labels, counts)
        inner = np.arange(len(y)) != np.repeat(np.cumsum(counts) - counts, counts)
        same = np.zeros((2, 2))
        for s in (0, 1):
            same[s, s] = (inner & (y == s)).sum()
        theta, m, v = np.zeros(x.shape[1] + 4), 0.0, 0.0
        for t in range(1, steps + 1):
            w, trans = theta[:-4], theta[-4:].reshape(2, 2)
            emit = np.column_stack([np.zeros(len(x)), x @ w])
            marginal, pairs, _ = forward_backward(emit, counts, trans)
            grad = np.concatenate([x.T @ (y - marginal[:, 1]), (same - pairs).ravel()]) / len(y) - ridge * theta
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        return cls(mean, scale, theta[:-4], theta[-4:].reshape(2, 2), prior)

    def marginals(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each line's probability of being good, lengths, and lines per text."""
        x, lengths, counts = chained(texts)
        emit = np.column_stack([np.zeros(len(x)), ((x - self.mean) / self.scale) @ self.weights])
        return forward_backward(emit, counts, self.trans)[0][:, 1], lengths, counts

    def scores(self, texts: list[str | None]) -> np.ndarray:
        good, lengths, counts = self.marginals(texts)
        doc = np.repeat(np.arange(len(counts)), counts)
        total = np.bincount(doc, lengths, len(counts))
        mean = np.bincount(doc, lengths * good, len(counts)) / np.where(total > 0, total, 1.0)
        return np.clip(np.where(total > 0, mean, self.prior), 0.0, 1.0)


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves 1 when divided by 3; false for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, max_bytes: int = MAX_BYTES, id_col: str = "doc_id", text_col: str = "text") -> LineCRF:
    """A chain trained on at most ``max_labels`` labelled rows outside the held-out fold, with texts of at most ``max_bytes`` bytes."""
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels).select(F.col("doc_id").alias("_labelled"), "quality")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(f"text IS NULL OR octet_length(text) <= {max_bytes}")
    rows = texts.join(F.broadcast(sample), F.col("doc_id") == F.col("_labelled")).select("doc_id", "quality", "text").toPandas()
    rows = rows.sort_values(["doc_id", "text"], na_position="first")
    return LineCRF.train(rows["text"].tolist(), rows["quality"].to_numpy(int) if len(rows) else np.zeros(0, int))


def _parts(texts: list[str | None], lines: int = LINES) -> Iterator[slice]:
    """Texts that are scored together: of ``lines`` lines at most, or one."""
    at = held = 0
    for i, text in enumerate(texts):
        n = (text or "").count("\n") + 1
        if i > at and held + n > lines:
            yield slice(at, i)
            at, held = i, 0
        held += n
    if at < len(texts):
        yield slice(at, len(texts))


def classify(docs: DataFrame, model: LineCRF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted; one row per input row.

    Empty and null texts, which have no lines, get the share of good labels as
    score. Very long texts are read whole, all lines in one chain. Rows with
    null or repeated ids are scored like others (a null id is not held out).
    An empty table gives an empty result; other columns aren't read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            score = np.concatenate([model.scores(texts[part]) for part in _parts(texts)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return map_arrow(rows, run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op1_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return classify(docs, train(docs, table(spark, sf_dir, "labels")))
