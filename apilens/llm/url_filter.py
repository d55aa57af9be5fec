"""URL filters: host and path rules, and gradient-boosted trees on lexical features.

The trees are trained from URLs that rules label (or any labelled URLs), on a
bounded sample; features are lengths, depth, digit ratio, entropy, parameter
counts, and statistics of the host's suffix taken from the training URLs: for
these URLs themselves, from other folds, so that no URL's own label is in its
features.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apilens.llm.common import map_arrow, table

#: The rules of the query: verdict, host, start of the path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MAX_LABELS = 8000  # bound of the labelled URLs that the trees are trained on
FOLDS = 5  # of the training URLs
PRIOR = 20.0  # weight of the mean in a suffix's statistics
FEATURES = ("length", "host_length", "path_length", "labels", "depth", "digits", "host_digits", "dashes", "entropy", "params", "query_length", "fragment", "secure", "longest", "suffix", "domain", "first")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; both empty where there is no ``://``."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule that fits and is longest, written as host and path, and its verdict; nulls where none fits."""
    name = verdict = None
    for kind, at, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        name = F.when(fits, at + start) if name is None else name.when(fits, at + start)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def _parts(host: str, path: str) -> tuple[str, str, str]:
    labels = host.split(".")
    return labels[-1], ".".join(labels[-2:]), path.split("/", 2)[1] if path.count("/") else ""


def suffix_statistics(hosts: list[str], paths: list[str], blocked: np.ndarray) -> list[dict[str, float]]:
    """Per top-level name, per last two names, per first path segment: the smoothed share that is blocked."""
    mean, out = float(blocked.mean()) if len(blocked) else 0.5, []
    parts = [_parts(h, p) for h, p in zip(hosts, paths, strict=True)]
    for k in range(3):
        seen, bad = Counter(), Counter()
        for p, b in zip(parts, blocked, strict=True):
            seen[p[k]] += 1
            bad[p[k]] += float(b)
        out.append({"": mean} | {key: (bad[key] + PRIOR * mean) / (n + PRIOR) for key, n in seen.items()})
    return out


def lexical(urls: list[str], hosts: list[str], paths: list[str], stats: list[dict[str, float]]) -> np.ndarray:
    """The FEATURES of each URL."""
    rows = []
    for url, host, path in zip(urls, hosts, paths, strict=True):
        url = url or ""
        n, counts = max(1, len(url)), Counter(url)
        query = url.partition("#")[0].partition("?")[2]
        digits = sum(map(str.isdigit, url))
        entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
        keys = _parts(host, path)
        rows.append((
            len(url), len(host), len(path), host.count(".") + 1, path.count("/"), digits / n, sum(map(str.isdigit, host)) / max(1, len(host)), counts["-"] + counts["_"], entropy,
            query.count("&") + (query != ""), len(query), "#" in url, url.startswith("https:"), max(map(len, re.split(r"[^0-9A-Za-z]+", path))), *(s.get(k, s[""]) for s, k in zip(stats, keys, strict=True)),
        ))
    return np.asarray(rows, float).reshape(-1, len(FEATURES))


class BoostedTrees:
    """Binary trees of fixed depth on binned features, boosted on logistic loss with second-order gains."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0):
        self.n, self.depth, self.rate, self.bins, self.ridge, self.trees, self.base = trees, depth, rate, bins, ridge, [], 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        mean = min(1 - 1e-3, max(1e-3, float(y.mean()) if len(y) else 0.5))
        self.base = math.log(mean / (1 - mean))
        if not len(y) or y.min() == y.max():
            return self
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1], method="nearest")) for j in range(x.shape[1])]
        binned = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])
        raw, width = np.full(len(y), self.base), self.bins
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-raw))
            g, h, node, tree = y - p, p * (1 - p), np.zeros(len(y), int), []
            for level in range(self.depth):
                size, best = 1 << level, None
                g_all, h_all = np.bincount(node, g, size), np.bincount(node, h, size)
                gain, split = np.full(size, 1e-6), [(0, math.inf, self.bins)] * size
                for j, c in enumerate(cuts):
                    key = node * width + binned[:, j]
                    gl = np.cumsum(np.bincount(key, g, size * width).reshape(size, width), 1)[:, : len(c)]
                    hl = np.cumsum(np.bincount(key, h, size * width).reshape(size, width), 1)[:, : len(c)]
                    gr, hr = g_all[:, None] - gl, h_all[:, None] - hl
                    worth = gl**2 / (hl + self.ridge) + gr**2 / (hr + self.ridge) - (g_all**2 / (h_all + self.ridge))[:, None]
                    for s in range(size) if len(c) else ():
                        k = int(worth[s].argmax())
                        if worth[s, k] > gain[s]:
                            gain[s], split[s] = worth[s, k], (j, float(c[k]), k)
                tree.append(([s[0] for s in split], [s[1] for s in split]))
                features, bounds = np.array([s[0] for s in split]), np.array([s[2] for s in split])
                node = 2 * node + (binned[np.arange(len(y)), features[node]] > bounds[node])
            leaves = self.rate * np.bincount(node, g, 1 << self.depth) / (np.bincount(node, h, 1 << self.depth) + self.ridge)
            self.trees.append((tree, leaves))
            raw += leaves[node]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The probability of the positive class."""
        raw, at = np.full(len(x), self.base), np.arange(len(x))
        for tree, leaves in self.trees:
            node = np.zeros(len(x), int)
            for features, bounds in tree:
                node = 2 * node + (x[at, np.array(features)[node]] > np.array(bounds)[node])
            raw += leaves[node]
        return 1 / (1 + np.exp(-raw))


def parsed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """page_id, url, host, path, rule, ruled (the rule's verdict)."""
    host, path = host_and_path(F.col("url"))
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).withColumns({"host": host, "path": path})
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    return base.withColumns({"rule": rule, "ruled": verdict})


def fitted(urls: list[str], hosts: list[str], paths: list[str], blocked: np.ndarray) -> tuple[list[dict[str, float]], BoostedTrees]:
    """Statistics of all URLs, and trees fitted with the statistics of the other folds than the URL's own."""
    fold, x = np.arange(len(urls)) % FOLDS, np.zeros((len(urls), len(FEATURES)))
    for k in range(FOLDS):
        rest, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        others = suffix_statistics([hosts[i] for i in rest], [paths[i] for i in rest], blocked[rest])
        x[own] = lexical([urls[i] for i in own], [hosts[i] for i in own], [paths[i] for i in own], others)
    return suffix_statistics(hosts, paths, blocked), BoostedTrees().fit(x, blocked)


def train(labelled: DataFrame, max_labels: int = MAX_LABELS) -> tuple[list[dict[str, float]], BoostedTrees] | None:
    """Statistics and trees from (url, host, path, ruled), at most ``max_labels`` distinct URLs of each verdict; none without any."""
    known = labelled.filter("ruled IS NOT NULL").select("url", "host", "path", "ruled").distinct()
    order = [F.xxhash64("url"), F.col("url")]
    rows = [r for kind in ("block", "allow") for r in known.filter(F.col("ruled") == kind).orderBy(*order).limit(max_labels).collect()]
    blocked = np.array([r.ruled == "block" for r in rows], float)
    return fitted([r.url for r in rows], [r.host for r in rows], [r.path for r in rows], blocked) if rows else None


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", max_labels: int = MAX_LABELS) -> DataFrame:
    """page_id, host, path, rule, verdict, score; one row per input row.

    A rule fits its host and all subdomains if the path starts with the rule's;
    the longest wins. Where none fits, the trees' probability of a block decides
    (block at 0.5 and more). Null URLs and those without ``://`` have empty host
    and path; very long ones are read whole. Rows with null or repeated ids are
    judged like others. Where no URL is labelled, nothing speaks against any:
    they are allowed, with a null score. An empty table gives an empty result;
    other columns aren't read.
    """
    rows = parsed(pages, id_col, url_col, rules)
    model = train(rows, max_labels)
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = {c: b.column(c).to_pylist() for c in ("url", "host", "path", "ruled")}
            score = model[1].predict(lexical(text["url"], text["host"], text["path"], model[0])).tolist() if model else [None] * b.num_rows
            verdict = [r or ("block" if s is not None and s >= 0.5 else "allow") for r, s in zip(text["ruled"], score, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("host"), b.column("path"), b.column("rule"), pa.array(verdict, pa.string()), pa.array(score, pa.float64())], names=["page_id", "host", "path", "rule", "verdict", "score"])

    return map_arrow(rows, run, f"page_id {kind}, host string, path string, rule string, verdict string, score double")


def op9_url_filter(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"))
