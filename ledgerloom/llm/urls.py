"""URL filters: allow and block rules, and gradient-boosted trees for what no rule covers.

URLs that a rule covers are the labelled ones: they train boosted regression trees (logistic loss,
histogram splits) on lexical features: lengths, depth, digit ratio, entropy, parameter counts, and
suffix statistics (smoothed block rates of the host's last one and two labels, and of the file
suffix, over the labelled URLs). Training takes a bounded sample of labelled rows, each with the rates of the other
``FOLDS`` - 1 folds of URLs, so that no row sees its own label; the statistics and the verdicts cover every row.

Edge cases: a null url or one without ``://`` has an empty host and path, no rule, and is judged on
its features like any other. Without labelled URLs of both kinds there is nothing to learn: every
verdict is then the only label's, or ``allow``. Repeated rows and null ids are judged each; an empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, first_by_hash

#: Fixed values: (host, path, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Labelled rows that the trees are fitted on, at most (the first by hash of url and page_id, so that a hot url is in it by its share only).
SAMPLE = 20_000
FOLDS = 5
TREES, DEPTH, RATE, BINS, LEAST_LEAF = 40, 3, 0.2, 32, 20.0
SMOOTHING = 20.0
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "path_digits", "entropy", "parameters", "query_length", "hyphens", "fragment", "https", "suffix1", "suffix2", "file_suffix")


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    has = url.contains("://")
    host = F.when(has, ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))).otherwise("")
    path = F.when(has, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise("")
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def with_rule(pages: DataFrame) -> DataFrame:
    """Adds host, path, rule (the longest that fits, as written, else null) and label (its verdict)."""
    host, path = host_path(F.col("url"))
    out = pages.withColumns({"host": host, "path": path})
    rule, label = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, verdict in sorted(RULES, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, label = F.when(fits, h + p).otherwise(rule), F.when(fits, verdict).otherwise(label)
    return out.withColumns({"rule": rule, "label": label})


def suffixes(host: Column, path: Column) -> list[Column]:
    """The host's last label, its last two, and the file suffix."""
    return [F.regexp_extract(host, r"([^.]*)$", 1), F.regexp_extract(host, r"([^.]*\.[^.]*|[^.]*)$", 1), F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1)]


def _entropy(text: str) -> float:
    if not text:
        return 0.0
    counts = np.unique(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), return_counts=True)[1]
    p = counts / counts.sum()
    return float(-(p * np.log2(p)).sum())


_DIGIT = regex.compile("[0-9]")


def features(urls: list[str | None], hosts: list[str], paths: list[str], stats: list[list[float]]) -> np.ndarray:
    out = np.zeros((len(urls), len(FEATURES)), np.float32)
    for i, (u, h, p) in enumerate(zip(urls, hosts, paths, strict=True)):
        u = u or ""
        query = u.partition("?")[2].partition("#")[0]
        out[i] = (
            len(u), len(h), len(p), sum(1 for x in p.split("/") if x), h.count(".") + 1 if h else 0, len(_DIGIT.findall(u)) / max(1, len(u)), len(_DIGIT.findall(p)),
            _entropy(u), sum(1 for x in query.split("&") if x), len(query), u.count("-"), "#" in u, u.startswith("https:"), *(s[i] for s in stats),
        )
    return out


class BoostedTrees:
    """Binary classification by gradient boosting over binned features; trees are full, of one depth."""

    def __init__(self, edges: list[np.ndarray], base: float, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        self.edges, self.base, self.trees = edges, base, trees

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> BoostedTrees:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        mean = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        base = float(np.log(mean / (1 - mean)))
        score = np.full(len(y), base)
        made = []
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, np.maximum(p * (1 - p), 1e-9)
            feature, cutoff = np.zeros(2**depth - 1, np.int32), np.full(2**depth - 1, bins, np.int32)
            node = np.zeros(len(y), np.int64)
            for level in range(depth):
                first = 2**level - 1
                width = 2**level
                best = np.zeros(width)
                for j in range(x.shape[1]):
                    at = (node - first) * bins + binned[:, j]
                    g = np.bincount(at, grad, width * bins).reshape(width, bins).cumsum(axis=1)
                    h = np.bincount(at, hess, width * bins).reshape(width, bins).cumsum(axis=1)
                    gt, ht = g[:, -1:], h[:, -1:]
                    gain = g**2 / (h + 1) + (gt - g) ** 2 / (ht - h + 1) - gt**2 / (ht + 1)
                    gain[(h < LEAST_LEAF / 8) | (ht - h < LEAST_LEAF / 8)] = 0
                    k = gain.argmax(axis=1)
                    top = gain[np.arange(width), k]
                    won = top > best + 1e-9
                    best[won] = top[won]
                    feature[first : first + width][won], cutoff[first : first + width][won] = j, k[won]
                node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > cutoff[node])
            leaf = node - (2**depth - 1)
            value = rate * np.bincount(leaf, grad, 2**depth) / (np.bincount(leaf, hess, 2**depth) + 1)
            score += value[leaf]
            made.append((feature, cutoff, value))
        return cls(edges, base, made)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of the positive class."""
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)
        score = np.full(len(x), self.base)
        for feature, cutoff, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(value)))):
                node = 2 * node + 1 + (binned[np.arange(len(x)), feature[node]] > cutoff[node])
            score += value[node - len(feature)]
        return 1 / (1 + np.exp(-score))


def fold(url: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(3), url), F.lit(FOLDS)).cast("int")


def suffix_rates(ruled: DataFrame) -> tuple[list[DataFrame], float, int]:
    """(suffix, rates) of each kind of suffix over all labelled URLs, smoothed to the overall rate: without each fold, then of all; that rate, and the labelled rows."""
    labelled = ruled.where(F.col("label").isNotNull())
    block = (F.col("label") == "block").cast("double")
    overall, n = labelled.agg(F.coalesce(F.avg(block), F.lit(0.0)), F.count(F.lit(1))).first()

    def rate(without: int | None) -> Column:
        own = F.lit(True) if without is None else fold(F.col("url")) != without
        return (F.coalesce(F.sum(F.when(own, block)), F.lit(0.0)) + SMOOTHING * overall) / (F.count(F.when(own, 1)) + SMOOTHING)

    rates = F.array(*(rate(f) for f in (*range(FOLDS), None))).alias("rates")
    # Written once, so that they aren't counted again for the sample and for the verdicts, and their size is known when the join is planned.
    each = enumerate(suffixes(F.col("host"), F.col("path")))
    return [cut(labelled.groupBy(c.alias("suffix")).agg(rates), f"suffix{i}") for i, c in each], overall, n


def judge(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule, verdict, p_block (null where a rule decides) of every page."""
    ruled = with_rule(pages.select("page_id", "url"))
    rates, overall, n = suffix_rates(ruled)
    x = ruled
    for i, (c, rate) in enumerate(zip(suffixes(F.col("host"), F.col("path")), rates, strict=True)):
        x = x.withColumn(f"_s{i}", c).join(rate.withColumnsRenamed({"suffix": f"_s{i}", "rates": f"_r{i}"}), f"_s{i}", "left")
    at = F.when(F.col("label").isNull(), FOLDS).otherwise(fold(F.col("url")))
    x = x.select("page_id", "url", "host", "path", "rule", "label", *(F.coalesce(F.get(f"_r{i}", at), F.lit(overall)).alias(f"r{i}") for i in range(3)))
    labelled = first_by_hash(x.where(F.col("label").isNotNull()), n, sample, "url", "page_id").toPandas()
    y = (labelled["label"] == "block").to_numpy(float)
    only = "block" if len(y) and y.all() else "allow"
    trees = None
    if len(y) and 0 < y.sum() < len(y):
        trees = BoostedTrees.fit(features(labelled["url"].tolist(), labelled["host"].tolist(), labelled["path"].tolist(), [labelled[f"r{i}"].tolist() for i in range(3)]), y)
    kind = dict(pages.dtypes)["page_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = {n: b.column(n).to_pylist() for n in ("url", "host", "path", "label", "r0", "r1", "r2")}
            verdict, p = list(col["label"]), [None] * len(b)
            ask = [i for i, v in enumerate(verdict) if v is None]
            if ask:
                score = trees.predict(features(*([col[n][i] for i in ask] for n in ("url", "host", "path")), [[col[f"r{k}"][i] for i in ask] for k in range(3)])) if trees else np.full(len(ask), float(only == "block"))
                for i, s in zip(ask, score, strict=True):
                    verdict[i], p[i] = "block" if s >= 0.5 else "allow", float(s)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("host"), b.column("path"), b.column("rule"), pa.array(verdict, pa.string()), pa.array(p, pa.float64())], names=["page_id", "host", "path", "rule", "verdict", "p_block"])

    return x.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, p_block double")
