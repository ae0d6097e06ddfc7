"""URL filters: gradient-boosted trees on lexical features, behind host and path rules.

Where no labelled URLs are given, those that a rule decides are the labelled ones.
The trees are fitted on about ``TRAIN_ROWS`` of them (those whose hash lies under a
bound that follows from their number, so the same ones however the table is
partitioned) and judge the URLs that no rule decides.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.llm import common

#: Fixed values of the result's contract: rule (host, then path) and verdict.
RULES = {
    "com/": "allow",
    "example.com/en/": "block",
    "www.example.com/en/": "allow",
    "net/es/": "block",
    "net/fr/": "block",
}

#: The bound of the training sample.
TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE, SMOOTH, MIN_ROWS = 40, 3, 32, 0.2, 1.0, 5
#: Parts of the training sample; a part's suffix statistics come from the others.
FOLDS = 5
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parse(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:end], rest[end:]
    path = rest[: min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))]
    return host.translate(_LOWER), path


class Rules:
    """Rules by host; lookup goes through a host and the domains that it belongs to."""

    def __init__(self, rules: dict[str, str] = RULES):
        self.verdicts = rules
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for rule in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((slash + path, rule))

    def match(self, host: str, path: str) -> str | None:
        """The longest rule that fits; of equally long ones, that of the longer host."""
        best, at = None, 0
        while host:
            for start, rule in self.by_host.get(host[at:], ()):
                if path.startswith(start) and (best is None or len(rule) > len(best)):
                    best = rule
            at = host.find(".", at) + 1
            if not at:
                break
        return best


def suffixes(host: str) -> list[str]:
    labels = host.split(".")
    return [".".join(labels[-n:]) for n in (1, 2) if len(labels) >= n]


NAMES = ["url_length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "parameters", "host_labels", "hyphens", "fragment", "longest_segment", "suffix1", "suffix2"]


def features(url: str | None, stats: dict[str, float], prior: float) -> list[float]:
    url = url or ""
    host, path = parse(url)
    n = max(1, len(url))
    query = url.partition("?")[2].partition("#")[0]
    ends = suffixes(host)
    rate1 = stats.get(ends[0], prior) if ends else prior
    return [
        len(url), len(host), len(path), sum(1 for s in path.split("/") if s),
        sum(c.isdigit() for c in url) / n,
        -sum(k / n * math.log2(k / n) for k in Counter(url).values()),
        sum(1 for p in query.split("&") if p), host.count(".") + 1, url.count("-"), float("#" in url),
        max(map(len, path.split("/"))), rate1, stats.get(ends[1], rate1) if len(ends) > 1 else rate1,
    ]


def suffix_statistics(urls: list[str], blocked: list[int], weight: list[int]) -> tuple[dict[str, float], float]:
    """Share of blocked URLs under each host suffix, drawn towards the share among all."""
    prior = (sum(b * w for b, w in zip(blocked, weight)) + 1) / (sum(weight) + 2)
    seen, bad = Counter(), Counter()
    for url, b, w in zip(urls, blocked, weight):
        for s in suffixes(parse(url)[0]):
            seen[s] += w
            bad[s] += b * w
    return {s: (bad[s] + 10 * prior) / (seen[s] + 10) for s in seen}, prior


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int):
    """A regression tree on binned features: nested tuples (feature, bin, left, right), or a leaf's value."""
    gs, hs = g[rows].sum(), h[rows].sum()
    leaf = float(-gs / (hs + SMOOTH))
    if depth == 0 or len(rows) < 2 * MIN_ROWS:
        return leaf
    best, where = 1e-6, None
    for f in range(x.shape[1]):
        b = x[rows, f]
        cg = np.cumsum(np.bincount(b, g[rows], BINS))[:-1]
        ch = np.cumsum(np.bincount(b, h[rows], BINS))[:-1]
        n = np.cumsum(np.bincount(b, minlength=BINS))[:-1]
        gain = cg**2 / (ch + SMOOTH) + (gs - cg) ** 2 / (hs - ch + SMOOTH) - gs**2 / (hs + SMOOTH)
        gain[(n < MIN_ROWS) | (len(rows) - n < MIN_ROWS)] = -1
        k = int(gain.argmax())
        if gain[k] > best:
            best, where = gain[k], (f, k)
    if where is None:
        return leaf
    f, k = where
    left = x[rows, f] <= k
    return (f, k, _grow(x, g, h, rows[left], depth - 1), _grow(x, g, h, rows[~left], depth - 1))


def _value(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, k, left, right = tree
    return np.where(x[:, f] <= k, _value(left, x), _value(right, x))


class Trees:
    """Boosted trees for the log-odds of being blocked."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        self.cuts = [np.unique(np.quantile(c, np.arange(1, BINS) / BINS)) for c in x.T] if len(x) else []
        self.start, self.trees = math.log(((y * weight).sum() + 1) / ((weight - y * weight).sum() + 1)), []
        if len(x) == 0 or y.min() == y.max():
            return
        b, at, rows = self.binned(x), np.full(len(y), self.start), np.arange(len(y))
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-at))
            tree = _grow(b, weight * (p - y), weight * p * (1 - p), rows, DEPTH)
            self.trees.append(tree)
            at += RATE * _value(tree, b)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T)], axis=1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.full(len(x), self.start)
        if self.trees and len(x):
            b = self.binned(x)
            for tree in self.trees:
                at += RATE * _value(tree, b)
        return 1 / (1 + np.exp(-at))


class Model:
    def __init__(self, urls: list[str], blocked: list[int], weight: list[int]):
        """``weight``: how many rows each URL stands for."""
        self.stats, self.prior = suffix_statistics(urls, blocked, weight)
        # The trees learn from statistics of other URLs than their own, as they will judge others.
        fold = [zlib.crc32(u.encode()) % FOLDS for u in urls]
        rows: list = [None] * len(urls)
        for k in range(FOLDS):
            others = [i for i, f in enumerate(fold) if f != k]
            stats, prior = suffix_statistics(*([c[i] for i in others] for c in (urls, blocked, weight)))
            for i, f in enumerate(fold):
                if f == k:
                    rows[i] = features(urls[i], stats, prior)
        x = np.array(rows).reshape(len(urls), len(NAMES))
        self.trees = Trees(x, np.array(blocked, dtype=float), np.array(weight, dtype=float))

    def predict(self, urls: list[str | None]) -> np.ndarray:
        return self.trees.predict(np.array([features(u, self.stats, self.prior) for u in urls]).reshape(len(urls), len(NAMES)))


def rule_labels(pages: DataFrame, url_col: str = "url", rules: dict[str, str] = RULES) -> DataFrame:
    """url and blocked (0 or 1) of the URLs that a rule decides."""
    held = Rules(rules)
    schema = T.StructType([T.StructField("url", T.StringType()), T.StructField("blocked", T.LongType())])

    def label(batch: pa.RecordBatch) -> dict:
        out: dict = {"url": [], "blocked": []}
        for url in batch.column("url").to_pylist():
            if rule := held.match(*parse(url)):
                out["url"].append(url)
                out["blocked"].append(int(rules[rule] == "block"))
        return out

    return common.map_arrow(pages.select(pages[url_col].cast("string").alias("url")), label, schema)


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Fit on about ``train_rows`` labelled URLs (url, blocked: 0 or 1); rows without a label are not used.

    Only they come to the driver.  Equal URLs have equal hashes, so that a URL is
    taken with all its copies or not at all; one row
    stands for all copies of a URL with a label, with their number as its weight.
    """
    counted = labelled.where(F.col("blocked").isNotNull()).groupBy("url", "blocked").agg(F.count("*").alias("n"))
    total = counted.count()
    if total > train_rows:
        counted = counted.where(F.pmod(F.xxhash64("url"), F.lit(1 << 30)) < int((1 << 30) * train_rows / total))
    rows = sorted(tuple(r) for r in counted.select(F.coalesce("url", F.lit("")).alias("url"), "blocked", "n").collect())
    return Model([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows])


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: dict[str, str] = RULES, train_rows: int = TRAIN_ROWS, labelled: DataFrame | None = None) -> DataFrame:
    """One row for each row of ``pages``: id, host, path, the rule that decides or null, verdict, and the trees' block score.

    ``labelled`` has labelled URLs (url, blocked) to learn from instead of the rules'.
    Null URLs and those without ``://`` have empty host and path and no rule;
    the trees judge them by the features of the text that there is.  Without
    labelled URLs, or with one verdict among them, the trees give that share.
    Repeated rows are each judged; only the id and the URL are read.
    """
    model = fit(rule_labels(pages, url_col, rules) if labelled is None else labelled, train_rows)
    text = T.StringType()
    schema = T.StructType(
        [T.StructField("page_id", pages.schema[id_col].dataType)]
        + [T.StructField(n, text) for n in ("host", "path", "rule", "verdict")]
        + [T.StructField("score", T.DoubleType())]
    )

    def run(batch: pa.RecordBatch, held: Rules) -> dict:
        urls = batch.column("url").to_pylist()
        parts = [parse(u) for u in urls]
        found = [held.match(*p) for p in parts]
        scores = model.predict(urls).tolist()
        verdicts = [rules[r] if r else "block" if s >= 0.5 else "allow" for r, s in zip(found, scores)]
        return {"page_id": batch.column("page_id"), "host": [h for h, _ in parts], "path": [p for _, p in parts], "rule": found, "verdict": verdicts, "score": scores}

    df = pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url"))
    return common.map_arrow(df, run, schema, setup=lambda: Rules(rules))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages"))
