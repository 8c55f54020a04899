"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the rest.

A rule fits its host and all subdomains, if the path starts with the rule's; the rule of
the longest host, then path, wins. URLs without a rule get the verdict of boosted trees,
trained from the URLs that rules label. Features of a whole URL: lengths, depth, digit ratios, character
entropy, parameter counts, host labels, and suffix statistics (how often labelled URLs of
the host's last label and last two labels are blocked, smoothed towards the mean; for a training row, of
the other folds' URLs only). Each tree sees a random part of the features.

The fit draws at most ``MOST_TRAIN`` distinct labelled URLs, by a hash. Where rules label nothing,
URLs without a rule are allowed.

Defined results: a null URL, or one without ``://``, has empty host and path and no rule; repeated rows get equal
results; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.batches import bound_batches, drawn

# Fixed values of the contract: (host, path prefix, verdict).
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
MOST_TRAIN = 20_000
ROUNDS = 40
DEPTH = 3
RATE = 0.2
BINS = 32
LEAST = 5
FOLDS = 5
COLUMNS = 0.4


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ? or #; A-Z lower-cased."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    raw = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null without one."""
    out = None
    for name, prefix, verdict in sorted(rules, key=lambda r: (-len(r[0]), -len(r[1]))):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(prefix)
        value = F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


# Features -----------------------------------------------------------------------------

NAMES = (
    "length", "host_length", "path_length", "depth", "labels", "digits", "host_digits", "path_digits",
    "entropy", "host_entropy", "parameters", "fragment", "hyphens", "secure", "last_blocked", "suffix_blocked",
)


def _entropy(text: str) -> float:
    if not text:
        return 0.0
    counts = np.unique(np.frombuffer(text.encode(), np.uint8), return_counts=True)[1]
    p = counts / counts.sum()
    return float(-(p * np.log2(p)).sum())


def _digits(text: str) -> float:
    return sum(map(text.count, "0123456789")) / max(len(text), 1)


def suffixes(host: str) -> tuple[str, str]:
    parts = host.rsplit(".", 2)
    return parts[-1], ".".join(parts[-2:])


def features(urls: list[str | None], hosts: list[str], paths: list[str], stats: dict[str, float], mean: float) -> np.ndarray:
    out = np.zeros((len(urls), len(NAMES)))
    for i, (url, host, path) in enumerate(zip(urls, hosts, paths, strict=True)):
        url = url or ""
        query = url.partition("#")[0].partition("?")[2]
        last, two = suffixes(host)
        out[i] = (
            len(url), len(host), len(path), sum(1 for p in path.split("/") if p), host.count(".") + bool(host), _digits(url), _digits(host), _digits(path),
            _entropy(url), _entropy(host), sum(1 for p in query.split("&") if p), "#" in url, url.count("-"), url[:8].lower() == "https://",
            stats.get(last, mean), stats.get(two, mean),
        )
    return out


# Boosted trees ------------------------------------------------------------------------


class Boosted:
    """Trees of fixed depth on binned features, fitted to the logistic loss by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, *, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, columns: float = 1.0):
        """Each tree sees a random share ``columns`` of the features (fixed seed), so that no single one decides alone."""
        self.depth = depth
        rng, k = np.random.default_rng(7), x.shape[1]
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        codes = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T, strict=True)], axis=1)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(p / (1 - p)))
        margin = np.full(len(y), self.start)
        self.trees = []
        for _ in range(rounds):
            prob = 1 / (1 + np.exp(-margin))
            seen = np.sort(rng.choice(k, max(1, round(columns * k)), replace=False))
            tree, at = self._tree(codes, y - prob, prob * (1 - prob), rate, seen)
            self.trees.append(tree)
            margin += tree[2][at]

    def _tree(self, codes: np.ndarray, g: np.ndarray, h: np.ndarray, rate: float, seen: np.ndarray):
        """(split feature, split code, leaf values) as complete binary arrays, and each row's leaf."""
        n = len(codes)
        inner = (1 << self.depth) - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, 1 << 30)
        at = np.zeros(n, np.int64)
        width = max(len(c) for c in self.cuts) + 1
        for level in range(self.depth):
            first, nodes = (1 << level) - 1, 1 << level
            local = at - first
            best = np.zeros(nodes)
            for f in seen.tolist():
                cell = local * width + codes[:, f]
                gs, hs, ns = (np.bincount(cell, w, nodes * width).reshape(nodes, width).cumsum(axis=1) for w in (g, h, np.ones(n)))
                gain = gs**2 / (hs + 1) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + 1) - gs[:, -1:] ** 2 / (hs[:, -1:] + 1)
                gain[(ns < LEAST) | (ns[:, -1:] - ns < LEAST)] = 0
                top = np.argmax(gain, axis=1)
                value = gain[np.arange(nodes), top]
                better = value > best + 1e-9
                best[better], feature[first:][:nodes][better], cut[first:][:nodes][better] = value[better], f, top[better]
            at = 2 * at + 1 + (codes[np.arange(n), feature[at]] > cut[at])
        leaf = at - inner
        leaves = 1 << self.depth
        value = rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + 1)
        return (feature, cut, value), leaf

    def probability(self, x: np.ndarray) -> np.ndarray:
        codes = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T, strict=True)], axis=1)
        margin, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (codes[rows, feature[at]] > cut[at])
            margin += value[at - ((1 << self.depth) - 1)]
        return 1 / (1 + np.exp(-margin))


class SuffixStats:
    """Share of blocked URLs by the host's last label and last two labels, smoothed towards the mean."""

    def __init__(self, hosts: list[str], y: np.ndarray):
        self.mean = float(y.mean()) if len(y) else 0.5
        sums: dict[str, list[float]] = {}
        for host, v in zip(hosts, y.tolist(), strict=True):
            for s in set(suffixes(host)):
                one = sums.setdefault(s, [0.0, 0.0])
                one[0] += v
                one[1] += 1
        self.of = {s: (a + 10 * self.mean) / (b + 10) for s, (a, b) in sums.items()}


class UrlModel:
    """Trees over lexical features and suffix statistics.

    A training row's suffix statistics come from the other folds, so no row's own label is among its features.
    ``held_out`` has, for each last label of a host, the rows of one fold and the accuracy of trees that were
    fitted to the other folds.
    """

    def __init__(self, rows: pd.DataFrame):
        y = (rows["verdict"] == "block").to_numpy(float)
        urls, hosts, paths = (rows[c].tolist() for c in ("url", "host", "path"))
        fold = np.array([zlib.crc32((u or "").encode("utf-8", "surrogatepass")) % FOLDS for u in urls])
        x = np.zeros((len(rows), len(NAMES)))
        for f in range(FOLDS):
            at, rest = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
            if len(at):
                stats = SuffixStats([hosts[i] for i in rest], y[rest])
                x[at] = features([urls[i] for i in at], [hosts[i] for i in at], [paths[i] for i in at], stats.of, stats.mean)
        self.stats = SuffixStats(hosts, y)
        self.trees = Boosted(x, y, columns=COLUMNS)
        self.held_out: dict[str, tuple[int, float]] = {}
        test, rest = fold == 0, fold != 0
        if test.any() and rest.any():
            right = (Boosted(x[rest], y[rest], columns=COLUMNS).probability(x[test]) >= 0.5) == (y[test] == 1)
            last = np.array([suffixes(hosts[i])[0] for i in np.flatnonzero(test)])
            self.held_out = {str(s): (int((last == s).sum()), float(right[last == s].mean())) for s in np.unique(last)}

    def matrix(self, urls, hosts, paths) -> np.ndarray:
        return features(urls, hosts, paths, self.stats.of, self.stats.mean)

    def blocked(self, urls, hosts, paths) -> np.ndarray:
        return self.trees.probability(self.matrix(urls, hosts, paths))


def _parts(pages: DataFrame, rules) -> DataFrame:
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    return pages.withColumn("_host", host).withColumn("_path", path).withColumn("_rule", rule_of(F.col("_host"), F.col("_path"), rules))


def fit(pages: DataFrame, *, rules=RULES, most: int = MOST_TRAIN) -> UrlModel | None:
    """Learn from at most ``most`` distinct URLs that a rule labels."""
    rows = _parts(pages.select("url"), rules).where(F.col("_rule").isNotNull())
    rows = rows.select("url", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule.verdict").alias("verdict")).distinct()
    rows = drawn(rows, "urls", most, "url").toPandas()
    return UrlModel(rows) if len(rows) else None


def judge(pages: DataFrame, *, rules=RULES, most: int = MOST_TRAIN) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score)."""
    bound_batches(pages.sparkSession)
    model = fit(pages, rules=rules, most=most)
    rows = _parts(pages.select("page_id", "url"), rules)
    if model is None:
        score = F.lit(0.0)
    else:
        shared = pages.sparkSession.sparkContext.broadcast(model)

        @F.pandas_udf("double")
        def run(urls: pd.Series, hosts: pd.Series, paths: pd.Series) -> pd.Series:
            return pd.Series(shared.value.blocked(urls.tolist(), hosts.tolist(), paths.tolist()))

        score = run("url", "_host", "_path")
    out = rows.withColumn("_score", score)
    learned = F.when(F.col("_score") >= 0.5, "block").otherwise("allow")
    return out.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", learned).alias("verdict"), F.col("_score").alias("block_score"))
