"""Language identification by hierarchical discrimination.

A text's features are hashed character 1-, 2- and 3-grams of its letters (lower-cased, runs of
other characters as one space), square roots of their counts, at unit length. First the
language family is predicted by linear support vector machines, one for each family
against the rest; within the family, one linear support vector machine for each pair of languages
(one-versus-one) decides by summed margins. Machines minimise the squared hinge loss.

Families are fixed values; a learned language outside the table is a family of its own. Every value of
lang is learned, however rare. The fit draws, by a hash of the id, at most ``PER_LANGUAGE`` documents a
language and ``MOST_TRAIN`` in all, but at least ``LEAST`` of each language (so the bound grows with the
number of languages beyond ``MOST_TRAIN`` / ``LEAST``), and reads their texts whole, as prediction does.

Defined results: ``und`` with score 0 for null texts and texts without a letter, and where
nothing could be learned; documents without lang are not learned from; repeated rows
get equal results; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.batches import bound_batches, held_out, uniform

# Families of ISO 639-1 codes.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "mk", "sr", "hr", "bs", "sl"),
    "baltic": ("lt", "lv"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "tt"),
    "indic": ("hi", "bn", "ur", "mr", "ne", "pa", "gu"),
    "semitic": ("ar", "he", "mt", "am"),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

PER_LANGUAGE = 800
MOST_TRAIN = 4000
LEAST = 10
FEATURES = 1 << 12
STEPS = 150
PENALTY = 1e-3
SLICE = 1 << 20
BLOCK = 128
NOT_LETTERS = re.compile(r"[\W\d_]+")


def features(text: str | None) -> np.ndarray | None:
    """Unit-length feature vector, None without a letter."""
    if not text:
        return None
    letters = NOT_LETTERS.sub(" ", text.lower()).strip(" ")
    if not any(map(str.isalpha, letters[:64])) and not any(map(str.isalpha, letters)):
        return None
    counts = np.zeros(FEATURES, np.int64)
    codes = np.frombuffer(f" {letters} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    for at in range(0, len(codes), SLICE):
        c = codes[at : at + SLICE + 2]
        one = c * np.uint64(0x9E3779B97F4A7C15)
        two = (one[:-1] ^ (one[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + one[1:]
        three = (two[:-1] ^ (two[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + one[2:]
        for h in (one[:SLICE], two[:SLICE], three[:SLICE]):
            h = h * np.uint64(0x94D049BB133111EB)
            counts += np.bincount((h >> np.uint64(52)).astype(np.int64), minlength=FEATURES)
    x = np.sqrt(counts, dtype=np.float32)
    return x / np.sqrt(x @ x)


def train_svm(x: np.ndarray, y: np.ndarray, *, steps: int = STEPS, penalty: float = PENALTY) -> np.ndarray:
    """Weights (features + bias) of a linear machine for y in -1, 1, classes weighed alike.

    Accelerated gradient steps on the squared hinge loss with an L2 penalty.
    """
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w = np.zeros(x.shape[1] + 1, np.float32)
    v, t = w.copy(), 1.0
    rate = 1 / (2 * 2.0 + penalty)  # rows have length 1 and a bias of 1
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v[:-1] + v[-1])) * y * weight
        gradient = np.r_[-2 * (x.T @ slack), -2 * slack.sum()] + penalty * v
        new, t_new = v - rate * gradient, (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t_new * (new - w)
        w, t = new.astype(np.float32), t_new
        v = v.astype(np.float32)
    return w


class Hierarchy:
    """Family machines, and pairwise machines within each family."""

    def __init__(self, x: np.ndarray, langs: np.ndarray):
        self.langs = sorted(set(langs))
        of = {lang: FAMILY_OF.get(lang, f"only {lang}") for lang in self.langs}
        self.families = sorted(set(of.values()))
        self.members = {f: [lang for lang in self.langs if of[lang] == f] for f in self.families}
        family = np.array([of[lang] for lang in langs])
        machines = [train_svm(x, np.where(family == f, 1.0, -1.0).astype(np.float32)) for f in self.families] if len(self.families) > 1 else []
        self.pairs = []
        for f in self.families:
            for a, b in combinations(self.members[f], 2):
                rows = (langs == a) | (langs == b)
                self.pairs.append((f, a, b))
                machines.append(train_svm(x[rows], np.where(langs[rows] == a, 1.0, -1.0).astype(np.float32)))
        self.weights = np.stack(machines, axis=1) if machines else np.zeros((FEATURES + 1, 0), np.float32)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        margins = (x @ self.weights[:-1] + self.weights[-1]).astype(np.float64)
        k = len(self.families) if len(self.families) > 1 else 0
        odds = 1 / (1 + np.exp(-4 * np.clip(margins, -20, 20)))
        if k:
            share = odds[:, :k] / odds[:, :k].sum(axis=1, keepdims=True)
            best = np.argmax(margins[:, :k], axis=1)
        else:
            share, best = np.ones((len(x), 1)), np.zeros(len(x), int)
        names, scores = np.empty(len(x), object), np.empty(len(x))
        for i, f in enumerate(self.families):
            rows = np.flatnonzero(best == i)
            langs = self.members[f]
            votes = np.zeros((len(rows), len(langs)))
            for j, (g, a, b) in enumerate(self.pairs):
                if g == f:
                    m = np.clip(margins[rows, k + j], -2, 2)
                    votes[:, langs.index(a)] += m
                    votes[:, langs.index(b)] -= m
            pick = np.argmax(votes, axis=1)
            soft = np.exp(4 * (votes - votes.max(axis=1, keepdims=True)) / max(len(langs) - 1, 1))
            names[rows] = np.array(langs, object)[pick]
            scores[rows] = share[rows, i] * soft[np.arange(len(rows)), pick] / soft.sum(axis=1)
        return names.tolist(), np.clip(scores, 0, 1)

    def texts(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        for lo in range(0, len(texts), BLOCK):
            made = [(i, v) for i, t in enumerate(texts[lo : lo + BLOCK], lo) if (v := features(t)) is not None]
            if made:
                got, s = self.predict(np.stack([v for _, v in made]))
                for (i, _), name, one in zip(made, got, s, strict=True):
                    names[i], scores[i] = name, one
        return names, scores


def fit(docs: DataFrame, *, per_language: int = PER_LANGUAGE, most: int = MOST_TRAIN) -> Hierarchy | None:
    """Learn every lang of ``docs`` from at most ``per_language`` rows of it, fewer where that makes more than ``most`` in all, but at least ``LEAST``."""
    docs = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    counts = docs.groupBy("lang").count().collect()
    if not counts:
        return None
    each = max(LEAST, min(per_language, most // len(counts)))
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, (1.5 * each + 50) / r["count"])) for r in counts], "lang string, _share double")
    some = docs.select("doc_id", "lang", "text").join(F.broadcast(shares), "lang").where(uniform("lang", "doc_id") < F.col("_share"))  # a row a language
    place = F.row_number().over(Window.partitionBy("lang").orderBy(uniform("lang", "id"), "id", "x"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            got = [features(t) for t in p["text"]]
            yield pd.DataFrame({"id": p["doc_id"], "lang": p["lang"], "x": [None if g is None else g.astype(np.float16).tobytes() for g in got]})

    rows = some.select("doc_id", "lang", "text").mapInPandas(run, "id long, lang string, x binary").where("x is not null")
    rows = rows.groupBy("id", "lang").agg(F.min("x").alias("x")).withColumn("_place", place)  # one text of an id, however often it stands there
    rows = rows.where(F.col("_place") <= each).orderBy("lang", "_place").toPandas()
    if not len(rows):
        return None
    return Hierarchy(np.stack([np.frombuffer(v, np.float16).astype(np.float32) for v in rows["x"]]), rows["lang"].to_numpy())


def identify(docs: DataFrame, model: Hierarchy | None, text: str = "text") -> Column:
    """Struct (lang, score) for a text column; the model's size is bounded by the machines' number."""
    bound_batches(docs.sparkSession)
    if model is None:
        return F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        names, scores = shared.value.texts(texts.tolist())
        return pd.DataFrame({"lang": names, "score": scores})

    return run(F.col(text))


def predict(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from documents that are not held out (crc32 mod 3 is 1)."""
    out = held_out(F.col("doc_id"), 3, 1)
    model = fit(docs.where(~out), **options)
    got = docs.select("doc_id", out.alias("held_out"), identify(docs, model).alias("_got"))
    return got.select("doc_id", "held_out", F.col("_got.lang").alias("lang_pred"), F.col("_got.score").alias("score"))
