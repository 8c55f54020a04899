"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms of a whole text are of two kinds: hashed lower-cased words, and style terms (pairs of
neighbouring character classes; bands of length, repetition, repeated lines and symbol density).
Counts are damped, weighted by inverse document frequency and brought to unit length for each
kind. A truncated singular value decomposition of the labelled sample's term matrix gives
the latent space. The sample's vectors and labels are broadcast (``MOST_TRAIN`` rows of ``RANK``
numbers at most); each document's exact cosine with all of them is a blocked matrix
product, and the ``NEIGHBOURS`` nearest vote with weights that grow with similarity.

The fit draws at most ``MOST_TRAIN`` labelled rows, by a hash of the id; only labels and texts
are used. Scoring reads every text whole.

Defined results: null and empty texts have no word and score as their few style terms say; a
row without a label is only scored; without any labelled row every score is 0.5; labels other than 0 and 1
or null are not learned from; repeated rows score alike; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.batches import bound_batches, drawn, held_out

MOST_TRAIN = 4000
RANK = 48
NEIGHBOURS = 25
POWER = 40
WORDS = 2048
THRESHOLD = 0.3
BLOCK = 256

_CLASSES = 16
_PUNCT = {c: i for i, cs in enumerate((b" ", b"\n", b".,;:", b"!?", b"'\"()", b"-_", b"#*", b"$%&", b"|<>[]{}", b"/\\@=+~^`")) for c in cs}


def _class_table() -> bytes:
    """Byte to class: 0-9 punctuation kinds, 10 lower, 11 upper, 12 digit, 13 beyond ASCII, 14 other."""
    out = bytearray([14] * 256)
    for b in range(256):
        c = bytes([b])
        out[b] = 10 if c.islower() else 11 if c.isupper() else 12 if c.isdigit() else 13 if b >= 128 else _PUNCT.get(b, 14)
    return bytes(out)


TABLE = _class_table()
PAIRS = _CLASSES * _CLASSES
BANDS = np.array([0.001, 0.01, 0.03, 0.06, 0.1, 0.2, 0.3, 0.45, 0.6, 0.8])
N_BANDS = len(BANDS) + 1
MEASURES = 8
STYLE = PAIRS + MEASURES * N_BANDS
TERMS = WORDS + STYLE
SLICE = 1 << 20


def terms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers and damped counts; numbers below ``WORDS`` are words."""
    raw = (text or "").encode()
    tokens = raw.lower().split()
    n = max(len(tokens), 1)
    seen = Counter(tokens)
    words = np.zeros(WORDS, np.float32)
    for w, c in seen.items():
        words[zlib.crc32(w) % WORDS] += c
    pairs = np.zeros(PAIRS, np.int64)
    for at in range(0, len(raw), SLICE):
        cls = np.frombuffer(raw[at : at + SLICE + 1].translate(TABLE), np.uint8)
        pairs += np.bincount(cls[:-1].astype(np.int64) * _CLASSES + cls[1:], minlength=PAIRS)
    by_class = pairs.reshape(_CLASSES, _CLASSES).sum(axis=1)
    total = max(int(pairs.sum()), 1)
    letters = max(int(by_class[10] + by_class[11] + by_class[13]), 1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    measures = (
        sum(a == b for a, b in zip(tokens, tokens[1:], strict=False)) / n,
        1 - len(seen) / n,
        1 - len(set(lines)) / max(len(lines), 1),
        max(seen.values(), default=0) / n,
        (by_class[6] + by_class[7] + by_class[8]) / n / 4,
        by_class[11] / letters,
        by_class[12] / total,
        min(1.0, np.log10(n) / 5),
    )
    style = np.zeros(STYLE, np.float32)
    style[:PAIRS] = np.sqrt(pairs / total) * 10
    for i, m in enumerate(measures):
        style[PAIRS + i * N_BANDS + int(np.searchsorted(BANDS, m))] = 3.0
    at_w, at_s = np.flatnonzero(words), np.flatnonzero(style)
    return np.concatenate([at_w, WORDS + at_s]), np.concatenate([1 + np.log(words[at_w]), style[at_s]]).astype(np.float32)


class Space:
    """Term weights and the projection to the latent space."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], rank: int = RANK):
        m = np.zeros((len(rows), TERMS), np.float32)
        for i, (at, v) in enumerate(rows):
            m[i, at] = v
        seen = np.count_nonzero(m, axis=0)
        self.idf = np.log((1 + len(rows)) / (1 + seen)).astype(np.float32) + 0.3
        self.idf[WORDS:] = 1.0
        for i in range(len(rows)):
            m[i] = self._weighted(m[i])
        rng = np.random.default_rng(3)
        y = m @ rng.standard_normal((TERMS, rank + 16)).astype(np.float32)
        for _ in range(3):
            y = np.linalg.qr(m @ (m.T @ y))[0]
        _, _, vt = np.linalg.svd(y.T @ m, full_matrices=False)
        self.axes = np.ascontiguousarray(vt[:rank].T)
        self.vectors = self._unit(m @ self.axes)

    def _weighted(self, dense: np.ndarray) -> np.ndarray:
        out = dense * self.idf
        for part in (out[:WORDS], out[WORDS:]):
            norm = np.sqrt(part @ part)
            if norm:
                part /= norm
        out[:WORDS] *= 0.4
        return out

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def project(self, texts: list[str | None]) -> np.ndarray:
        dense = np.zeros((len(texts), TERMS), np.float32)
        for i, t in enumerate(texts):
            at, v = terms(t)
            dense[i, at] = v
            dense[i] = self._weighted(dense[i])
        return self._unit(dense @ self.axes)


class NeighbourVote:
    """The fitted classifier."""

    def __init__(self, space: Space, labels: np.ndarray, neighbours: int = NEIGHBOURS, power: int = POWER):
        self.space, self.labels, self.power = space, labels.astype(np.float32), power
        self.neighbours = min(neighbours, len(labels))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.empty(len(texts))
        for lo in range(0, len(texts), BLOCK):
            sim = self.space.project(texts[lo : lo + BLOCK]) @ self.space.vectors.T
            near = np.argpartition(-sim, self.neighbours - 1, axis=1)[:, : self.neighbours]
            w = np.maximum(np.take_along_axis(sim, near, axis=1), 0).astype(np.float64) ** self.power + 1e-9
            out[lo : lo + BLOCK] = (w * self.labels[near]).sum(axis=1) / w.sum(axis=1)
        return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, *, most: int = MOST_TRAIN) -> NeighbourVote | None:
    """Learn from at most ``most`` rows of ``labels`` (doc_id, quality) with the least hashes."""
    rows = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_y")).dropna()
    rows = drawn(rows.distinct(), "quality", most, "_id", "_y")
    texts = docs.select("doc_id", "text").join(F.broadcast(rows), F.col("doc_id") == F.col("_id")).select("_id", "_y", "text")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            got = [terms(t) for t in p["text"]]
            yield pd.DataFrame({"id": p["_id"], "y": p["_y"], "at": [g[0].astype("<u2").tobytes() for g in got], "v": [g[1].tobytes() for g in got]})

    # One text of each labelled id: an id on very many rows must not reach the driver as often.
    seen = texts.mapInPandas(run, "id long, y int, at binary, v binary").groupBy("id", "y").agg(F.min(F.struct("at", "v")).alias("t")).select("id", "y", "t.*")
    seen = seen.toPandas().sort_values(["id", "y"])
    if not len(seen):
        return None
    unpacked = [(np.frombuffer(a, "<u2").astype(np.int64), np.frombuffer(v, np.float32)) for a, v in zip(seen["at"], seen["v"], strict=True)]
    return NeighbourVote(Space(unpacked), seen["y"].to_numpy())


def score(docs: DataFrame, model: NeighbourVote | None, text: str = "text") -> Column:
    """The score of a text column; the model reaches the workers as a broadcast of bounded size."""
    spark = docs.sparkSession
    bound_batches(spark)
    if model is None:
        return F.lit(0.5)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(texts.tolist()))

    return run(F.col(text))


def predict(docs: DataFrame, labels: DataFrame, *, most: int = MOST_TRAIN, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted): learned from the labels that are not held out (crc32 mod 5 is 0)."""
    out = held_out(F.col("doc_id"), 5, 0)
    model = fit(docs, labels.where(~out), most=most)
    scored = docs.select("doc_id", out.alias("held_out"), score(docs, model).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def keep_good(docs: DataFrame, labels: DataFrame, *, most: int = MOST_TRAIN, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those that the classifier rejects; same columns."""
    model = fit(docs, labels.where(~held_out(F.col("doc_id"), 5, 0)), most=most)
    columns = docs.columns
    return docs.withColumn("_score", score(docs, model)).where(F.col("_score") >= threshold).select(*[F.col(f"`{c}`") for c in columns])
