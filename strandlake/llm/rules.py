"""Quality rules in a short-circuit cascade.

Each rule rejects a document by counts of its whole text. On a bounded sample the cascade
measures every rule's cost beyond the base counts, which every text pays for, and whether it rejects, and orders the rules greedily: next comes
the rule with the most rejections per cost among the documents that no earlier rule
rejects. A document leaves the cascade at its first rejection. As the verdict
is a conjunction, the order changes the work, never the result.

Counts: words are ``[^\\x20\\x09-\\x0D]+``; lines are split at newlines, and lines without a word do not count.

Defined results: null and empty texts have no word and fail the base rule of at least 20
words; repeated rows get equal results; an empty table gives an empty table and keeps
the rules' own order.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.batches import bound_batches

SAMPLE = 2000
MIN_WORDS = 20
WINDOW = 8
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BULLETS = ("-", "*", "•")
LETTER = re.compile("[A-Za-z\x80-\U0010ffff]")
CAPS = re.compile("[A-Z][A-Z]")
LOWER = re.compile("[a-z]")


class Doc:
    """A text whose counts are made when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    def __getattr__(self, name: str):
        value = getattr(self, f"_{name}")()
        setattr(self, name, value)
        return value

    def _words(self):
        return self.text.encode().split()

    def _n_words(self):
        return len(self.words)

    def _word_chars(self):
        return len(self.text) - sum(map(self.text.count, SPACES))

    def _n_symbols(self):
        return sum(map(self.text.count, SYMBOLS))

    def _lines(self):
        return [x for x in self.text.split("\n") if x.strip(SPACES)]

    def _n_dup_lines(self):
        return len(self.lines) - len(set(self.lines))

    def _strings(self):
        return [w.decode() for w in self.words]

    def _n_repeat_words(self):
        return repeat_words(self.words)


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows of ``window`` words that occur twice or more."""
    n = len(words)
    if n <= window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    m = n - window + 1
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    h = np.zeros(m, np.uint64)
    for j in range(window):
        h = h * np.uint64(0xD6E8FEB86659FD93) + mixed[j : j + m]
    ordered = np.sort(h)
    if not (ordered[1:] == ordered[:-1]).any():  # equal windows have equal hashes
        return 0
    size, code = 1, ids
    while size < window:  # exact: a window's number from those of its halves
        pair = code[:-size] * (int(code.max()) + 1) + code[size:]
        code = np.unique(pair, return_inverse=True)[1]
        size *= 2
    again = np.bincount(code)[code] > 1
    edge = np.zeros(n + 1, np.int64)
    edge[:m] += again
    edge[window : window + m] -= again
    return int((np.cumsum(edge[:n]) > 0).sum())


def _share(hits: int, percent: int, whole: int) -> bool:
    return 100 * hits > percent * whole


#: Name to a predicate that says whether a document is rejected.
RULES: dict[str, Callable[[Doc], bool]] = {
    "word_length": lambda d: not 2 * d.n_words <= d.word_chars <= 15 * d.n_words,
    "symbols": lambda d: 10 * d.n_symbols > d.n_words,
    "repeated_lines": lambda d: d.n_dup_lines >= 3 and _share(d.n_dup_lines, 30, len(d.lines)),
    "bullets": lambda d: _share(sum(x.startswith(BULLETS) for x in d.lines), 90, len(d.lines)),
    "ellipses": lambda d: _share(sum(x.endswith(("...", "…")) for x in d.lines), 30, len(d.lines)),
    "letterless": lambda d: _share(sum(not LETTER.search(w) for w in d.strings), 30, d.n_words),
    "shouting": lambda d: _share(sum(bool(CAPS.search(w)) and not LOWER.search(w) for w in d.strings), 50, d.n_words),
    "one_word": lambda d: _share(max(Counter(d.words).values(), default=0), 30, d.n_words),
    "same_neighbours": lambda d: _share(sum(a == b for a, b in zip(d.words, d.words[1:], strict=False)), 20, d.n_words),
}


def base_failed(d: Doc) -> bool:
    return d.n_words < MIN_WORDS or 100 * d.n_repeat_words > 30 * d.n_words


def rejected(d: Doc, order: list[str]) -> bool:
    return any(RULES[name](d) for name in order)


def measure(docs: DataFrame, *, sample: int = SAMPLE) -> pd.DataFrame:
    """A row for each sampled text and rule: at, rule, seconds, rejects.

    About ``sample`` texts are drawn by a seeded random number and measured where they lie: no task gathers them.
    """
    share = min(1.0, sample / max(docs.count(), 1))
    bound_batches(docs.sparkSession)
    some = docs.select(F.monotonically_increasing_id().alias("at"), "text").where(F.rand(7) < share)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for i, text in zip(p["at"], p["text"], strict=True):
                for name, rule in RULES.items():
                    d = Doc(text)
                    d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words  # noqa: B018  the base counts are made for every text, so no rule pays for them
                    began = time.perf_counter()
                    hit = rule(d)
                    rows.append((i, name, time.perf_counter() - began, hit))
            yield pd.DataFrame(rows, columns=["at", "rule", "seconds", "rejects"])

    return some.mapInPandas(run, "at long, rule string, seconds double, rejects boolean").toPandas()


def plan(measured: pd.DataFrame) -> list[str]:
    """Rules by rejection per cost, each among what the rules before it let through."""
    left, order = list(RULES), []
    if not len(measured):
        return left
    cost = measured.groupby("rule")["seconds"].mean()
    hits = measured.pivot_table(index="at", columns="rule", values="rejects", aggfunc="first").astype(bool)
    alive = np.ones(len(hits), bool)
    while left:
        best = max(left, key=lambda r: (hits[r].to_numpy()[alive].sum() / max(cost[r], 1e-9), -cost[r]))
        order.append(best)
        left.remove(best)
        alive &= ~hits[best].to_numpy()
    return order


def judge(docs: DataFrame, order: list[str], text: str = "text") -> Column:
    """Struct of the base counts, base_failed and kept for a text column."""
    bound_batches(docs.sparkSession)

    @F.pandas_udf("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            d = Doc(t)
            failed = base_failed(d)
            rows.append((d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words, failed, not failed and not rejected(d, order)))
        return pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])

    return run(F.col(text))


def verdicts(docs: DataFrame, *, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)."""
    order = plan(measure(docs, sample=sample))
    return docs.select("doc_id", judge(docs, order).alias("_v")).select("doc_id", "_v.*")


def keep_passing(docs: DataFrame, *, sample: int = SAMPLE) -> DataFrame:
    """``docs`` that pass the base rules and the cascade; same columns."""
    columns = docs.columns
    order = plan(measure(docs, sample=sample))
    return docs.withColumn("_v", judge(docs, order)).where("_v.kept").select(*[F.col(f"`{c}`") for c in columns])
