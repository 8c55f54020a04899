import re
from collections import Counter

import pandas as pd
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake.llm import rules
from strandlake.llm.queries import op5_rule_cascade
from tests.llm.helpers import awkward_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + j for i, w in enumerate(windows) if w in twice for j in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


@given(st.lists(st.sampled_from(["a", "b", "é", "#", "x y", "\n", " ", "\x0b", "\x85", "日本"]), max_size=80).map(" ".join))
def test_counts(text):
    d = rules.Doc(text)
    assert (d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words) == _plain(text)


def test_repeat_words_ranges():
    w = [b"%d" % i for i in range(20)]
    assert rules.repeat_words(w) == 0
    assert rules.repeat_words(w + w[:8]) == 16
    assert rules.repeat_words([b"a"] * 9) == 9


def test_order_is_by_rejections_per_cost():
    rows = []
    for at in range(10):
        for name in rules.RULES:
            hits = {"symbols": at < 4, "bullets": at < 5, "shouting": at < 5}.get(name, False)
            rows.append((at, name, 10.0 if name == "bullets" else 1.0, hits))
    order = rules.plan(pd.DataFrame(rows, columns=["at", "rule", "seconds", "rejects"]))
    assert order[0] == "shouting" and sorted(order) == sorted(rules.RULES)
    assert rules.plan(pd.DataFrame(columns=["at", "rule", "seconds", "rejects"])) == list(rules.RULES)


def test_verdict_does_not_depend_on_the_order():
    texts = ["word " * 40, "A good line of text with more words than twenty, so that it stays in the set of what is kept here now", "SHOUT!! LOUD!! " * 15, "a | b | " * 20, None]
    for t in texts:
        d = rules.Doc(t)
        assert rules.rejected(d, list(rules.RULES)) == rules.rejected(d, list(rules.RULES)[::-1])


def test_query_against_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op5_rule_cascade(spark, sf).collect():
        want = _plain(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


def test_awkward_rows(spark):
    docs = awkward_documents(spark).withColumn("n_words", F.lit("mine")).withColumn("kept", F.lit(None).cast("int"))
    rows = rules.verdicts(docs).collect()
    assert len(rows) == docs.count()
    assert all(r.base_failed and not r.kept for r in rows if r.n_words < 20)
    assert rules.verdicts(docs.limit(0)).count() == 0
    assert rules.keep_passing(docs).columns == docs.columns
