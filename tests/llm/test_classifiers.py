"""Quality, language and URL classifiers: held-out accuracy and awkward rows."""

import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandlake.llm import langid, quality, urlfilter
from strandlake.llm.queries import op4_neighbour_quality, op6_url_trees, op9_language_hierarchy
from tests.llm.helpers import awkward_documents

SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_documents(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = op4_neighbour_quality(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([p == y for p, y in held]) >= 0.97
    assert all(p for p, y in held if y)


def test_quality_awkward_rows(spark):
    docs = awkward_documents(spark).withColumn("score", F.lit("mine"))
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (6, 1, None), (None, 1, 0), (7, None, 0), (8, 3, 0), (1, 1, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.predict(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.predict(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.predict(docs.limit(0), labels).count() == 0
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= docs.count()


def test_exact_neighbours_decide():
    a, b = quality.terms("plain good words in a row here"), quality.terms("### $$$ %%% ### $$$")
    vote = quality.NeighbourVote(quality.Space([a] * 30 + [b] * 30, rank=4), np.r_[np.ones(30), np.zeros(30)])
    s = vote.scores(["plain good words in a row here", "### $$$ %%% ### $$$", None])
    assert s[0] > 0.99 and s[1] < 0.01 and 0 <= s[2] <= 1


def test_quality_query_against_plain_votes(spark):
    """Cosines with every labelled vector, one pair at a time, in double precision."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels.where(~quality.held_out(F.col("doc_id"), 5, 0)))
    texts = {r.doc_id: r.text for r in docs.collect()}
    vectors = model.space.vectors.astype(float)
    for r in op4_neighbour_quality(spark, SF).orderBy("doc_id").limit(120).collect():
        mine = model.space.project([texts[r.doc_id]])[0].astype(float)
        near = sorted(((sum(a * b for a, b in zip(mine, v, strict=True)), y) for v, y in zip(vectors, model.labels.tolist(), strict=True)), key=lambda s: -s[0])[: quality.NEIGHBOURS]
        weights = [max(c, 0) ** quality.POWER + 1e-9 for c, _ in near]
        assert r.score == pytest.approx(sum(w * y for w, (_, y) in zip(weights, near, strict=True)) / sum(weights), abs=0.02)


def test_language_on_held_out_documents(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op9_language_hierarchy(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.97


def test_language_awkward_rows(spark):
    docs = awkward_documents(spark).withColumn("score", F.lit("mine")).withColumn("held_out", F.lit(None).cast("boolean"))
    rows = langid.predict(docs).collect()
    assert len(rows) == docs.count()
    by = [(r.doc_id, r.lang_pred) for r in rows]
    for i in (2, 3, 4, 7):
        assert (i, "und") in by
    assert {r.lang_pred for r in rows} <= {"und", "en", "de", "fr", "es", "zz"}
    nothing = langid.predict(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert langid.predict(docs.limit(0)).count() == 0


def test_language_hierarchy_of_families():
    rng = random.Random(1)
    alphabets = {"en": "abcd", "de": "abce", "fr": "mnop", "es": "mnoq", "xx": "uvwx"}
    make = lambda lang: " ".join("".join(rng.choice(alphabets[lang]) for _ in range(6)) for _ in range(30))
    langs = np.array([lang for lang in alphabets for _ in range(20)])
    model = langid.Hierarchy(np.stack([langid.features(make(lang)) for lang in langs]), langs)
    assert model.families == ["germanic", "only xx", "romance"] and len(model.pairs) == 2
    names, scores = model.texts([make(lang) for lang in alphabets] + ["42 - 17", None, ""])
    assert names == [*alphabets, "und", "und", "und"] and (scores[:5] > 0.5).all() and (scores[5:] == 0).all()


def test_every_language_is_learned(spark):
    """More languages than the bound on rows would give ten rows each."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda i: (letters[i % 26] + letters[i // 26 % 26] + "qxz"[i // 676 % 3]) * 2
    rows = [(i * 50 + j, " ".join([word(i)] * (8 + j)), f"l{i:03d}") for i in range(60) for j in range(12 if i else 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, most=100)
    assert model.langs == sorted({r[2] for r in rows})
    names, _ = model.texts([" ".join([word(i)] * 9) for i in range(60)])
    assert np.mean([n == f"l{i:03d}" for i, n in enumerate(names)]) > 0.9


def test_language_features_against_plain_grams():
    text = "Der Fluß 42, fließt!  日本"
    letters = " " + re.sub(r"[\W\d_]+", " ", text.lower()).strip() + " "
    mod, a, b, c = 1 << 64, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
    counts = np.zeros(langid.FEATURES)
    for i in range(len(letters)):
        h = 0
        for j, ch in enumerate(letters[i : i + 3]):
            h = ((h ^ h >> 29) * b + ord(ch) * a) % mod if j else ord(ch) * a % mod
            counts[h * c % mod >> 52] += 1
    want = np.sqrt(counts) / np.sqrt(counts.sum())
    assert np.allclose(langid.features(text), want, atol=1e-6)


def test_language_query_against_plain_machines(spark):
    """Each text alone: the family of the largest margin, then the sum of clipped margins within it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"), 3, 1)))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in op9_language_hierarchy(spark, SF).orderBy("doc_id").limit(150).collect():
        x = langid.features(texts[r.doc_id])
        if x is None:
            assert r.lang_pred == "und"
            continue
        margins = [float(x.astype(float) @ w[:-1].astype(float) + w[-1]) for w in model.weights.T]
        k = len(model.families) if len(model.families) > 1 else 0
        family = model.families[int(np.argmax(margins[:k]))] if k else model.families[0]
        votes = dict.fromkeys(model.members[family], 0.0)
        for (f, one, two), m in zip(model.pairs, margins[k:], strict=True):
            if f == family:
                votes[one] += np.clip(m, -2, 2)
                votes[two] -= np.clip(m, -2, 2)
        top = sorted(votes.values())[-2:]
        assert r.lang_pred == max(votes, key=votes.get) or top[-1] - top[0] < 1e-3


def _plain_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :], re.S)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h), len(p), h + p, v) for h, p, v in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[2:] if fits else (None, None))


def test_urls_against_plain_rules(spark):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = op6_url_trees(spark, SF).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path, rule, verdict = _plain_url(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")


def test_url_rules_and_awkward_rows(spark):
    urls = [
        None, "", "no scheme", "http://", "https://EXAMPLE.com/en/71?x", "http://a.b.example.COM/en/8", "http://com/en/", "http://xcom/en/", "ftp://k.example.net/de/8", "http://n.net/de/8#a",
        "http://o.org/es/?q", "http://o.org?/es/", "http://É.org/es/\nx", "http://u:p@h.com:80/en/x://y", "http://o.org/es/?q",
    ]
    pages = spark.createDataFrame([(i, u, None, "mine") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    rows = {r.page_id: r for r in urlfilter.judge(pages).collect()}
    for i, u in enumerate(urls):
        host, path, rule, verdict = _plain_url(u)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule), u
        assert verdict is None or rows[i].verdict == verdict
    assert {r.verdict for r in urlfilter.judge(pages.where("page_id < 3")).collect()} == {"allow"}
    assert urlfilter.judge(pages.limit(0)).count() == 0


def test_boosted_trees_learn_a_rule():
    rng = np.random.default_rng(0)
    x = rng.random((600, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    trees = urlfilter.Boosted(x[:400], y[:400])
    assert ((trees.probability(x[400:]) >= 0.5) == y[400:]).mean() >= 0.95


def test_lexical_features_move_a_verdict(spark):
    """One suffix, so only the URL's own letters tell the rules' verdicts apart."""
    rng = random.Random(4)
    long = lambda d: f"https://shop.com/{d}/" + "/".join(str(rng.randrange(10**8)) for _ in range(4)) + "?a=1&b=2&c=3"
    short = lambda d: f"https://shop.com/{d}/" + rng.choice(["about", "contact", "river-stone", "light"])
    urls = [long("x") for _ in range(150)] + [short("y") + str(i) for i in range(150)] + [long("z") for _ in range(20)] + [short("z") for _ in range(20)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = (("shop.com", "/x/", "block"), ("shop.com", "/y/", "allow"))
    verdicts = [r.verdict for r in urlfilter.judge(pages, rules=rules).orderBy("page_id").collect()]
    assert verdicts[300:] == ["block"] * 20 + ["allow"] * 20
    model = urlfilter.fit(pages, rules=rules)
    (rows, accuracy) = model.held_out["com"]
    assert rows > 20 and accuracy > 0.95


def test_suffix_statistics_of_training_rows_come_from_other_folds():
    rng = random.Random(5)
    hosts = [f"h{i}.example" for i in range(400)]  # each host once: its own label must tell nothing
    rows = pd.DataFrame({"url": [f"https://{h}/a" for h in hosts], "host": hosts, "path": "/a", "verdict": [rng.choice(["block", "allow"]) for _ in hosts]})
    model = urlfilter.UrlModel(rows)
    assert 0.35 < model.held_out["example"][1] < 0.65
    assert np.ptp(model.blocked(["https://new.example/a"] * 2, ["new.example"] * 2, ["/a"] * 2)) == 0


@pytest.mark.parametrize("y", [np.zeros(40), np.ones(40)])
def test_boosted_trees_of_one_class(y):
    p = urlfilter.Boosted(np.arange(80.0).reshape(40, 2), y).probability(np.zeros((3, 2)))
    assert ((p >= 0.5) == (y[0] == 1)).all()
