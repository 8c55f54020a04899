import itertools

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake.llm import simhash as s
from strandlake.llm.queries import op7_simhash_components
from tests.llm.helpers import awkward_documents, groups, prose


def _plain(text, k=3):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@given(st.text(max_size=60), st.integers(1, 5))
def test_fingerprint(text, k):
    assert s.fingerprint(text, k) == _plain(text, k)


@settings(deadline=None, max_examples=40)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 63), st.integers(0, 63), st.integers(0, 3)), min_size=1, max_size=60), st.integers(1, 7), st.integers(0, 3))
def test_trie_join_is_exact(rows, budget, seed):
    base = np.random.default_rng(seed).integers(0, 1 << 63, 4, dtype=np.uint64)
    keys = np.array([r[0] for r in rows])
    fps = np.array([int(base[r[3]]) ^ (1 << r[1]) ^ (1 << r[2]) for r in rows], np.uint64)
    order = np.lexsort((fps, keys))
    keys, fps = keys[order], fps[order]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if keys[i] == keys[j] and int(fps[i] ^ fps[j]).bit_count() <= budget]
    assert s.trie_components(keys, fps, budget).tolist() == groups(len(fps), pairs)


@pytest.mark.parametrize("group, budget", [(None, 3), (3, 3), (None, 7), (2, 7), (None, 1)])
def test_links_within_the_budget(spark, group, budget):
    rng = np.random.default_rng(2)
    base = rng.integers(-(1 << 62), 1 << 62, 30)
    fps = sorted({int(b) ^ sum(1 << int(x) for x in rng.choice(62, rng.integers(0, budget + 2), replace=False)) for b in base for _ in range(8)})
    edges = s.links(spark.createDataFrame([(f,) for f in fps], "fp long"), budget=budget, group=group).collect()
    at = {f: i for i, f in enumerate(fps)}
    mask = (1 << 64) - 1
    pairs = [(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if ((fps[i] ^ fps[j]) & mask).bit_count() <= budget]
    assert groups(len(fps), [(at[e.src], at[e.dst]) for e in edges]) == groups(len(fps), pairs)


@settings(deadline=None, max_examples=25)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 3), st.lists(st.integers(0, 127), max_size=6)), min_size=1, max_size=40), st.integers(1, 9), st.integers(0, 3))
def test_trie_join_of_wide_fingerprints(rows, budget, seed):
    base = [int.from_bytes(np.random.default_rng(seed + 9 * i).bytes(16), "big") for i in range(4)]
    rows = sorted((k, base[b] ^ sum({1 << f for f in flips})) for k, b, flips in rows)
    keys = np.array([k for k, _ in rows])
    words = np.array([[v >> 64, v & (1 << 64) - 1] for _, v in rows], np.uint64)
    pairs = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if rows[i][0] == rows[j][0] and (rows[i][1] ^ rows[j][1]).bit_count() <= budget]
    assert s.trie_components(keys, words, budget).tolist() == groups(len(rows), pairs)


def test_sketches_tell_similarity():
    words = prose(21, 3000).split()
    for share, near in ((0.01, True), (0.5, False)):
        other = [w if (i * 37 % 100) / 100 >= share else f"x{i}" for i, w in enumerate(words)]
        a, b = (np.frombuffer(s.sketch(" ".join(x), 5), np.uint8) for x in (words, other))
        assert (np.bitwise_count(a ^ b).sum() <= s.sketch_budget(0.8)) == near
    assert s.sketch(None, 5) == s.sketch(" \n", 5) == bytes(64)
    assert s.sketch("A b  c d e f", 5) == s.sketch("a B c d E f", 5) == s.sketch("a b c\nd e f", 5)


@pytest.mark.parametrize("group", [5000, 20])
def test_sketch_links(spark, group):
    """Near copies meet however their groups are dealt, and a task may hold one group or many."""
    rng = np.random.default_rng(6)
    rows = []
    for c in range(40):
        base = rng.integers(0, 256, 64, dtype=np.uint8)
        for _ in range(1 if c % 2 else 60 if c == 0 else 5):
            bits = np.zeros(512, np.uint8)
            bits[rng.choice(512, 30, replace=False)] = 1
            rows.append((len(rows), bytes(base ^ np.packbits(bits)), c))
    edges = s.sketch_links(spark.createDataFrame(rows, "node long, fp binary, c int").select("node", "fp"), similarity=0.8, group=group).collect()
    assert groups(len(rows), [(e.src, e.dst) for e in edges]) == groups(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if rows[i][2] == rows[j][2]])


def test_tasks_flush_at_the_border_of_groups(monkeypatch):
    monkeypatch.setattr(s, "FLUSH", 10)
    keys = np.repeat(np.arange(9), [3, 25, 1, 1, 9, 2, 30, 1, 4])
    table = s.pa.table({"key": keys, "fp": np.arange(len(keys))})
    got = [t["key"].to_pylist() for t in s._whole_groups(iter(table.to_batches(max_chunksize=4)))]
    assert sum(got, []) == keys.tolist() and len(got) > 3
    assert all(not set(a) & set(b) for a, b in itertools.combinations(got, 2))


def test_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    fps = [_plain(d.text) for d in docs]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 3]
    comp = groups(len(fps), pairs)
    got = {r.doc_id: r for r in op7_simhash_components(spark, sf).collect()}
    assert {i: (g.fingerprint, g.component_id) for i, g in got.items()} == {d.doc_id: (f"{f:016x}", docs[c].doc_id) for d, f, c in zip(docs, fps, comp, strict=True)}


def test_awkward_rows(spark):
    docs = awkward_documents(spark).withColumn("fp", F.lit("mine")).withColumn("component_id", F.lit(0))
    got = s.components(docs).collect()
    assert len(got) == docs.count()
    by = {(r.doc_id, r.fp): r.component_id for r in got}
    assert by[2, 0] == by[3, 0] == by[4, 0] == by[None, 0] == 2
    kept = s.dedup(docs)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, (r.text or "")[:20]) for r in kept.collect()]
    assert sorted(i for i, _ in rows if i is not None) == [1, 2, 5, 7, 8, 9, 9]
    assert [i for i, _ in rows].count(None) == 1
    assert s.components(docs.limit(0)).count() == 0 and s.dedup(docs.limit(0)).count() == 0


def test_a_near_copy_goes_though_its_id_names_another_text(spark):
    text = prose(11, 400)
    rows = [(1, text), (5, prose(12, 400)), (5, text + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len({r.component_id for r in s.components(docs, budget=7).collect()}) == 2
    assert {(r.doc_id, r.text) for r in s.dedup(docs, budget=7).collect()} == set(rows[:2])
