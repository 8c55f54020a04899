from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strandlake.llm import mixing
from strandlake.llm.queries import op1_pareto_mix
from tests.llm.helpers import DOC, awkward_documents, prose


def _run(docs):
    from strandlake.plans.shared import written

    sized = written(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), mixing.draw_key(F.col("doc_id"), F.col("text")).alias("_mix_key")))
    return mixing.apply_plan(sized, mixing.mix_plan(sized)).collect()


def test_targets_fill_up_to_caps(spark):
    rows = [(i, prose(i, 10 + 10 * s), "en", f"s{s}", 0) for i, s in enumerate([0, 1, 1, 2, 2, 2] * 20)]
    got = {r.source: r for r in mixing.targets(spark.createDataFrame(rows, DOC).select("source", mixing.word_count(F.col("text")).alias("size"))).collect()}
    sizes = {"s0": 200, "s1": 800, "s2": 1800}
    assert {s: r.source_size for s, r in got.items()} == sizes
    left, weights, want = 2800.0, {"s0": 5, "s1": 2, "s2": 1}, {}
    while True:  # plain water filling
        level = left / sum(weights.values())
        over = [s for s in weights if level * weights[s] > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            want[s] = 3.0 * sizes[s]
            left -= want[s]
            weights.pop(s)
    want |= {s: level * w for s, w in weights.items()}
    assert {s: r.target for s, r in got.items()} == pytest.approx(want)


def test_words_come_near_targets(spark, sf):
    taken, target, again = defaultdict(int), {}, {}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sources = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    for r in op1_pareto_mix(spark, sf).collect():
        taken[sources[r.doc_id]] += r.taken
        target[sources[r.doc_id]] = r.target
        again[r.doc_id] = r.taken
        assert r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0
    assert sum(target.values()) == pytest.approx(sum(r.size for r in op1_pareto_mix(spark, sf).collect()))
    assert again == {r.doc_id: r.taken for r in op1_pareto_mix(spark, sf).collect()}
    for s, want in target.items():
        assert taken[s] <= want + 1e-6


def test_awkward_rows(spark):
    docs = awkward_documents(spark)
    rows = _run(docs)
    assert len(rows) == docs.count()
    assert all(r.size == 0 or r.copies <= 3 for r in rows)
    assert {r.source for r in rows} == {"a", "b", "c", None}
    assert _run(docs.limit(0)) == []


def test_mix_repeats_rows_and_keeps_columns(spark):
    docs = awkward_documents(spark).withColumn("size", F.lit("mine")).withColumn("copies", F.lit(None).cast("int"))
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert {r["size"] for r in out.select("size").distinct().collect()} <= {"mine"}
    assert mixing.mix(docs.limit(0)).count() == 0


def test_a_table_of_sources_beyond_the_broadcast_bound_is_salted(spark):
    from strandlake.plans.shared import null_safe_join

    big = spark.range(1000).select("id", F.when(F.col("id") % 3 > 0, F.lit("hot")).alias("k"))
    table = spark.createDataFrame([("hot", 1), (None, 2), ("x", 3)], "k string, v int")
    salted = null_safe_join(big, table, "k", most=1, salts=4)
    assert sorted(salted.collect()) == sorted(null_safe_join(big, table, "k").collect())
    assert salted.count() == 1000
