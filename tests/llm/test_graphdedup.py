import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandlake.llm import graphdedup as g
from strandlake.llm.queries import op2_graph_components
from tests.llm.helpers import groups

SCHEMA = "vec_id long, embedding array<float>, label int"


def _table(spark, n=700, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 16)).astype(np.float32)
    for i in range(0, n, 3):
        x[i] = x[(i * 7) % n] + 0.15 * rng.standard_normal(16)
    x[n - 60 : n - 20] = x[3] + 0.05 * rng.standard_normal((40, 16))
    x[n - 20 :] = x[5]
    labels = rng.integers(0, 3, n)
    labels[n - 60 :] = 1
    return x, labels, spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n) * 2, "embedding": x.tolist(), "label": labels}), SCHEMA)


def _brute(x, labels):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & (labels[:, None] == labels[None])
    np.fill_diagonal(near, False)
    return near


@pytest.mark.parametrize("shard, most", [(1500, 4096), (60, 4096), (60, 64)])
def test_links_and_components(spark, monkeypatch, shard, most):
    monkeypatch.setattr(g, "SHARD_MOST", most)
    monkeypatch.setattr(g.fit_centroids, "__kwdefaults__", {"sample": 20_000, "shard": shard})
    x, labels, table = _table(spark)
    got = g.near_components(table).toPandas().sort_values("vec_id").reset_index(drop=True)
    near = _brute(x, labels)
    truth, found = near.sum(axis=1), got["n_links"].to_numpy()
    assert (found <= truth).all()
    assert found.sum() >= 0.9 * truth.sum()
    if shard == 1500:
        assert (found == truth).all()
        comp = np.array(groups(len(x), zip(*np.nonzero(np.triu(near)), strict=True))) * 2
        assert (got["component_id"].to_numpy() == comp).all()
    assert (got["kept"] == (got["vec_id"] == got["component_id"])).all()


def test_awkward_rows(spark):
    v, nan, inf = [1.0, 0.0], float("nan"), float("inf")
    rows = [(1, v, 0), (1, v, 0), (2, [1.0, 0.01], 0), (3, None, 0), (4, [0.0, 0.0], 0), (5, [nan, 1.0], 0), (6, [inf, 1.0], 0), (7, [None, 1.0], 0), (8, v, None), (9, [1.0, 0.0, 0.0], 0), (None, v, 0), (10, [], 0), (11, [-0.0, 2.0], 1), (12, [0.0, 2.0], 1)]
    got = g.near_components(spark.createDataFrame(rows, SCHEMA)).collect()
    links = {(r.vec_id, r.n_links, r.component_id) for r in got}
    assert len(got) == len(rows)
    assert links == {(1, 3, 1), (2, 3, 1), (None, 3, 1), (9, 0, 9), (11, 1, 11), (12, 1, 11)} | {(i, 0, i) for i in (3, 4, 5, 6, 7, 8, 10)}
    assert g.near_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pruning_drops_occluded_neighbours():
    angles = np.array([0.0, 0.1, 0.2, 3.0])
    x = np.stack([np.cos(angles), np.sin(angles)], axis=1)
    lists = g.robust_prune(x, degree=3, candidates=3, alpha=1.2)
    assert lists[0, 0] == 1 and 2 not in lists[0]


def test_range_search_meets_all_on_a_connected_graph():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = g.range_search(x, g.robust_prune(x).astype(np.int64), np.arange(200), 0.8, 32)
    truth = x @ x.T >= 0.8
    assert not (found & ~truth).any()
    assert (found & truth).sum() >= 0.97 * truth.sum()


def _pairs_and_clumps(sizes, n=1500, dim=64, pairs=100):
    """Unit vectors: planted pairs, then clumps of near copies; and the pairs' count."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((n, dim))
    x[1 : 2 * pairs : 2] = x[0 : 2 * pairs : 2] + 0.1 * rng.standard_normal((pairs, dim))
    at = 2 * pairs
    for size in sizes:
        x[at : at + size] = x[at] + 0.02 * rng.standard_normal((size, dim))
        at += size
    return x / np.linalg.norm(x, axis=1, keepdims=True), pairs


@pytest.mark.parametrize("sizes", [(), (66,), (200,), (80, 90)])
def test_a_clump_hides_no_other_link(sizes):
    x, _ = _pairs_and_clumps(sizes)
    found = g.range_search(x, g.robust_prune(x.astype(np.float32)).astype(np.int64), np.arange(len(x)), 0.93, g.BEAM)
    assert ((found | found.T) == (x @ x.T >= 0.93)).all()


def test_near_clumps_are_linked(spark):
    rng = np.random.default_rng(6)
    x, _ = _pairs_and_clumps((80, 90), n=600)
    side = rng.standard_normal(64)
    x[280:370] = x[200] + 0.25 * side / np.linalg.norm(side) + 0.002 * rng.standard_normal((90, 64))
    table = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist(), "label": 0}), "vec_id long, embedding array<double>, label int")
    got = g.near_components(table).toPandas().sort_values("vec_id")
    assert (got["n_links"].to_numpy() == _brute(x, np.zeros(len(x))).sum(axis=1)).all()


def test_a_search_that_falls_short_is_replaced_by_exact_blocks():
    x, pairs = _pairs_and_clumps((200,))
    truth = x @ x.T >= 0.93
    np.fill_diagonal(truth, False)
    clump_only = truth.copy()
    clump_only[: 2 * pairs] = False
    assert (g._whole(x, clump_only, 0.93, 0.95, 256) == truth).all()


def test_a_hub_keeps_short_lists():
    lists = np.r_[np.full(1, 1), np.zeros(2000, int)][:, None]
    wide = g.with_back_edges(lists)
    assert wide.shape[1] == 1 + 2 * g.BACK
    assert set(wide.ravel()) - {-1} == set(range(2001))


def test_shards_are_divided_level_by_level(spark, monkeypatch):
    """More vectors than first centroids would hold: no shard outgrows the bound, and links across shards are found."""
    for name, value in (("SHARD", 60), ("SPLIT", 150), ("SPLIT_SAMPLE", 64), ("TASK_ROWS", 100)):
        monkeypatch.setattr(g, name, value)
    monkeypatch.setattr(g.fit_centroids, "__kwdefaults__", {"sample": 24, "shard": 60})
    x, _ = _pairs_and_clumps((40,), n=1500, dim=16, pairs=300)
    table = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist(), "label": 0}), "vec_id long, embedding array<double>, label int")
    classes = table.select("label", F.lit(16).alias("dim"), F.col("vec_id").alias("cid"), F.col("embedding").alias("vec"), F.lit(1).cast("long").alias("weight"))
    classes = classes.withColumn("label", F.col("label").cast("long"))
    dealt = g._dealt(classes, g.fit_centroids(classes), 2, "array<double>")
    sizes = [r["count"] for r in dealt.groupBy("shard").count().collect()]
    assert max(sizes) <= 150 and len(sizes) > 10
    rows = dealt.collect()
    assert {r.cid for r in rows} == set(range(1500)) and all(r.shard in r.shards for r in rows)
    assert len({(r.cid, r.shard) for r in rows}) == len(rows) == sum(len(s) for s in {r.cid: r.shards for r in rows}.values())
    got = g.near_components(table).toPandas().sort_values("vec_id")
    near = _brute(x, np.zeros(len(x)))
    found, truth = got["n_links"].to_numpy(), near.sum(axis=1)
    assert (found <= truth).all() and found.sum() >= 0.95 * truth.sum()


def test_links_across_shards(spark):
    """q and w share no shard; v, near both, lists w."""
    parts = spark.createDataFrame([(1, [10]), (2, [10, 20]), (3, [20]), (4, [30])], "cid long, shards array<long>")
    angle = lambda a: [float(np.cos(a)), float(np.sin(a))]
    classes = spark.createDataFrame([(1, angle(0.0)), (2, angle(0.1)), (3, angle(0.2)), (4, angle(0.3))], "cid long, vec array<double>")
    united = spark.createDataFrame([(1, [2], [2]), (2, [1, 3], [1, 3]), (3, [2, 4], [2]), (4, [3], [3])], "cid long, near array<long>, close array<long>")
    got = {(r.a, r.b) for r in g._across(parts, united, classes, 0.93).collect()}
    assert (1, 3) in got and (1, 2) not in got and (2, 3) not in got
    assert got <= {(1, 3), (1, 4), (2, 4), (3, 4)}


def test_clashing_extra_columns(spark):
    _, _, table = _table(spark, n=120)
    more = table
    for name in ("cid", "weight", "shard", "links", "vec", "component"):
        more = more.withColumn(name, F.lit("mine"))
    key = lambda df: sorted((r.vec_id, r.n_links, r.component_id) for r in df.collect())
    assert key(g.near_components(more)) == key(g.near_components(table))


def test_query_against_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    able = rows["label"].notna() & rows["embedding"].map(lambda v: v is not None and np.isfinite(np.array(v, float)).all() and np.any(v))
    x, label = np.array(rows["embedding"][able].tolist(), float), rows["label"][able].to_numpy()
    near = _brute(x, label)
    ids = rows["vec_id"][able].to_numpy()
    comp = groups(len(x), zip(*np.nonzero(np.triu(near)), strict=True))
    least = {c: min(ids[i] for i in range(len(x)) if comp[i] == c) for c in set(comp)}
    want = {ids[i]: (int(near[i].sum()), least[comp[i]]) for i in range(len(x))}
    for r in op2_graph_components(spark, sf).collect():
        assert (r.n_links, r.component_id) == want.get(r.vec_id, (0, r.vec_id)) and r.kept == (r.vec_id == r.component_id)
