"""TM scores of groups of different lengths."""

import pytest
from pyspark.sql import functions as F

from strandlake.operators import compare
from strandlake.plans import catalog, structure_queries

ATOMS = "chain_id long, atom_idx long, x double, y double, z double"


def _sides(spark):
    """Groups of 200 and 40 fixed atoms, and one without a key; every tenth mobile atom is missing, the others are 1 away."""
    rows = [(g, 1000 * at + i, float(i), float(i * i % 17), float(i % 5)) for at, (g, n) in enumerate([(1, 200), (2, 40), (None, 30)]) for i in range(n)]
    return spark.createDataFrame(rows, ATOMS), spark.createDataFrame([(*r[:4], r[4] + 1) for r in rows if r[1] % 10], ATOMS)


@pytest.mark.parametrize("length, of", [("shorter", 0.9), ("longer", 1), ("reference", 1), (50, None)])
def test_length_of_each_group(spark, length, of):
    fixed, mobile = _sides(spark)
    got = {r.chain_id: r.tm for r in compare.tm_score(fixed, mobile, atom=["atom_idx"], by=["chain_id"], length=length).collect()}
    assert set(got) == {1, 2, None}
    for g, n in ((1, 200), (2, 40), (None, 30)):
        size = 50 if of is None else n * of
        d0 = max(1.24 * (size - 15) ** (1 / 3) - 1.8, 0.5)
        assert got[g] == pytest.approx(n * 0.9 / (1 + 1 / d0**2) / size)


def test_without_lengths(spark):
    fixed, mobile = _sides(spark)
    with pytest.raises(ValueError):
        compare.tm_score(fixed.drop("chain_id"), mobile, atom=["atom_idx"], by=["chain_id"])
    with pytest.raises(ValueError):
        compare.tm_score(fixed, mobile, atom=["atom_idx"], by=["chain_id"], length="mean")


def test_query_gives_one_for_equal_models(spark, sf, monkeypatch):
    fixed, _ = _sides(spark)
    monkeypatch.setattr(structure_queries, "points", lambda spark, sf_dir, model=0: fixed.withColumn("res_id", F.lit(0)))
    got = catalog.QUERIES["tm_scores"](spark, sf).collect()
    assert {r.chain_id for r in got} >= {1, 2}
    assert all(r.tm == pytest.approx(1) for r in got)
