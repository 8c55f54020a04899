"""Every registered query against its SQL; those without SQL run and give rows of a stable schema."""

import pytest

import __spark_entry__
from strandlake.plans import catalog
from tests import oracle


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, con, sf, name):
    assert oracle.differences(spark, con, catalog.QUERIES[name], catalog.ORACLES[name], sf) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_without_sql(spark, sf, name):
    """Rows, and the same ones at a second run; other tests hold the operators against brute force."""
    rows = catalog.QUERIES[name](spark, sf).collect()
    assert rows and sorted(map(repr, rows)) == sorted(map(repr, catalog.QUERIES[name](spark, sf).collect()))


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["query_id", "ref_id", "diagonal", "hits"] and df.count() > 0


def test_all_names_are_registered_once():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
