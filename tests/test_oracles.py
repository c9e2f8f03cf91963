"""Every registered query against its SQL on the small tables."""

import pytest

import __spark_entry__ as entry
from checks import catalog, run

NAMES = list(catalog.QUERIES)


@pytest.fixture(scope="module")
def con(sf):
    return run.connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, sf, name):
    text, _, fine = run.compare(spark, con, name, sf)
    assert fine, text


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
