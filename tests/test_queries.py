"""Every registered query against its plain SQL: rows, columns, types, values."""

import pytest

import __spark_entry__ as entry
from capsift.plans import catalog
from conftest import SF_DIR
from tools.compare import compare, connect


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


catalog.load()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, con, name):
    ok, text = compare(spark, con, SF_DIR, name)
    assert ok and "types differ" not in text, text


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
    assert set(catalog.QUERIES) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).limit(1).count() == 1
