"""Every query with SQL against DuckDB on the same tables."""

import pytest

import __spark_entry__ as entry
from corvane.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(name, spark, sf_dir, same):
    same(registry.QUERIES[name](spark, sf_dir), registry.ORACLES[name])


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())
