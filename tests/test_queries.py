"""Every query of the entry that has SQL gives the same rows as DuckDB on the smallest tables."""

import importlib

import pytest
from compare import compare

entry = importlib.import_module("__spark_entry__")
QUERIES, SQL = entry.queries(), entry.oracle_sql()
SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    assert compare(spark, SMALL, name, QUERIES[name], SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in SQL))
def test_runs(spark, name):
    """Queries without SQL run to their end on the smallest tables and give rows."""
    df = QUERIES[name](spark, SMALL)
    df.write.format("noop").mode("overwrite").save()
    assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
