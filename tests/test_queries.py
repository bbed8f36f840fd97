"""Every registered query runs; those with SQL give the same rows on DuckDB."""

import pytest

import __spark_entry__ as entry_module
from compare import compare, connect

QUERIES = entry_module.queries()
SQL = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    if name in SQL:
        assert compare(spark, con, name, QUERIES[name], SQL[name], sf_dir) is None
    else:
        assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    blocks = entry_module.entry(spark)
    assert blocks.columns == ["query_id", "reference_block"]
    assert blocks.count() > 0
