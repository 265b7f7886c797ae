"""Every registered query that has SQL, against DuckDB on the same tables."""

import oracle
import pytest

import __spark_entry__ as entry

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, con, sf_dir):
    problem = oracle.compare(entry.queries()[name](spark, sf_dir), con, SQL[name])
    assert problem is None, problem


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry_has_rows_and_columns(spark):
    df = entry.entry(spark)
    assert df.columns == ["run_id", "score_name", "n", "auc"] and df.count() > 0
