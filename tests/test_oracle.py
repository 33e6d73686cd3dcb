"""Every registered query against its DuckDB oracle on the smallest tables."""

import pytest

import __spark_entry__ as E
from compare import compare
from conftest import SF_SMALL
from pitwall.catalog import oracle_sql, registered_queries

QUERIES = registered_queries()
SQL = oracle_sql()


def test_every_query_has_oracle_sql():
    missing = sorted(set(QUERIES) - set(SQL))
    assert missing == []


def test_entry_runs(spark):
    df = E.entry(spark)
    assert "deg_slope_s" in df.columns and df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck_small, name):
    problems, ns, nd = compare(QUERIES[name](spark, SF_SMALL), duck_small, SQL[name])
    assert not problems, f"{name}: {problems} (spark {ns} rows, oracle {nd} rows)"
