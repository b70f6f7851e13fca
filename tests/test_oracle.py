"""Every query with a SQL twin gives the same schema and rows."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from check import TABLES, compare  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, small, db, name):
    ours = entry.queries()[name](spark, small).toArrow()
    theirs = db.sql(SQL[name]).to_arrow_table()
    assert compare(ours, theirs) is None


def test_entry_has_rows(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"lang", "ngram", "rank", "term", "chi2"}


def test_no_sql_without_query():
    assert set(SQL) <= set(entry.queries())
