"""Every registered query with a check runs against DuckDB on the smallest data."""

import duckdb
import pytest
from conftest import TESTDATA

from __spark_entry__ import entry, oracle_sql, queries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
QUERIES, ORACLE = queries(), oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TESTDATA}/{t}.parquet'")
    return con


def _sorted(rows, names):
    at = [names.index(n) for n in sorted(names)]
    return sorted(repr(tuple(row[i] for i in at)) for row in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, name):
    found = QUERIES[name](spark, TESTDATA)
    cursor = duck.execute(ORACLE[name])
    names = [c[0] for c in cursor.description]
    assert sorted(found.columns) == sorted(names)
    assert _sorted([tuple(r) for r in found.collect()], found.columns) == _sorted(cursor.fetchall(), names)


def test_every_check_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0
