"""Every registered query of the postings engine against its SQL, on small data."""

from __future__ import annotations

import math

import duckdb
import pytest

from lodestack.plans import engine_queries, queries, source_queries

QUERIES = {**queries.QUERIES, **source_queries.QUERIES, **engine_queries.QUERIES}
ORACLE_SQL = {**queries.ORACLE_SQL, **source_queries.SQL, **engine_queries.SQL}

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return connection


def rows_of(frame):
    plain = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else v
    return sorted((tuple(map(plain, r)) for r in frame), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    expected = duck.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert rows_of(got.select(*columns).collect()) == rows_of(expected)


def test_entry(spark):
    import __spark_entry__

    assert 0 < __spark_entry__.entry(spark).count() <= 50
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
