"""Every query against its SQL."""

import duckdb
import pytest

from vecscore.plans import oracle, queries

Q, SQL = queries.queries(), oracle.oracle_sql()
TABLES = ("documents", "embeddings", "events")


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr(tuple(r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf, duck, name):
    want = duck.sql(SQL[name])
    got = Q[name](spark, sf)
    assert canon(got.columns, got.collect()) == canon(want.columns, want.fetchall())


def test_all_queries_are_registered():
    import __spark_entry__ as entry

    assert set(Q) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
