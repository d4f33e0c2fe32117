"""Every registered query with a DuckDB twin gives the twin's rows; the others give rows."""

import duckdb
import pytest

from silvan.plans import queries as P

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    return con


def in_order(rows, columns):
    at = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(r[k] for k in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(P.QUERIES))
def test_query(spark, sf, duck, name):
    df = P.QUERIES[name](spark, sf)
    got = in_order(map(tuple, df.collect()), df.columns)
    assert got
    if name in P.SQL:
        want = duck.sql(P.SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert got == in_order(want.fetchall(), want.columns)


def test_entry_stands_without_the_llm_folders():
    import __spark_entry__ as entry

    assert set(P.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
