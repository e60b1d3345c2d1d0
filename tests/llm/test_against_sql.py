"""The queries that SQL can express, row by row against DuckDB on the smallest tables."""

import os

import duckdb
import pytest
from conftest import SF001

import __spark_entry__ as E
from terrapix.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "documents pages embeddings labels".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF001, t)}.parquet')")
    return c


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(E.queries())
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert set(ORACLE_SQL) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF001)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    res = con.execute(ORACLE_SQL[name])
    found = [d[0] for d in res.description]
    assert sorted(found) == cols
    assert got == sorted((tuple(r[found.index(c)] for c in cols) for r in res.fetchall()), key=repr)
