"""The queries that SQL can express, against DuckDB on the same files."""

import duckdb
import pytest

from mercantile.llm.queries import ORACLE_SQL, QUERIES

TABLES = ("documents", "embeddings", "benchmark", "conversations")


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    got, want = QUERIES[name](spark, sf_dir), duck.execute(ORACLE_SQL[name])
    columns = sorted(got.columns)
    names = [d[0] for d in want.description]
    assert columns == sorted(names)
    have = sorted(tuple(r[c] for c in columns) for r in got.collect())
    assert have and have == sorted(tuple(r[names.index(c)] for c in columns) for r in want.fetchall())
