"""Every query that has SQL, against DuckDB on the same files."""

import duckdb
import pytest

import __spark_entry__
from mercantile.plans import queries as plans  # the entry module has registered all

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def key(row):
    return tuple((x is None, str(x)) for x in row)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, sf_dir, name):
    got = plans.QUERIES[name](spark, sf_dir)
    want = duck.execute(plans.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(d[0] for d in want.description)
    at = [[d[0] for d in want.description].index(c) for c in columns]
    have = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=key)
    assert have == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=key)
    assert have


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["l_partkey", "country", "landed", "l_suppkey"]
    assert plans.QUERIES.keys() <= __spark_entry__.queries().keys()
