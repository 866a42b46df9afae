"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as contract

SF_DIR = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return con


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    def text(v):
        return "nan" if isinstance(v, float) and math.isnan(v) else repr(v)
    return sorted(tuple(text(r[i]) for i in order) for r in rows)


def test_every_query_has_sql():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert {q.__name__ for q in contract._ALL} <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query(spark, duck, name):
    df = contract.queries()[name](spark, SF_DIR)
    answer = duck.sql(contract.oracle_sql()[name])
    assert sorted(df.columns) == sorted(answer.columns)
    assert canonical(df.columns, df.collect()) == canonical(answer.columns, answer.fetchall())


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["origin", "destination", "distance"] and df.count() == 1497
