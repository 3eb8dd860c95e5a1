"""Every registered query against its SQL, on the smallest data set."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as registered

SF = "/root/testdata/sf0.001"
QUERIES = registered.queries()
SQL = registered.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"create view {name} as select * from '{path}'")
    return connection


def ordered(rows):
    return sorted(rows, key=lambda row: [(v is None, str(v)) for v in row])


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = ordered(tuple(r[c] for c in columns) for r in df.collect())
    if name not in SQL:
        assert got
        return
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == ordered(tuple(r[names.index(c)] for c in columns) for r in result.fetchall())


def test_entry(spark):
    assert registered.entry(spark).count() > 0
