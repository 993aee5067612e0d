"""Every registered query against its SQL counterpart on the smallest tables."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    return int(value) if isinstance(value, float) and math.isfinite(value) and value == int(value) else value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


@pytest.mark.parametrize("name", list(driver.queries()))
def test_query(spark, duck, name):
    df = driver.queries()[name](spark, SF)
    got = table(df.columns, df.collect())
    sql = driver.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cursor = duck.execute(sql)
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == table(columns, cursor.fetchall())


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns == ["question_id", "rank", "score", "chunk_key", "category", "text"]
    assert df.count() > 0
