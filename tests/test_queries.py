"""Every registered query against its SQL on the smallest driver tables."""

import decimal
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="driver tables are not here")


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return float(value) if isinstance(value, decimal.Decimal) else value


def table(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    made = [tuple(plain(row[i]) for i in order) for row in data]
    return sorted(columns), sorted(made, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_every_oracle_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(driver.queries()))
def test_query(spark, database, name):
    df = driver.queries()[name](spark, str(DATA))
    got = table(df.columns, df.collect())
    if name in driver.oracle_sql():
        result = database.execute(driver.oracle_sql()[name])
        assert got == table([c[0] for c in result.description], result.fetchall())


def test_entry(spark):
    assert driver.entry(spark).columns == ["rank", "handle", "tokens", "cost_micro"]
