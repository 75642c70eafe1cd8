"""Queries on tables with events that used nothing, and on words that come in another order."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession, functions as F

import __spark_entry__ as driver
from meterlake.functions.columns import TOKEN_COLUMNS
from meterlake.operators.dedupe import dedupe_requests, merge_deduped
from meterlake.operators.ordered import carry_last
from meterlake.streaming import limit_tables
from meterlake.streaming.latest import Latest
from meterlake.streaming.limit_tables import limit_steps
from test_queries import DATA, table

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="driver tables are not here")


def against_sql(spark, folder, name):
    con = duckdb.connect()
    for file in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    df, result = driver.queries()[name](spark, str(folder)), con.execute(driver.oracle_sql()[name])
    assert table(df.columns, df.collect()) == table([c[0] for c in result.description], result.fetchall())


@pytest.fixture(scope="module")
def idle(tmp_path_factory):
    """Events of which every eighth used nothing, and none of the third hour of a day did."""
    folder = tmp_path_factory.mktemp("idle")
    duckdb.sql(f"""COPY (SELECT * EXCLUDE (z) REPLACE (CASE WHEN z THEN 0.0 ELSE value END AS value, CASE WHEN z THEN '{{"k": 0}}' ELSE props END AS props)
        FROM (SELECT *, event_id % 8 = 7 OR hour(ts) = 2 AS z FROM '{DATA}/events.parquet')) TO '{folder}/events.parquet' (FORMAT parquet)""")
    return folder


@pytest.mark.parametrize("name", ["daily_reports", "model_reports", "paged_usage", "session_reports", "block_reports"])
def test_unused_rows_are_reported(spark, idle, name):
    against_sql(spark, idle, name)


def test_reserved_words_do_not_depend_on_their_order(spark, tmp_path, monkeypatch):
    duckdb.sql(f"COPY (SELECT range AS c_custkey, 'BUILDING' AS c_mktsegment FROM range(60)) TO '{tmp_path}/customer.parquet' (FORMAT parquet)")
    make = SparkSession.createDataFrame
    monkeypatch.setattr(SparkSession, "createDataFrame", lambda self, data, *a, **k: make(self, list(reversed(data)), *a, **k))
    against_sql(spark, tmp_path, "screen_registry")


def test_chunk_summaries_are_merged_not_broadcast(spark):
    rows = spark.range(1000).selectExpr("id % 7 AS k", "id DIV 10 AS chunk", "id AS o")
    plan = carry_last(rows, ["k"], "chunk", ["o"], F.when(F.col("o") % 3 == 0, F.col("o")), "last")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("name", ["cumulative_deltas", "carry_forward_day"])
def test_rollouts_are_parsed_once(spark, name):
    plan = driver.queries()[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "from_json" not in plan


def test_merge_of_deduped_requests_is_their_dedupe(spark):
    columns = ["key", *TOKEN_COLUMNS, "file", "chunk", "ord"]
    rows = lambda number: spark.range(200).selectExpr(
        f"concat('k', id + {number} * 50) AS key", *[f"(id * {number + 3}) % 4 AS {c}" for c in TOKEN_COLUMNS],
        f"concat('f', (id + {number}) % 2) AS file", "id % 3 AS chunk", f"id * 2 + {number} AS ord")
    merged = merge_deduped(rows(0), rows(1), "fresh")
    want = dedupe_requests(rows(0).unionByName(rows(1)))
    assert sorted(merged.select(columns).collect()) == sorted(want.select(columns).collect())
    assert merged.filter("fresh").count() == 200
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "SortMergeJoin" in plan


def test_newest_plain_values_are_not_sorted(spark, tmp_path):
    index = Latest(spark, str(tmp_path), spark.range(0).selectExpr("cast(id AS string) AS key", "date '2026-01-01' AS date").schema, ["key"])
    for batch in range(3):
        index.write(batch, spark.range(5 + batch).selectExpr("cast(id AS string) AS key", f"CASE WHEN id <> 2 OR {batch} < 2 THEN date '2026-01-0{batch + 1}' END AS date"))
    rows = index.rows(3)
    assert "SortAggregate" not in rows._jdf.queryExecution().executedPlan().toString()
    assert {r.key: r.date and r.date.day for r in rows.collect()} == {"0": 3, "1": 3, "2": None, "3": 3, "4": 3, "5": 3, "6": 3}


def test_samples_around_a_chunk_are_written_before_their_scan(spark, tmp_path, monkeypatch):
    scanned = []
    monkeypatch.setattr(limit_tables, "limit_steps", lambda rows, keys: scanned.append(rows._jdf.queryExecution().executedPlan().toString()) or limit_steps(rows, keys))
    tables = limit_tables.LimitTables(spark, str(tmp_path), results=["steps"])
    for number, hour in enumerate((1, 3, 2)):
        tables.add(spark.sql(f"SELECT 'a' AS key, timestamp '2026-08-01 00:00:00' + make_interval(0, 0, 0, 0, {hour}) AS at, {hour}L AS id, {hour * 10}D AS percent, timestamp '2026-08-02' AS reset_at"), number)
    assert len(scanned) == 3 and not any("Exchange" in plan or "Aggregate" in plan for plan in scanned)
    assert sorted(r.percent for r in tables.limits(F.timestamp_micros(F.lit(1785600000000000))).collect()) == [10.0, 20.0, 30.0]
