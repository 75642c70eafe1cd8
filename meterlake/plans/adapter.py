"""The driver tables seen as usage data, in Spark and as the matching SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import TOKEN_COLUMNS
from ..operators.pricing import attach_cost, resolve_prices
from ..sources.prices import RATES

# Parameters of the registered queries: the data's last day and the run instant.
TODAY = "2024-01-30"
NOW = "2024-01-30 18:00:00"

# Sample price rows (USD per 1M tokens: input, output, cache write, cache read), a stand-in for a landed price list.
SAMPLE_PRICES = (
    ("claude-opus-4-8", "5", "25", "6.25", "0.5"),
    ("claude-sonnet-4-5", "3", "15", "3.75", "0.3"),
    ("gpt-5", "1.25", "10", "1.25", "0.125"),
    ("gemini-2.5-pro", "1.25", "10", "1.25", "0.31"),
)
MODELS = ("claude-opus-4-8", "claude-sonnet-4-5", "gpt-5", "gpt-5-codex", "unknown-x")

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query, and its SQL when the result can be stated in SQL."""

    def register(fn):
        REGISTRY[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def now() -> Column:
    return F.to_timestamp(F.lit(NOW))


def pick(values, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def usage(spark: SparkSession, sf_dir: str, since: str | None = None) -> DataFrame:
    """One request per event. ``since`` is a bound on the raw instant, so it reaches the Parquet scan."""
    events = load(spark, sf_dir, "events")
    if since:
        events = events.filter(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    k = F.get_json_object("props", "$.k").cast("long")
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").cast("string").alias("handle"),
        F.col("event_type").alias("tool"),
        F.to_date("ts").alias("date"),
        "value",
        k.alias("k"),
        pick(MODELS, k % len(MODELS)).alias("model"),
        F.floor(F.col("value") * 100).cast("long").alias("input_tokens"),
        F.floor(F.col("value") * 10).cast("long").alias("output_tokens"),
        k.alias("cache_creation_tokens"),
        (k * 100).alias("cache_read_tokens"),
    )


USAGE_SQL = f"""
ev AS (SELECT event_id, ts, CAST(user_id AS VARCHAR) AS handle, event_type AS tool, CAST(ts AS DATE) AS date, value,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
usage AS (SELECT *, (['{"','".join(MODELS)}'])[CAST(k % {len(MODELS)} AS INTEGER) + 1] AS model,
  CAST(floor(value * 100) AS BIGINT) AS input_tokens, CAST(floor(value * 10) AS BIGINT) AS output_tokens,
  k AS cache_creation_tokens, k * 100 AS cache_read_tokens FROM ev),
rates(model, p_in, p_out, p_cw, p_cr) AS (VALUES
  ('claude-opus-4-8', 5::DECIMAL(12,6), 25::DECIMAL(12,6), 6.25::DECIMAL(12,6), 0.5::DECIMAL(12,6)),
  ('claude-sonnet-4-5', 3, 15, 3.75, 0.3), ('gpt-5', 1.25, 10, 1.25, 0.125), ('gpt-5-codex', 1.25, 10, 1.25, 0.125))
"""

COST_SQL = """CAST(round(coalesce(input_tokens * p_in + output_tokens * p_out + cache_creation_tokens * p_cw
  + cache_read_tokens * p_cr, 0), 0) AS BIGINT)"""
SUMS_SQL = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in TOKEN_COLUMNS)
TOTAL_SQL = "(input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens)"

DAILY_SQL = f"""{USAGE_SQL},
daily0 AS (SELECT handle, date, tool, model, {SUMS_SQL}, count(*) AS request_count FROM usage GROUP BY ALL),
daily AS (SELECT d.*, {COST_SQL} AS cost_micro, {TOTAL_SQL} AS tokens FROM daily0 d LEFT JOIN rates USING (model))
"""


def price_dim(spark: SparkSession) -> DataFrame:
    schema = "key string, " + ", ".join(f"{r} string" for r in RATES)
    rows = spark.createDataFrame(list(SAMPLE_PRICES), schema)
    return rows.select("key", *[F.col(r).cast("decimal(12,6)").alias(r) for r in RATES])


def daily(spark: SparkSession, sf_dir: str, since: str | None = None) -> DataFrame:
    """Daily rows (handle, date, tool, model) of all events, priced on the bucket.

    The distinct models come from the raw rows, where they fold inside each map task, and not from
    the buckets, whose shuffle would run a second time for them.
    """
    rows = usage(spark, sf_dir, since)
    folded = rows.groupBy("handle", "date", "tool", "model").agg(
        *[F.sum(c).alias(c) for c in TOKEN_COLUMNS], F.count(F.lit(1)).alias("request_count")
    )
    return attach_cost(folded, resolve_prices(rows, price_dim(spark)))


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as accounts; their nation is their organisation."""
    c = load(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").cast("string").alias("handle"),
        "c_nationkey",
        F.col("c_mktsegment").alias("segment"),
        (F.col("c_custkey") % 7 != 0).alias("listed"),
        (F.col("c_acctbal") < -500).alias("suppressed"),
        (F.col("c_custkey") % 31 == 5).alias("quarantined"),
    )


ACCOUNTS_SQL = """
accounts AS (SELECT CAST(c_custkey AS VARCHAR) AS handle, c_nationkey, c_mktsegment AS segment, c_custkey % 7 <> 0 AS listed,
  c_acctbal < -500 AS suppressed, c_custkey % 31 = 5 AS quarantined FROM customer)"""


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = load(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("org"))
    return accounts(spark, sf_dir).join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("org", "handle")


MEMBERSHIP_SQL = f"""{ACCOUNTS_SQL},
membership AS (SELECT n_name AS org, handle FROM accounts JOIN nation ON c_nationkey = n_nationkey)"""
