"""Streams run to the end of the given tables; their sinks are read back as results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import TOKEN_COLUMNS, total_tokens
from ..operators.ordered import time_chunk
from ..operators.pricing import resolve_prices
from ..session import materialize, shared_path
from ..sources.sinks import collect_versions, read_submission, write_submission, write_version
from ..sources.transcripts import parse_requests
from ..streaming.ingest import changed_only, live_daily, stream_logs, stream_requests, write_snapshots
from ..streaming.limit_tables import LimitTables, write_limit_tables
from ..streaming.windows import publish_windows, read_windows, stream_hourly, stream_rate, stream_sessions
from .adapter import COST_SQL, DAILY_SQL, NOW, ORACLES, SUMS_SQL, TODAY, TOTAL_SQL, USAGE_SQL, daily, load, now, price_dim, query, usage
from .limit_queries import SAMPLES_SQL, samples
from .log_queries import TRANSCRIPT_SQL, transcript_lines


def _events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = load(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 8).parquet(sf_dir)


def live_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events_stream(spark, sf_dir)
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("handle"),
                    (F.floor(F.col("value") * 100) + F.floor(F.col("value") * 10) + k * 101).cast("long").alias("tokens"), k.alias("cost_micro"))


def drain_windows(stream: DataFrame, windows, name: str) -> DataFrame:
    """Runs a stream's windows over everything there is and adds up what its micro-batches published."""
    spark, sink = stream.sparkSession, shared_path(stream.sparkSession, name)
    publish_windows(stream, windows, sink, shared_path(spark, name + "-state")).trigger(availableNow=True).start().awaitTermination()
    return read_windows(spark, sink, windows(stream).schema)


@query("stream_hourly", f"""WITH {USAGE_SQL} SELECT epoch_us(date_trunc('hour', ts)) // 1000 AS start_ms, CAST(sum{TOTAL_SQL} AS BIGINT) AS tokens, CAST(sum(k) AS BIGINT) AS cost_micro FROM usage GROUP BY 1""")
def stream_hourly_query(spark, sf):
    out = drain_windows(live_usage(spark, sf), lambda rows: stream_hourly(rows, None), "hourly")
    return out.select(F.unix_millis("start_time").alias("start_ms"), "tokens", "cost_micro")


@query("stream_rate", f"""WITH {USAGE_SQL}, w AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) + to_minutes(5 * CAST(i AS INTEGER)) AS until, * FROM usage, range(1, 13) r(i))
SELECT epoch_us(until) // 1000 AS until_ms, CAST(sum{TOTAL_SQL} AS BIGINT) AS tokens FROM w GROUP BY 1""")
def stream_rate_query(spark, sf):
    out = drain_windows(live_usage(spark, sf), lambda rows: stream_rate(rows, None, ()), "rate")
    return out.select(F.unix_millis("until").alias("until_ms"), "tokens")


@query("stream_sessions", f"""WITH {USAGE_SQL}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY handle ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM usage),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY handle ORDER BY ts) AS n FROM g),
r AS (SELECT handle, min(ts) AS st, max(ts) + INTERVAL 30 MINUTE AS en, CAST(sum{TOTAL_SQL} AS BIGINT) AS tokens FROM s GROUP BY handle, n)
SELECT handle, epoch_us(st) // 1000 AS start_ms, tokens FROM r""")
def stream_sessions_query(spark, sf):
    out = drain_windows(live_usage(spark, sf), lambda rows: stream_sessions(rows, delay=None), "sessions")
    return out.select("handle", F.unix_millis("started").alias("start_ms"), "tokens")


PARTS = 5


def landed(rows: DataFrame, part, name: str, run, text: bool = False) -> None:
    """Lands the rows in ``PARTS`` parts, one after the other, and runs ``run(folder)`` after each: so many micro-batches."""
    spark = rows.sparkSession
    folder = shared_path(spark, name)
    staged = materialize(rows.withColumn("__part", part), name)
    for p in range(PARTS):
        new = staged.filter(F.col("__part") == p).drop("__part")
        new.select("value").write.mode("append").text(folder) if text else new.write.mode("append").parquet(folder)
        run(folder)


def mixed(ts: str, event_id: str):
    """Parts by calendar day, but every seventh row a part late, and rows of the last part's days in the first."""
    return F.pmod(F.dayofmonth(ts) + F.when(F.col(event_id) % 7 == 0, 1).otherwise(0), F.lit(PARTS))


def _live_limits(spark: SparkSession, sf: str, result: str) -> LimitTables:
    """Samples in mixed order through several micro-batches; every other sample is of one account."""
    path, state = shared_path(spark, "limits"), shared_path(spark, "limits-state")
    # the reset is a function of the sample, so that the SQL can say it
    rows = samples(spark, sf).select(F.col("handle").alias("key"), "at", "id", "percent",
                                     (F.col("at") + F.make_dt_interval(F.lit(0), (F.col("id") % 9).cast("int"))).alias("reset_at"))

    def run(folder: str) -> None:
        stream = spark.readStream.schema(rows.schema).parquet(folder)
        write_limit_tables(stream, path, state, results=[result]).trigger(availableNow=True).start().awaitTermination()

    landed(rows, mixed("at", "id"), "live-samples", run)
    return LimitTables(spark, path)


@query("stream_alerts", ORACLES["limit_alerts"])
def stream_alerts_query(spark, sf):
    return _live_limits(spark, sf, "alerts").alerts().select(F.col("key").alias("handle"), "id", "kind", "level")


@query("stream_forecast", ORACLES["limit_forecast"])
def stream_forecast_query(spark, sf):
    return _live_limits(spark, sf, "forecasts").forecasts().select(F.col("key").alias("handle"), "id", "hit_ms")


@query("stream_limits", f"""WITH {SAMPLES_SQL}, p AS (SELECT handle, ts, ts + to_hours(CAST(id % 9 AS INTEGER)) AS reset, percent,
  lead(ts) OVER (PARTITION BY handle ORDER BY us, id) AS next FROM s WHERE percent IS NOT NULL),
n AS (SELECT * FROM p WHERE ts <= TIMESTAMP '{NOW}')
SELECT handle, epoch_us(ts) AS us, CASE WHEN reset <= ts THEN 0.0 ELSE percent END AS percent, CASE WHEN reset > ts THEN epoch_us(reset) END AS reset_us FROM n
UNION ALL SELECT handle, epoch_us(reset), 0.0, NULL FROM n WHERE reset > ts AND reset <= TIMESTAMP '{NOW}' AND (next IS NULL OR next > reset)""")
def stream_limits_query(spark, sf):
    known = _live_limits(spark, sf, "steps").limits(now())
    return known.select(F.col("key").alias("handle"), F.unix_micros("at").alias("us"), "percent", F.unix_micros("reset_at").alias("reset_us"))


@query("stream_requests", f"""WITH {TRANSCRIPT_SQL},
b AS (SELECT date, model, {SUMS_SQL}, CAST(sum(CASE WHEN has_real_id THEN 1 ELSE 0 END) AS BIGINT) AS request_count FROM kept GROUP BY ALL)
SELECT b.*, {COST_SQL} AS cost_micro FROM b LEFT JOIN rates USING (model) WHERE {TOTAL_SQL} > 0""")
def stream_requests_query(spark, sf):
    """Transcript files that come in several micro-batches, a request's copies in different ones; the daily table they leave."""
    requests, daily, state = (shared_path(spark, n) for n in ("live-requests", "live-daily", "live-state"))

    def run(folder: str) -> None:
        lines = stream_logs(spark, folder, "part-*")
        resolve = lambda df: resolve_prices(df, price_dim(spark))
        stream_requests(lines, lambda b: parse_requests(b, now()), resolve, requests, daily, state).trigger(availableNow=True).start().awaitTermination()

    lines = transcript_lines(spark, sf)
    landed(lines.select("value", "chunk", "ord"), F.pmod(F.col("chunk") + F.col("ord"), F.lit(PARTS)), "live-lines", run, text=True)
    return live_daily(spark, daily).select("date", "model", *TOKEN_COLUMNS, "request_count", "cost_micro")


@query("published_changes", f"""WITH {USAGE_SQL}, p AS (SELECT *, CAST(day(ts) % {PARTS} AS BIGINT) AS part FROM usage),
s AS (SELECT handle, part, CAST(count(DISTINCT tool) AS BIGINT) AS tools, max(k) // 25 AS top FROM p GROUP BY ALL),
c AS (SELECT *, lag(tools) OVER w AS tools0, lag(top) OVER w AS top0 FROM s WINDOW w AS (PARTITION BY handle ORDER BY part))
SELECT handle, part AS batch, tools, top FROM c WHERE tools0 IS NULL OR tools <> tools0 OR top <> top0""")
def published_changes(spark, sf):
    """Snapshots of accounts by micro-batch, published where they differ from the account's last one; the last base is compacted on the way."""
    rows = usage(spark, sf).select("handle", "tool", "k", "ts")
    path = shared_path(spark, "published")

    def snapshot(batch: DataFrame) -> DataFrame:
        return batch.groupBy("handle").agg(F.count_distinct("tool").alias("tools"), F.floor(F.max("k") / 25).alias("top"),
                                           F.max("ts").alias("generated_at"))

    state = shared_path(spark, "published-state")
    run = lambda folder: write_snapshots(spark.readStream.schema(rows.schema).parquet(folder), snapshot, path, state, ["handle"], every=2).trigger(
        availableNow=True).start().awaitTermination()
    landed(rows, F.pmod(F.dayofmonth("ts"), F.lit(PARTS)), "live-usage", run)
    return spark.read.parquet(f"{path}/log").select("handle", F.col("batch").cast("long").alias("batch"), "tools", "top")


@query("submission_tables", f"""WITH {DAILY_SQL}, a AS (SELECT handle, date, tool, model, tokens FROM daily WHERE tokens % 3 > 0),
b AS (SELECT handle, date, tool, model, tokens + 7 AS tokens FROM daily WHERE day(date) % 4 = 0)
SELECT * FROM b UNION ALL SELECT * FROM a WHERE day(date) % 4 <> 0 AND date <> DATE '{TODAY}'""")
def submission_tables(spark, sf):
    """Three submissions: a full one, one that replaces some days and empties one, and one whose writer dies before its commit."""
    d = daily(spark, sf).select("handle", "date", "tool", "model", total_tokens().alias("tokens"))
    path = shared_path(spark, "submissions")
    write_submission({"entries": d.filter(F.col("tokens") % 3 > 0), "sessions": d}, path)
    again = d.filter(F.dayofmonth("date") % 4 == 0).withColumn("tokens", F.col("tokens") + 7)
    emptied = spark.createDataFrame([("entries", TODAY)], "table string, date string").withColumn("date", F.col("date").cast("date"))
    write_submission({"entries": again}, path, emptied)
    write_version({"entries": d.withColumn("tokens", F.lit(-1).cast("long"))}, path)
    collect_versions(spark, path)
    return read_submission(spark, path, "entries").select(d.columns)


@query("changed_snapshots", f"""WITH {USAGE_SQL}, s AS (SELECT handle, event_id, tool, k % 2 AS b, lag(tool) OVER w AS pt, lag(k % 2) OVER w AS pb FROM usage WINDOW w AS (PARTITION BY handle ORDER BY event_id))
SELECT handle, event_id FROM s WHERE pt IS NULL OR pt <> tool OR pb <> b""")
def changed_snapshots(spark, sf):
    """Each event as a snapshot of (tool, parity); repeats of the one before are dropped, whatever their instant."""
    u = usage(spark, sf).select("handle", "event_id", "tool", (F.col("k") % 2).alias("b"), F.col("ts").alias("generated_at"))
    out = changed_only(u, ["handle"], time_chunk("generated_at"), ["event_id"])
    return out.select("handle", "event_id")
