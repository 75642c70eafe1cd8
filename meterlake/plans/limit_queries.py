"""Queries over rate-limit samples: event values serve as percents, users as accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.limits import classify_windows, effective_percent, future_reset
from ..operators.greedy import coalesce_bursts, throttle
from ..operators.limits import (forecast_alarm, forecast_hit, last_known_good, latest_limit, threshold_alerts,
                                tightest_limit, window_meter)
from ..operators.ordered import running_sum, time_chunk
from .adapter import NOW, TODAY, load, now, query


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six accounts with dense samples: the value is the percent, one in thirteen is missing."""
    e = load(spark, sf_dir, "events")
    return e.select(
        (F.col("user_id") % 6).cast("string").alias("handle"),
        F.col("ts").cast("timestamp").alias("at"),
        F.col("event_id").alias("id"),
        F.col("event_type").alias("provider"),
        F.when(F.col("event_id") % 13 != 0, F.least(F.col("value") * 2, F.lit(110.0))).alias("percent"),
        "value",
    )


SAMPLES_SQL = """s AS (SELECT CAST(user_id % 6 AS VARCHAR) AS handle, ts, epoch_us(ts) AS us, epoch_us(ts) // 1000 AS ms, event_id AS id, event_type AS provider,
  CASE WHEN event_id % 13 <> 0 THEN least(value * 2, 110.0) END AS percent, value FROM events)"""
_PREV = "lag(percent) OVER (PARTITION BY handle ORDER BY us, id)"


@query("limit_forecast", f"""WITH {SAMPLES_SQL}, f AS (SELECT *, first_value(ms) OVER w AS ms0, first_value(percent) OVER w AS p0, first_value(id) OVER w AS id0 FROM s WHERE percent IS NOT NULL
  WINDOW w AS (PARTITION BY handle ORDER BY ms RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW))
SELECT handle, id, CASE WHEN id0 = id THEN NULL WHEN percent >= 100 THEN ms WHEN ms > ms0 AND percent > p0
  THEN CAST(floor(ms + (100.0::DOUBLE - percent) / ((percent - p0) / CAST(ms - ms0 AS DOUBLE)) + 0.5) AS BIGINT) END AS hit_ms FROM f""")
def limit_forecast(spark, sf):
    return forecast_hit(samples(spark, sf)).select("handle", "id", "hit_ms")


@query("limit_alerts", f"""WITH {SAMPLES_SQL}, p AS (SELECT *, {_PREV} AS prev FROM s WHERE percent IS NOT NULL),
a AS (SELECT *, prev - percent >= 30 OR (prev >= 80 AND percent < 80) AS is_reset FROM p WHERE prev IS NOT NULL)
SELECT handle, id, 'reset' AS kind, CAST(NULL AS INTEGER) AS level FROM a WHERE is_reset
UNION ALL SELECT handle, id, 'threshold', l FROM a, (VALUES (80), (95)) t(l) WHERE NOT is_reset AND prev < l AND percent >= l""")
def limit_alerts(spark, sf):
    return threshold_alerts(samples(spark, sf)).select("handle", "id", "kind", "level")


@query("forecast_alarm", f"""WITH {SAMPLES_SQL}, h AS (SELECT handle, id, us, ms, percent, ms + (id % 50) * 60000 AS hit FROM s WHERE percent IS NOT NULL),
g AS (SELECT *, sum(CASE WHEN percent < 50 THEN 1 ELSE 0 END) OVER (PARTITION BY handle ORDER BY us, id ROWS UNBOUNDED PRECEDING) AS seg FROM h)
SELECT handle, id, percent FROM g WHERE hit > ms AND hit - ms <= 1800000 QUALIFY row_number() OVER (PARTITION BY handle, seg ORDER BY us, id) = 1""")
def forecast_alarm_query(spark, sf):
    s = samples(spark, sf).filter("percent IS NOT NULL").withColumn("hit_ms", F.unix_millis("at") + F.col("id") % 50 * 60_000)
    return forecast_alarm(s).select("handle", "id", "percent")


@query("last_known_good", f"""WITH {SAMPLES_SQL} SELECT handle, id, percent, last_value(percent IGNORE NULLS) OVER
 (PARTITION BY handle ORDER BY us, id ROWS UNBOUNDED PRECEDING) AS known_percent FROM s""")
def last_known_good_query(spark, sf):
    return last_known_good(samples(spark, sf)).select("handle", "id", "percent", "known_percent")


@query("latest_limit", f"""WITH {SAMPLES_SQL} SELECT handle, provider, id, percent FROM s QUALIFY row_number() OVER (PARTITION BY handle, provider ORDER BY us DESC, id DESC) = 1""")
def latest_limit_query(spark, sf):
    s = samples(spark, sf).select("handle", "provider", "id", "percent", F.col("at").alias("captured_at"))
    return latest_limit(s, ["handle", "provider"], tie=["id"]).drop("captured_at")


@query("tightest_limit", f"""WITH {SAMPLES_SQL}, l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY handle, provider ORDER BY us DESC, id DESC) = 1),
e AS (SELECT handle, provider, CASE WHEN percent IS NOT NULL AND ts + to_hours(CAST(id % 9 AS INTEGER)) <= TIMESTAMP '{NOW}' THEN 0.0 ELSE percent END AS percent FROM l)
SELECT handle, percent, provider FROM e WHERE percent IS NOT NULL QUALIFY row_number() OVER (PARTITION BY handle ORDER BY percent DESC, provider) = 1""")
def tightest_limit_query(spark, sf):
    s = samples(spark, sf).select("handle", "provider", "id", "percent", F.col("at").alias("captured_at"))
    newest = latest_limit(s, ["handle", "provider"], tie=["id"])
    reset = F.col("captured_at") + F.make_dt_interval(F.lit(0), (F.col("id") % 9).cast("int"))
    return tightest_limit(newest.withColumn("reset_at", reset), now()).select("handle", "percent", "provider")


@query("effective_limits", f"""WITH {SAMPLES_SQL}, r AS (SELECT *, ts + to_days(CAST(id % 40 AS INTEGER)) AS reset FROM s)
SELECT id, CASE WHEN percent IS NOT NULL AND reset <= TIMESTAMP '{NOW}' THEN 0.0 ELSE percent END AS percent,
  CASE WHEN reset > TIMESTAMP '{NOW}' THEN epoch_us(reset) // 1000 END AS reset_ms FROM r""")
def effective_limits(spark, sf):
    s = samples(spark, sf).withColumn("reset", F.col("at") + F.make_dt_interval((F.col("id") % 40).cast("int")))
    return s.select("id", effective_percent("percent", "reset", now()).alias("percent"),
                    F.unix_millis(future_reset("reset", now())).alias("reset_ms"))


@query("window_classes", f"""WITH {SAMPLES_SQL}, w AS (SELECT id, CASE WHEN id % 5 <> 0 THEN CASE CAST(id % 3 AS INTEGER) WHEN 0 THEN 300.0 WHEN 1 THEN 10080.0 END END AS p, id % 5 <> 0 AS hp,
  CASE WHEN id % 7 <> 0 THEN CASE CAST(id % 4 AS INTEGER) WHEN 0 THEN 10080.0 WHEN 1 THEN 60.0 END END AS q, id % 7 <> 0 AS hq FROM s),
k AS (SELECT *, hp AND coalesce(p, 0) >= 8640 AS pw, hq AND coalesce(q, 0) >= 8640 AS qw FROM w)
SELECT id, CASE WHEN hp AND NOT pw THEN 'p' WHEN hq AND NOT qw THEN 's' WHEN NOT pw AND NOT qw AND hp THEN 'p' END AS session_from,
  CASE WHEN pw THEN 'p' WHEN qw THEN 's' WHEN hq THEN 's' END AS weekly_from FROM k""")
def window_classes(spark, sf):
    i = F.col("id")

    def window(name, present, minutes):
        return F.when(present, F.struct(F.lit(name).alias("name"), minutes.alias("window_minutes")))

    s = samples(spark, sf).select(
        "id",
        window("p", i % 5 != 0, F.when(i % 3 == 0, 300.0).when(i % 3 == 1, 10080.0)).alias("p"),
        window("s", i % 7 != 0, F.when(i % 4 == 0, 10080.0).when(i % 4 == 1, 60.0)).alias("s"))
    session, weekly = classify_windows(F.col("p"), F.col("s"))
    return s.select("id", session["name"].alias("session_from"), weekly["name"].alias("weekly_from"))


_METER_SQL = f"""WITH {SAMPLES_SQL}, t AS (SELECT handle, id, us, CAST(ts AS DATE) AS d, CAST(floor(value * 100) AS BIGINT) AS v FROM s),
d AS (SELECT handle, id, us, CAST(sum(v) OVER (PARTITION BY handle, d ORDER BY us, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS day_tokens,
  CASE WHEN id % 3 <> 0 THEN (us // 18000000000 + 1) * 18000000000 END AS reset FROM t),
k AS (SELECT *, lag(day_tokens) OVER w AS last_tokens, last_value(reset IGNORE NULLS) OVER (PARTITION BY handle ORDER BY us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known
  FROM d WINDOW w AS (PARTITION BY handle ORDER BY us, id)),
x AS (SELECT *, coalesce(reset > known + 60000000 OR (known < us AND (reset IS NULL OR reset <= known)), false) AS rolled,
  CASE WHEN last_tokens IS NULL THEN 0 WHEN day_tokens >= last_tokens THEN day_tokens - last_tokens ELSE day_tokens END AS delta FROM k),
g AS (SELECT *, sum(CASE WHEN rolled THEN 1 ELSE 0 END) OVER (PARTITION BY handle ORDER BY us, id ROWS UNBOUNDED PRECEDING) AS seg FROM x)
SELECT handle, id, day_tokens, CAST(sum(delta) OVER (PARTITION BY handle, seg ORDER BY us, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS meter FROM g"""


@query("window_meter", _METER_SQL)
def window_meter_query(spark, sf):
    """Day totals that restart at midnight, with five-hour windows whose reset is reported two times in three."""
    s = samples(spark, sf).select("handle", "at", "id", F.to_date("at").alias("d"), F.floor(F.col("value") * 100).cast("long").alias("v"))
    totals = running_sum(s.withColumn("c", time_chunk("at")), ["handle", "d"], "c", ["at", "id"], F.col("v"), "day_tokens").drop("c")
    five_hours = 5 * 3600 * 1_000_000
    reset = F.timestamp_micros((F.floor(F.unix_micros("at") / five_hours) + 1) * five_hours)
    return window_meter(totals.withColumn("reset_at", F.when(F.col("id") % 3 != 0, reset))).select("handle", "id", "day_tokens", "meter")


def _greedy_sql(step: str) -> str:
    """A recursive walk from one opening to the next, per account."""
    return f"""WITH RECURSIVE {SAMPLES_SQL}, e AS (SELECT handle, ms, min(id) AS id, count(*) AS n FROM s GROUP BY ALL),
w(handle, ms) AS (SELECT handle, min(ms) FROM e GROUP BY handle UNION ALL
  SELECT w.handle, (SELECT min(e.ms) FROM e WHERE e.handle = w.handle AND e.ms >= w.ms + {step}) FROM w WHERE w.ms IS NOT NULL)"""


@query("burst_windows", f"""{_greedy_sql("14400000")}, o AS (SELECT handle, ms AS opened_ms FROM w WHERE ms IS NOT NULL)
SELECT o.handle, opened_ms, CAST(sum(n) AS BIGINT) AS events FROM o JOIN e ON e.handle = o.handle AND e.ms >= opened_ms AND e.ms < opened_ms + 14400000 GROUP BY ALL""")
def burst_windows(spark, sf):
    """Bursts of four hours from their first event."""
    s = samples(spark, sf).withColumn("at_ms", F.unix_millis("at"))
    return coalesce_bursts(s, 14_400_000)


@query("throttled_sync", f"""WITH RECURSIVE {SAMPLES_SQL}, m AS (SELECT handle, ms, arg_max(CAST(floor(value / 5) AS BIGINT), id) AS v FROM s GROUP BY ALL),
e AS (SELECT handle, ms, v, coalesce(lead(ms) OVER (PARTITION BY handle ORDER BY ms), 9000000000000000) AS until FROM m),
w(handle, ms, v) AS (SELECT handle, min(ms), arg_min(v, ms) FROM e WHERE v > 0 GROUP BY handle UNION ALL
  SELECT w.handle, n.r.ms, n.r.v FROM w, LATERAL (SELECT min({{'ms': greatest(e.ms, w.ms + 3600000), 'v': e.v}}) AS r FROM e
    WHERE e.handle = w.handle AND e.until > w.ms + 3600000 AND e.v > 0 AND e.v <> w.v) n WHERE n.r IS NOT NULL)
SELECT handle, ms AS at_ms, v AS tokens FROM w""")
def throttled_sync(spark, sf):
    """At most one upload an hour, of the newest value, skipping the value uploaded before; what waits goes out when the hour ends."""
    s = samples(spark, sf).select("handle", F.unix_millis("at").alias("at_ms"), "id", F.floor(F.col("value") / 5).cast("long").alias("tokens"))
    return throttle(s, 3_600_000)
