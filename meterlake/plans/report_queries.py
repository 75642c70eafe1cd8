"""Queries for report tables and boards."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import share_of, total_tokens
from ..functions.display import compact_tokens, countdown_text, percent_text, severity, usd_text
from ..functions.labels import screen_registry, session_name
from ..operators.board import (board_rows, context_rows, current_streak, daily_leader, domain_members, eligible, in_window,
                               last_grew, leaderboard, longest_streak, members_only, overtaken, rank_all, rank_movement,
                               spark7d)
from ..operators.ordered import rank_desc, time_chunk
from ..operators.reports import (attach_labels, day_series, digest, hourly_24, insights_models, insights_tools,
                                 org_analytics, org_top, org_trend, pace, stale_devices, stat_popularity, subagent_share,
                                 summary, summary_by_tool, suppress_small, token_mix, tools_found, top_cost_sessions,
                                 top_models, top_models_today, top_sessions_today, totals_by, trend_cells, with_share)
from ..operators.usage import hour_blocks
from ..session import materialize
from ..sources.transcripts import session_labels
from .adapter import (ACCOUNTS_SQL, DAILY_SQL, MEMBERSHIP_SQL, NOW, SUMS_SQL, TODAY, TOTAL_SQL, USAGE_SQL, accounts, daily,
                      load, membership, now, query, usage)
from .usage_queries import PRICED_SQL, SESSIONS_SQL, priced, sessions

WEEK = "2024-01-24"
FORTNIGHT = "2024-01-17"


def _days_ago(days: int) -> str:
    return str(date.fromisoformat(TODAY) - timedelta(days=days))


def _ppm(column: str):
    """A share as whole parts per million, comparable across engines."""
    return F.floor(F.col(column) * 1e6 + 1e-6).cast("long")


def _ppm_sql(part: str, whole: str) -> str:
    return f"CAST(floor(1e6 * CAST({part} AS DOUBLE) / nullif({whole}, 0) + 1e-6) AS BIGINT)"


@query("totals_by", f"""WITH {DAILY_SQL},
t AS (SELECT CASE WHEN grouping(tool) = 0 THEN 'tool' WHEN grouping(model) = 0 THEN 'model' WHEN grouping(date) = 0 THEN 'date' ELSE 'all' END AS dimension,
  coalesce(tool, model, CAST(date AS VARCHAR), '') AS name, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(cost_micro) AS BIGINT) AS cost_micro,
  count(DISTINCT day) AS active_days FROM (SELECT *, date AS day FROM daily) GROUP BY GROUPING SETS ((tool), (model), (date), ()))
SELECT dimension, name, tokens, cost_micro, active_days, tokens // active_days AS tokens_per_active_day FROM t""")
def totals_by_query(spark, sf):
    out = totals_by(daily(spark, sf))
    return out.withColumn("tokens_per_active_day", F.floor("tokens_per_active_day").cast("long"))


@query("token_mix", f"""WITH {DAILY_SQL}, s AS (SELECT {SUMS_SQL} FROM daily), u AS (UNPIVOT s ON input_tokens, output_tokens,
  cache_creation_tokens, cache_read_tokens INTO NAME kind VALUE tokens)
SELECT kind, tokens, {_ppm_sql('tokens', '(SELECT sum(tokens) FROM u)')} AS share_ppm FROM u""")
def token_mix_query(spark, sf):
    return token_mix(daily(spark, sf)).select("kind", "tokens", _ppm("share").alias("share_ppm"))


_DAY = f"DATE '{TODAY}'"


def _summary_sql(keys: str) -> str:
    parts = []
    for name, test in (("today", f"date = {_DAY}"), ("week", f"date BETWEEN {_DAY} - 6 AND {_DAY}"),
                       ("fortnight", f"date BETWEEN {_DAY} - 13 AND {_DAY}")):
        parts.append(f"CAST(sum(CASE WHEN {test} THEN tokens ELSE 0 END) AS BIGINT) AS {name}_tokens")
        parts.append(f"CAST(floor((sum(CASE WHEN {test} THEN cost_micro ELSE 0 END) + 5000) / 10000) * 10000 AS BIGINT) AS {name}_cost_micro")
    return (f"WITH {DAILY_SQL} SELECT {keys}, {', '.join(parts)} FROM daily WHERE date BETWEEN {_DAY} - 13 AND {_DAY} "
            f"GROUP BY {keys}")


@query("summary_windows", _summary_sql("handle"))
def summary_windows(spark, sf):
    return summary(daily(spark, sf, FORTNIGHT), TODAY)


@query("summary_by_tool", _summary_sql("handle, tool"))
def summary_by_tool_query(spark, sf):
    return summary_by_tool(daily(spark, sf, FORTNIGHT), TODAY)


def _series_sql(n: int, keys: str = "") -> str:
    base = f"SELECT DISTINCT {keys} FROM daily" if keys else "SELECT 1 AS one"
    lead = f"{keys}, " if keys else ""
    using = f"USING ({lead}date)"
    return f"""WITH {DAILY_SQL},
spine AS (SELECT {lead}CAST(unnest(generate_series({_DAY} - {n - 1}, {_DAY}, INTERVAL 1 DAY)) AS DATE) AS date FROM ({base})),
sums AS (SELECT {lead}date, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(cost_micro) AS BIGINT) AS cost_micro FROM daily GROUP BY ALL)
SELECT {lead}date, coalesce(tokens, 0) AS tokens, coalesce(cost_micro, 0) AS cost_micro FROM spine LEFT JOIN sums {using}"""


@query("day_series_14", _series_sql(14, "handle"))
def day_series_14(spark, sf):
    return day_series(daily(spark, sf), 14, TODAY, ["handle"])


@query("day_series_60", _series_sql(60))
def day_series_60(spark, sf):
    return day_series(daily(spark, sf, _days_ago(59)), 60, TODAY)


@query("top_models_today", f"""WITH {DAILY_SQL}, s AS (SELECT handle, model, CAST(sum(tokens) AS BIGINT) AS tokens FROM daily WHERE date = {_DAY} GROUP BY ALL)
SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY handle ORDER BY tokens DESC, model) <= 2""")
def top_models_today_query(spark, sf):
    return top_models_today(daily(spark, sf, TODAY), TODAY, 2)


@query("top_models", f"""WITH {DAILY_SQL} SELECT model, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(cost_micro) AS BIGINT) AS cost_micro
FROM daily GROUP BY model ORDER BY tokens DESC, model LIMIT 12""")
def top_models_query(spark, sf):
    return top_models(daily(spark, sf))


@query("top_sessions_today", f"""WITH {SESSIONS_SQL}, live AS (SELECT handle, session_id, tool, CAST(sum(tokens) AS BIGINT) AS tokens FROM sessions
  WHERE last_day = {_DAY} GROUP BY ALL)
SELECT handle, session_id, substr(tool, 1, 24) AS name, tool, tokens FROM live
QUALIFY row_number() OVER (PARTITION BY handle ORDER BY tokens DESC, session_id) <= 2""")
def top_sessions_today_query(spark, sf):
    from ..functions.columns import TOKEN_COLUMNS

    live = sessions(spark, sf).groupBy("handle", "session_id", "tool", "last_day").agg(*[F.sum(c).alias(c) for c in TOKEN_COLUMNS])
    return top_sessions_today(live, TODAY, 2)


@query("top_cost_sessions", f"""WITH {SESSIONS_SQL} SELECT session_id, last_day, model, cost_micro FROM (SELECT session_id || '@' || last_day || model AS u, * FROM sessions)
ORDER BY cost_micro DESC, u LIMIT 25""")
def top_cost_sessions_query(spark, sf):
    s = sessions(spark, sf).withColumn("path", F.col("session_id")).withColumn(
        "session_id", F.concat(F.col("path"), F.lit("@"), F.col("last_day").cast("string"), F.col("model")))
    return top_cost_sessions(s, 25).select(F.col("path").alias("session_id"), "last_day", "model", "cost_micro")


@query("tools_found", "SELECT DISTINCT source AS tool FROM documents ORDER BY 1 LIMIT 32")
def tools_found_query(spark, sf):
    return tools_found(load(spark, sf, "documents").select(F.col("source").alias("tool")))


def _board_sql(where: str, metric: str) -> str:
    return f"""WITH {DAILY_SQL}, t AS (SELECT handle, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(cost_micro) AS BIGINT) AS cost_micro
  FROM daily WHERE {where} GROUP BY handle HAVING sum({metric}) > 0)
SELECT rank() OVER (ORDER BY {metric} DESC) AS rank, handle, tokens, cost_micro FROM t"""


@query("leaderboard_tokens", _board_sql(f"date BETWEEN {_DAY} - 6 AND {_DAY}", "tokens"))
def leaderboard_tokens(spark, sf):
    return leaderboard(daily(spark, sf, WEEK), "7d", "tokens", TODAY)


@query("leaderboard_cost", _board_sql("true", "cost_micro"))
def leaderboard_cost(spark, sf):
    return leaderboard(daily(spark, sf), "all", "cost", TODAY)


@query("leaderboard_range", _board_sql("date BETWEEN DATE '2024-01-05' AND DATE '2024-01-11' AND tool = 'click'", "tokens"))
def leaderboard_range(spark, sf):
    return leaderboard(daily(spark, sf, "2024-01-05"), "today", "tokens", TODAY, "2024-01-05", "2024-01-11", "click")


@query("rank_global", """SELECT o_orderkey, rank() OVER (ORDER BY CAST(floor(o_totalprice) AS BIGINT) DESC) AS rank FROM orders""")
def rank_global(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", F.floor("o_totalprice").cast("long").alias("price"))
    return rank_desc(o, "price").select("o_orderkey", "rank")


@query("board_rows", f"""WITH {DAILY_SQL},
b AS (SELECT rank() OVER (ORDER BY sum(tokens) DESC) AS rank, handle, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(cost_micro) AS BIGINT) AS cost_micro
  FROM daily WHERE date BETWEEN {_DAY} - 6 AND {_DAY} GROUP BY handle HAVING sum(tokens) > 0),
td AS (SELECT handle, CAST(sum(tokens) AS BIGINT) AS today_tokens FROM daily WHERE date = {_DAY} GROUP BY handle),
w AS (SELECT * FROM daily WHERE date BETWEEN {_DAY} - 6 AND {_DAY}),
tt AS (SELECT handle, tool AS top_tool FROM (SELECT handle, tool, sum(tokens) AS t FROM w GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY handle ORDER BY t DESC, tool) = 1),
tm AS (SELECT handle, model AS top_model FROM (SELECT handle, model, sum(tokens) AS t FROM w GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY handle ORDER BY t DESC, model) = 1)
SELECT rank, b.handle, tokens, cost_micro, coalesce(today_tokens, 0) AS today_tokens, top_tool, top_model FROM b LEFT JOIN td USING (handle) LEFT JOIN tt USING (handle) LEFT JOIN tm USING (handle)""")
def board_rows_query(spark, sf):
    rows = board_rows(daily(spark, sf), "7d", "tokens", TODAY)
    return rows.drop("spark7d", "streak_days")


@query("rank_all", f"""WITH {DAILY_SQL}, t AS (SELECT handle, CAST(sum(tokens) AS BIGINT) AS a,
  CAST(sum(CASE WHEN date BETWEEN {_DAY} - 6 AND {_DAY} THEN tokens ELSE 0 END) AS BIGINT) AS w,
  CAST(sum(CASE WHEN date = {_DAY} THEN tokens ELSE 0 END) AS BIGINT) AS d FROM daily GROUP BY handle)
SELECT handle, a AS all_time_tokens, w AS weekly_tokens, d AS daily_tokens, rank() OVER (ORDER BY a DESC) AS all_time_rank,
  CASE WHEN w > 0 THEN rank() OVER (ORDER BY w DESC) END AS weekly_rank, CASE WHEN d > 0 THEN rank() OVER (ORDER BY d DESC) END AS daily_rank FROM t""")
def rank_all_query(spark, sf):
    return rank_all(daily(spark, sf), TODAY)


@query("rank_movement", f"""WITH {DAILY_SQL},
n AS (SELECT handle, rank() OVER (ORDER BY sum(tokens) DESC) AS rank FROM daily GROUP BY handle),
s AS (SELECT handle, rank() OVER (ORDER BY sum(tokens) DESC) AS pr FROM daily WHERE date <= {_DAY} - 10 GROUP BY handle)
SELECT handle, rank, pr AS previous_rank, CASE WHEN pr IS NULL THEN 'new' WHEN pr > rank THEN 'up' WHEN pr < rank THEN 'down' ELSE 'same' END AS direction,
  coalesce(abs(pr - rank), 0) AS places FROM n LEFT JOIN s USING (handle)""")
def rank_movement_query(spark, sf):
    """Boards of three earlier moments as snapshots; the newest one old enough is compared."""
    days = ("2024-01-10", "2024-01-20", "2024-01-29")
    # one fold for the board and all its snapshots; an account without usage until then has no place in one
    until = [F.sum(F.when(F.col("date") <= F.lit(day).cast("date"), total_tokens())).alias(day) for day in days]
    totals = materialize(daily(spark, sf).groupBy("handle").agg(F.sum(total_tokens()).alias("tokens"), *until), "totals")
    current = rank_desc(totals.select("handle", "tokens"), "tokens")
    snapshots = None
    for day in days:
        known = totals.filter(F.col(f"`{day}`").isNotNull()).select("handle", F.col(f"`{day}`").alias("tokens"))
        board = rank_desc(known, "tokens").select(F.to_timestamp(F.lit(f"{day} 03:00:00")).alias("bucket"), "handle", "rank")
        snapshots = board if snapshots is None else snapshots.unionByName(board)
    return rank_movement(current, snapshots, 48, now()).drop("compared_at")


_CONTEXT_SQL = f"""WITH {DAILY_SQL}, b AS (SELECT rank() OVER (ORDER BY sum(tokens) DESC) AS rank, handle, CAST(sum(tokens) AS BIGINT) AS tokens FROM daily GROUP BY handle),
o AS (SELECT *, row_number() OVER (ORDER BY rank, handle) AS i FROM b), me AS (SELECT i AS m FROM o WHERE handle = '{{who}}'),
p AS (SELECT o.*, CASE WHEN m IS NULL THEN i WHEN i <= 2 THEN i WHEN i = m THEN 3 WHEN i < m THEN 2 * (m - i) + 2 ELSE 2 * (i - m) + 3 END AS pr
  FROM o LEFT JOIN me ON true)
SELECT rank, handle, tokens FROM p ORDER BY pr LIMIT 7"""


def _context(spark, sf, who):
    totals = materialize(daily(spark, sf).groupBy("handle").agg(F.sum(total_tokens()).alias("tokens")), "totals")
    board = rank_desc(totals, "tokens")
    return context_rows(board.select("rank", "handle", "tokens"), who, 7)


@query("context_rows", _CONTEXT_SQL.format(who="8"))
def context_rows_query(spark, sf):
    return _context(spark, sf, "8")


@query("context_rows_unknown", _CONTEXT_SQL.format(who="nobody"))
def context_rows_unknown(spark, sf):
    return _context(spark, sf, "nobody")


@query("daily_leader", f"""WITH {DAILY_SQL}, t AS (SELECT handle, CAST(sum(CASE WHEN date = {_DAY} THEN tokens ELSE 0 END) AS BIGINT) AS today_tokens,
  rank() OVER (ORDER BY sum(tokens) DESC) AS rank FROM daily GROUP BY handle)
SELECT handle, rank, today_tokens FROM t WHERE today_tokens > 0 ORDER BY today_tokens DESC, rank, handle LIMIT 1""")
def daily_leader_query(spark, sf):
    d = daily(spark, sf)
    today = F.when(F.col("date") == F.lit(TODAY).cast("date"), total_tokens()).otherwise(0)
    board = rank_desc(d.groupBy("handle").agg(F.sum(total_tokens()).alias("tokens"), F.sum(today).alias("today_tokens")), "tokens")
    return daily_leader(board).select("handle", "rank", "today_tokens")


_ISLANDS_SQL = f"""WITH {USAGE_SQL}, d AS (SELECT DISTINCT handle, date FROM usage),
n AS (SELECT *, date - CAST(row_number() OVER (PARTITION BY handle ORDER BY date) AS INTEGER) AS g FROM d),
i AS (SELECT handle, g, count(*) AS days, max(date) AS last_day FROM n GROUP BY ALL)"""


@query("current_streak", f"{_ISLANDS_SQL} SELECT handle, days AS streak_days FROM i WHERE last_day = {_DAY}")
def current_streak_query(spark, sf):
    return current_streak(usage(spark, sf), TODAY)


@query("longest_streak", f"{_ISLANDS_SQL} SELECT handle, max(days) AS longest_streak_days FROM i GROUP BY handle")
def longest_streak_query(spark, sf):
    return longest_streak(usage(spark, sf))


@query("spark7d", f"""WITH s AS ({_series_sql(7, "handle")}) SELECT handle, string_agg(CAST(tokens AS VARCHAR), ',' ORDER BY date) AS spark FROM s GROUP BY handle""")
def spark7d_query(spark, sf):
    return spark7d(daily(spark, sf), TODAY).select("handle", F.array_join("spark7d", ",").alias("spark"))


@query("insights_models", f"""WITH {DAILY_SQL}, s AS (SELECT model, {SUMS_SQL}, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(cost_micro) AS BIGINT) AS cost_micro,
  count(DISTINCT handle) AS devs FROM daily GROUP BY model),
t AS (SELECT model, string_agg(tool, ',' ORDER BY t DESC, tool) AS tools FROM (SELECT model, tool, sum(tokens) AS t FROM daily GROUP BY ALL) GROUP BY model)
SELECT s.model AS norm_model, s.model AS variants, tools, tokens, cost_micro, devs, input_tokens, {_ppm_sql('tokens', '(SELECT sum(tokens) FROM s)')} AS share_ppm
FROM s JOIN t USING (model)""")
def insights_models_query(spark, sf):
    out = insights_models(daily(spark, sf))
    return out.select("norm_model", F.array_join("variants", ",").alias("variants"), F.array_join("tools", ",").alias("tools"),
                      "tokens", "cost_micro", "devs", "input_tokens", _ppm("share").alias("share_ppm"))


@query("insights_tools", f"""WITH {DAILY_SQL}, s AS (SELECT tool, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(cost_micro) AS BIGINT) AS cost_micro,
  count(DISTINCT handle) AS devs FROM daily GROUP BY tool),
t AS (SELECT tool, model AS top_model FROM (SELECT tool, model, sum(tokens) AS t FROM daily GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY tool ORDER BY t DESC, model) = 1)
SELECT tool, tokens, cost_micro, devs, top_model, {_ppm_sql('tokens', '(SELECT sum(tokens) FROM s)')} AS share_ppm FROM s JOIN t USING (tool)""")
def insights_tools_query(spark, sf):
    return insights_tools(daily(spark, sf)).withColumn("share_ppm", _ppm("share")).drop("share")


@query("share_of_total", f"""WITH {DAILY_SQL}, s AS (SELECT handle, CAST(sum(cost_micro) AS BIGINT) AS cost_micro FROM daily GROUP BY handle)
SELECT handle, cost_micro, {_ppm_sql('cost_micro', '(SELECT sum(cost_micro) FROM s)')} AS share_ppm FROM s""")
def share_of_total(spark, sf):
    s = daily(spark, sf).groupBy("handle").agg(F.sum("cost_micro").alias("cost_micro"))
    return with_share(s, "cost_micro").select("handle", "cost_micro", _ppm("share").alias("share_ppm"))


@query("trend_top_models", f"""WITH {DAILY_SQL}, top AS (SELECT model FROM daily GROUP BY model ORDER BY sum(tokens) DESC, model LIMIT 3)
SELECT date, model, CAST(sum(tokens) AS BIGINT) AS tokens FROM daily JOIN top USING (model) WHERE date BETWEEN {_DAY} - 29 AND {_DAY} GROUP BY date, model""")
def trend_top_models(spark, sf):
    return trend_cells(daily(spark, sf), 3, TODAY)


@query("stat_popularity", f"""WITH {USAGE_SQL}, s AS (SELECT handle, date AS snap, tool AS name, count(*) AS calls, sum(output_tokens) AS t, sum(CASE WHEN k < 10 THEN 1 ELSE 0 END) AS e
  FROM usage GROUP BY ALL), l AS (SELECT handle, max(snap) AS snap FROM s GROUP BY handle)
SELECT name, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(t) AS BIGINT) AS tokens, CAST(sum(e) AS BIGINT) AS errors, count(DISTINCT handle) AS devs FROM s JOIN l USING (handle, snap) GROUP BY name""")
def stat_popularity_query(spark, sf):
    snaps = usage(spark, sf).groupBy("handle", F.col("date").alias("snapshot_at"), F.col("tool").alias("name")).agg(
        F.count(F.lit(1)).alias("calls"), F.sum("output_tokens").alias("tokens"),
        F.sum(F.when(F.col("k") < 10, 1).otherwise(0)).alias("errors"))
    return stat_popularity(snaps)


@query("pace", f"""WITH {DAILY_SQL}, d AS (SELECT handle, date, sum(tokens) AS t, sum(cost_micro) AS c FROM daily GROUP BY ALL),
g AS (SELECT handle, CAST(coalesce(sum(t) FILTER (WHERE date = {_DAY}), 0) AS BIGINT) AS today_tokens, CAST(coalesce(sum(c) FILTER (WHERE date = {_DAY}), 0) AS BIGINT) AS today_cost_micro,
  sum(t) FILTER (WHERE date < {_DAY}) AS pt, sum(c) FILTER (WHERE date < {_DAY}) AS pc, count(*) FILTER (WHERE date < {_DAY}) AS pd FROM d GROUP BY handle)
SELECT handle, today_tokens, today_cost_micro, CAST(floor(today_cost_micro * 86400 / 64800) AS BIGINT) AS projected_cost_micro,
  CAST(coalesce(pt // nullif(pd, 0), 0) AS BIGINT) AS avg_daily_tokens, CAST(coalesce(pc // nullif(pd, 0), 0) AS BIGINT) AS avg_daily_cost_micro FROM g""")
def pace_query(spark, sf):
    return pace(daily(spark, sf), now())


@query("hourly_24", f"""WITH {PRICED_SQL}, s AS (SELECT hour(ts) AS hour, CAST(sum(tokens) AS BIGINT) AS tokens, sum(c) AS c FROM
  (SELECT date_trunc('hour', ts) AS ts, sum(tokens) AS tokens, floor((sum(cost_micro) + 50) / 100) * 100 AS c FROM priced WHERE date = {_DAY} GROUP BY 1) GROUP BY 1)
SELECT CAST(h AS INTEGER) AS hour, coalesce(tokens, 0) AS tokens, CAST(coalesce(c, 0) AS BIGINT) AS cost_micro FROM range(24) r(h) LEFT JOIN s ON h = hour""")
def hourly_24_query(spark, sf):
    return hourly_24(hour_blocks(priced(spark, sf, TODAY)), TODAY)


@query("org_analytics", f"""WITH {DAILY_SQL}, {MEMBERSHIP_SQL}, p AS (SELECT handle, sum(tokens) AS tokens, sum(cost_micro) AS cost_micro FROM daily GROUP BY handle)
SELECT org, count(*) AS members, count(tokens) AS active_members, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens,
  CAST(coalesce(sum(cost_micro), 0) AS BIGINT) AS cost_micro, {_ppm_sql('count(tokens)', 'count(*)')} AS adoption_ppm
FROM membership LEFT JOIN p USING (handle) GROUP BY org""")
def org_analytics_query(spark, sf):
    out = org_analytics(daily(spark, sf), membership(spark, sf))
    return out.withColumn("adoption_ppm", _ppm("adoption")).drop("adoption")


@query("org_trend", f"""WITH {DAILY_SQL}, {MEMBERSHIP_SQL}, spine AS (SELECT org, CAST(unnest(generate_series({_DAY} - 29, {_DAY}, INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT DISTINCT org FROM membership)),
s AS (SELECT org, date, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(cost_micro) AS BIGINT) AS cost_micro FROM daily JOIN membership USING (handle) GROUP BY ALL)
SELECT org, date, coalesce(tokens, 0) AS tokens, coalesce(cost_micro, 0) AS cost_micro FROM spine LEFT JOIN s USING (org, date)""")
def org_trend_query(spark, sf):
    return org_trend(daily(spark, sf, _days_ago(29)), membership(spark, sf), TODAY)


@query("org_top_members", f"""WITH {DAILY_SQL}, {MEMBERSHIP_SQL}, s AS (SELECT org, handle AS name, CAST(sum(tokens) AS BIGINT) AS tokens FROM daily JOIN membership USING (handle) GROUP BY ALL)
SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY org ORDER BY tokens DESC, name) <= 3""")
def org_top_members(spark, sf):
    return org_top(daily(spark, sf), membership(spark, sf), "handle", 3)


@query("org_top_tools", f"""WITH {DAILY_SQL}, {MEMBERSHIP_SQL}, s AS (SELECT org, tool AS name, CAST(sum(tokens) AS BIGINT) AS tokens FROM daily JOIN membership USING (handle) GROUP BY ALL)
SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY org ORDER BY tokens DESC, name) <= 5""")
def org_top_tools(spark, sf):
    return org_top(daily(spark, sf), membership(spark, sf), "tool", 5)


@query("org_top_models", f"""WITH {DAILY_SQL}, {MEMBERSHIP_SQL}, s AS (SELECT org, model AS name, CAST(sum(tokens) AS BIGINT) AS tokens FROM daily JOIN membership USING (handle) GROUP BY ALL)
SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY org ORDER BY tokens DESC, name) <= 5""")
def org_top_models(spark, sf):
    return org_top(daily(spark, sf), membership(spark, sf), "model", 5)


@query("org_suppression", f"""WITH {DAILY_SQL}, {MEMBERSHIP_SQL}, o AS (SELECT org, count(*) AS members, CAST(coalesce(sum(t), 0) AS BIGINT) AS tokens, CAST(coalesce(sum(c), 0) AS BIGINT) AS cost_micro
  FROM membership LEFT JOIN (SELECT handle, sum(tokens) AS t, sum(cost_micro) AS c FROM daily GROUP BY handle) USING (handle) GROUP BY org)
SELECT org, members, members < 60 AND org < 'M' AS aggregates_hidden, CASE WHEN members < 60 AND org < 'M' THEN 0 ELSE tokens END AS tokens,
  CASE WHEN members < 60 AND org < 'M' THEN 0 ELSE cost_micro END AS cost_micro FROM o""")
def org_suppression(spark, sf):
    o = org_analytics(daily(spark, sf), membership(spark, sf))
    return suppress_small(o, 60, F.col("org") < "M").select("org", "members", "aggregates_hidden", "tokens", "cost_micro")


@query("board_members_only", f"""WITH {DAILY_SQL}, {MEMBERSHIP_SQL}, t AS (SELECT handle, CAST(sum(tokens) AS BIGINT) AS tokens FROM daily
  WHERE handle IN (SELECT handle FROM membership WHERE org IN (SELECT n_name FROM nation WHERE n_nationkey = 3)) GROUP BY handle)
SELECT rank() OVER (ORDER BY tokens DESC) AS rank, handle, tokens FROM t""")
def board_members_only(spark, sf):
    nation = load(spark, sf, "nation").filter("n_nationkey = 3").select(F.col("n_name").alias("org"))
    chosen = membership(spark, sf).join(nation, "org", "left_semi").withColumn("org", F.lit("chosen"))
    d = members_only(daily(spark, sf), chosen, "chosen")
    return leaderboard(d, "all", "tokens", TODAY).select("rank", "handle", "tokens")


@query("board_eligible", f"""WITH {DAILY_SQL}, {ACCOUNTS_SQL}, held AS (SELECT DISTINCT handle, date FROM usage WHERE value > 60)
SELECT handle, date, CAST(sum(tokens) AS BIGINT) AS tokens FROM daily WHERE handle IN (SELECT handle FROM accounts WHERE listed AND NOT suppressed AND NOT quarantined)
AND (handle, date) NOT IN (SELECT handle, date FROM held) GROUP BY ALL""")
def board_eligible(spark, sf):
    held = usage(spark, sf).filter("value > 60").select("handle", "date").distinct()
    shown = eligible(daily(spark, sf), accounts(spark, sf), held)
    return shown.groupBy("handle", "date").agg(F.sum(total_tokens()).alias("tokens"))


_WINDOWS_SQL = """w AS (SELECT n_name AS org, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE DATE '2024-01-01' + n_nationkey END AS s,
  CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE DATE '2024-01-20' - n_nationkey % 3 * 9 END AS e FROM nation)"""


@query("org_event_window", f"""WITH {DAILY_SQL}, {MEMBERSHIP_SQL}, {_WINDOWS_SQL}
SELECT org, CAST(sum(tokens) AS BIGINT) AS tokens FROM daily JOIN membership USING (handle) JOIN w USING (org)
WHERE (s IS NULL OR e IS NULL OR e >= s) AND (s IS NULL OR date >= s) AND (e IS NULL OR date <= e) GROUP BY org""")
def org_event_window(spark, sf):
    key = F.col("n_nationkey")
    day = lambda text: F.lit(text).cast("date")
    windows = load(spark, sf, "nation").select(
        F.col("n_name").alias("org"),
        F.when(key % 4 != 0, F.date_add(day("2024-01-01"), key)).alias("start_date"),
        F.when(key % 5 != 0, F.date_sub(day("2024-01-20"), key % 3 * 9)).alias("end_date"))
    owned = daily(spark, sf).join(membership(spark, sf), "handle")
    valid, _ = in_window(owned, windows)
    return valid.groupBy("org").agg(F.sum(total_tokens()).alias("tokens"))


@query("domain_members", """SELECT r_name AS org, CAST(c_custkey AS VARCHAR) AS handle FROM customer JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey <> 2""")
def domain_members_query(spark, sf):
    """Mail addresses made of the nation; each region owns the domains of its nations and one does not allow joining."""
    nation = load(spark, sf, "nation")
    users = load(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").cast("string").alias("handle"), F.concat(F.lit("a@b@"), F.col("n_name"), F.lit(".Example")).alias("email"))
    orgs = nation.join(load(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("org")).agg(
        F.first(F.col("n_regionkey") != 2).alias("allow_domain_join"),
        F.collect_set(F.concat(F.lower("n_name"), F.lit(".example"))).alias("email_domains"))
    return domain_members(users, orgs)


_RANKS_SQL = f"""WITH {USAGE_SQL}, d AS (SELECT handle, date, CAST(sum{TOTAL_SQL} AS BIGINT) AS t FROM usage GROUP BY ALL),
r AS (SELECT handle, date, t, rank() OVER (PARTITION BY date ORDER BY t DESC) AS rk FROM d)"""


def _day_ranks(spark, sf):
    d = usage(spark, sf).groupBy("handle", "date").agg(F.sum(total_tokens()).alias("t"))
    return rank_desc(d, "t", "daily_rank", keys=["date"]).withColumn("observed_at", F.col("date").cast("timestamp"))


@query("overtaken", f"""{_RANKS_SQL}, p AS (SELECT *, lag(rk) OVER (PARTITION BY handle ORDER BY date) AS prev FROM r)
SELECT handle, date, prev AS previous_rank, rk AS daily_rank FROM p WHERE rk > prev""")
def overtaken_query(spark, sf):
    out = overtaken(_day_ranks(spark, sf), time_chunk("observed_at", 86_400 * 7))
    return out.select("handle", F.to_date("observed_at").alias("date"),
                      F.col("previous_rank").cast("long").alias("previous_rank"), F.col("daily_rank").cast("long").alias("daily_rank"))


@query("last_grew", f"""{_RANKS_SQL}, p AS (SELECT *, lag(t) OVER (PARTITION BY handle ORDER BY date) AS prev FROM r)
SELECT handle, max(date) FILTER (WHERE t > prev) AS last_grew FROM p GROUP BY handle""")
def last_grew_query(spark, sf):
    totals = _day_ranks(spark, sf).withColumnRenamed("t", "total")
    return last_grew(totals, time_chunk("observed_at", 86_400 * 7)).withColumn("last_grew", F.to_date("last_grew"))


@query("stale_devices", f"""SELECT CAST(user_id AS VARCHAR) AS device_id, epoch_us(max(ts)) // 1000000 AS last_s,
  epoch_us(TIMESTAMP '{NOW}') // 1000000 - epoch_us(max(ts)) // 1000000 > 15 * 120 AS stale FROM events WHERE ts <= TIMESTAMP '{NOW}' GROUP BY user_id""")
def stale_devices_query(spark, sf):
    syncs = usage(spark, sf).filter(F.col("ts") <= now()).select(F.col("handle").alias("device_id"), F.col("ts").alias("synced_at"))
    return stale_devices(syncs, now()).select("device_id", F.unix_seconds("last_sync").alias("last_s"), "stale")


@query("daily_digest", f"""WITH {DAILY_SQL}, s AS (SELECT handle, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(floor((sum(cost_micro) + 5000) / 10000) * 10000 AS BIGINT) AS cost_micro,
  rank() OVER (ORDER BY sum(tokens) DESC) AS daily_rank FROM daily WHERE date = {_DAY} GROUP BY handle)
SELECT handle, {_DAY} AS day, tokens, cost_micro, daily_rank FROM s WHERE CAST(handle AS BIGINT) % 24 <= 18 AND CAST(handle AS BIGINT) % 3 <> 0""")
def daily_digest(spark, sf):
    """Each account has its own digest hour; every third got today's digest already."""
    d = daily(spark, sf, TODAY)
    s = summary(d, TODAY)
    account = F.col("handle").cast("long")
    sent = s.filter(account % 3 == 0).select("handle", F.lit(TODAY).cast("date").alias("day"))
    return digest(s, rank_all(d, TODAY), account % 24, now(), sent)


@query("display_report", f"""WITH {DAILY_SQL}, d AS (SELECT handle, CAST(sum(tokens) AS BIGINT) AS n, CAST(sum(cost_micro) AS BIGINT) AS m FROM daily GROUP BY handle),
u AS (SELECT *, CASE WHEN n >= 999950000 THEN 1000000000 WHEN n >= 999950 THEN 1000000 WHEN n >= 1000 THEN 1000 ELSE 1 END AS unit, (m + 5000) // 10000 AS cents, n % 200000 AS s, n % 120 AS p FROM d),
t AS (SELECT *, CAST(floor(n / unit * 10 + 0.5) AS BIGINT) AS tenths FROM u)
SELECT handle, CASE WHEN unit = 1 THEN CAST(n AS VARCHAR) ELSE tenths // 10 || CASE WHEN tenths % 10 = 0 THEN '' ELSE '.' || tenths % 10 END
    || CASE unit WHEN 1000 THEN 'K' WHEN 1000000 THEN 'M' ELSE 'B' END END AS tokens,
  CASE WHEN m >= 100000000 THEN '$' || (m + 500000) // 1000000 ELSE '$' || cents // 100 || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') END AS cost,
  least(p, 100) || '%' AS percent, CASE WHEN p >= 95 THEN 'critical' WHEN p >= 80 THEN 'amber' ELSE 'normal' END AS severity,
  CASE WHEN s <= 0 THEN 'now' WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN s // 60 || 'm' WHEN s < 86400 THEN s // 3600 || 'h ' || s // 60 % 60 || 'm'
    ELSE s // 86400 || 'd ' || s // 3600 % 24 || 'h' END AS resets_in FROM t""")
def display_report(spark, sf):
    d = daily(spark, sf).groupBy("handle").agg(F.sum(total_tokens()).alias("tokens"), F.sum("cost_micro").alias("cost_micro"))
    percent = F.col("tokens") % 120 * 1.0
    return d.select("handle", compact_tokens("tokens").alias("tokens"), usd_text("cost_micro").alias("cost"),
                    percent_text(percent).alias("percent"), severity(percent).alias("severity"),
                    countdown_text(F.col("tokens") % 200_000).alias("resets_in"))


@query("screen_registry", """WITH n AS (SELECT DISTINCT lower(replace(c_mktsegment, 'E', '3')) || '-' || c_custkey % 50 || CASE WHEN c_custkey % 11 = 0 THEN '--x' ELSE '' END AS slug FROM customer)
SELECT slug, slug NOT LIKE '%--%' AND length(slug) BETWEEN 2 AND 32 AND slug <> 'building-7' AS valid_slug, slug NOT LIKE 'hous3hold%' AND slug NOT LIKE 'machin3ry%' AS clean_text FROM n""")
def screen_registry_query(spark, sf):
    """Customer segments as slugs; the reserved and blocked words are the caller's."""
    c = load(spark, sf, "customer")
    slug = F.concat(F.lower(F.translate("c_mktsegment", "E", "3")), F.lit("-"), (F.col("c_custkey") % 50).cast("string"),
                    F.when(F.col("c_custkey") % 11 == 0, "--x").otherwise(""))
    words = spark.createDataFrame([("building-7",), ("household",), ("machinery",)], "word string")
    # named, not the first row: which row comes first is open once the words lie in several partitions
    return screen_registry(c.select(slug.alias("slug")).distinct(), words.filter("word = 'building-7'"), words.filter("word <> 'building-7'"))


@query("session_names", """SELECT doc_id, substr(list_last(string_split(lang || '/' || source || '/' || doc_id || 'abcdefghijklmnopqrstuvwxyz', '/')), 1, 24) AS name FROM documents""")
def session_names(spark, sf):
    d = load(spark, sf, "documents")
    path = F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit("abcdefghijklmnopqrstuvwxyz")))
    return d.select("doc_id", session_name(path).alias("name"))


@query("attach_labels", """SELECT doc_id || 'x' AS session_id, CASE WHEN doc_id % 2 = 0 THEN lang || '/' || source ELSE substr(doc_id || 'x', 1, 24) END AS name FROM documents""")
def attach_labels_query(spark, sf):
    """Sessions named by their project folder where one is known, else by their id."""
    d = load(spark, sf, "documents")
    sid = F.concat(F.col("doc_id").cast("string"), F.lit("x"))
    folder = F.concat(F.lit("file:/logs/-home-"), "lang", F.lit("-"), "source", F.lit("/"), sid, F.lit(".jsonl"))
    labels = session_labels(d.filter("doc_id % 2 = 0").select(folder.alias("file")))
    return attach_labels(d.select(sid.alias("session_id")), labels).select("session_id", "name")
