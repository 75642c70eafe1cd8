"""Queries over request records and daily rows: duplicates, prices, sources, quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import (TOKEN_COLUMNS, cost_usd, epoch_to_ts, iso_to_ts, local_day, plausible_day,
                                 plausible_instant, submitter_today, to_micro, token_count, total_tokens)
from ..functions.labels import machine_label, model_key, session_pseudonym
from ..operators.dedupe import dedupe_requests, dedupe_sessions, merge_blocks, merge_daily
from ..operators.pricing import attach_cost, cache_efficiency, price_floor, resolve_prices
from ..operators.reports import cap_by_tokens, verify_export
from ..operators.sanitize import daily_rules, flag_rows, label_daily
from ..operators.usage import (daily_usage, distinct_tools, generation_daily, hour_blocks, merge_tiers, nonzero_usage,
                               select_source, split_cost, task_daily, union_sources)
from .adapter import (COST_SQL, DAILY_SQL, NOW, SUMS_SQL, TODAY, TOTAL_SQL, USAGE_SQL, daily, load, now, pick, price_dim,
                      query, usage)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request records with a half-sized copy of each third event; every eleventh has no real id."""
    real = F.col("event_id") % 11 != 0
    copies = F.when(real & (F.col("event_id") % 3 == 0), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = usage(spark, sf_dir).withColumn("copy", F.explode(copies))
    halved = [F.floor(F.col(c) / F.col("copy")).cast("long").alias(c) for c in TOKEN_COLUMNS]
    return rows.select(
        F.col("event_id").cast("string").alias("key"), real.alias("has_real_id"), "ts", "handle", "tool", "date", "model",
        *halved, F.concat(F.lit("f"), "handle").alias("file"), F.lit(0).alias("chunk"),
        (F.col("event_id") * 2 - F.col("copy")).alias("ord"),
    )


REQUESTS_SQL = f"""{USAGE_SQL},
requests AS (SELECT CAST(event_id AS VARCHAR) AS key, event_id % 11 <> 0 AS has_real_id, ts, handle, tool, date, model,
  CAST(floor(input_tokens / copy) AS BIGINT) AS input_tokens, CAST(floor(output_tokens / copy) AS BIGINT) AS output_tokens,
  CAST(floor(cache_creation_tokens / copy) AS BIGINT) AS cache_creation_tokens,
  CAST(floor(cache_read_tokens / copy) AS BIGINT) AS cache_read_tokens, event_id * 2 - copy AS ord
  FROM usage, (VALUES (1), (2)) c(copy) WHERE copy = 1 OR (event_id % 11 <> 0 AND event_id % 3 = 0)),
kept AS (SELECT * FROM requests QUALIFY row_number() OVER (PARTITION BY key ORDER BY {TOTAL_SQL} DESC, ord) = 1)
"""


@query("dedupe_max_wins", f"WITH {REQUESTS_SQL} SELECT key, date, tool, model, {', '.join(TOKEN_COLUMNS)}, ord FROM kept")
def dedupe_max_wins(spark, sf):
    return dedupe_requests(requests(spark, sf)).select("key", "date", "tool", "model", *TOKEN_COLUMNS, "ord")


@query("daily_usage", f"""WITH {REQUESTS_SQL},
b AS (SELECT handle, tool, date, model, {SUMS_SQL}, CAST(sum(CASE WHEN has_real_id THEN 1 ELSE 0 END) AS BIGINT) AS request_count
  FROM kept GROUP BY ALL)
SELECT b.*, {COST_SQL} AS cost_micro FROM b LEFT JOIN rates USING (model) WHERE {TOTAL_SQL} > 0""")
def daily_usage_query(spark, sf):
    kept = dedupe_requests(requests(spark, sf))
    folded = daily_usage(kept, resolve_prices(kept, price_dim(spark)), ("handle", "tool"))
    return folded.select("handle", "tool", "date", "model", *TOKEN_COLUMNS, "request_count", "cost_micro")


@query("merge_daily", f"""WITH {DAILY_SQL},
raw AS (SELECT date, tool, model, 'cli' AS origin, input_tokens, output_tokens, cache_creation_tokens, cache_read_tokens, cost_micro,
  CAST(handle AS BIGINT) % 2 = 0 AS verified, CASE WHEN tool = 'view' THEN NULL ELSE request_count END AS request_count FROM daily)
SELECT date, tool, model, origin, {SUMS_SQL}, CAST(sum(cost_micro) AS BIGINT) AS cost_micro, bool_and(verified) AS verified,
  CAST(sum(request_count) AS BIGINT) AS request_count FROM raw GROUP BY date, tool, model, origin""")
def merge_daily_query(spark, sf):
    raw = (
        daily(spark, sf)
        .withColumn("origin", F.lit("cli"))
        .withColumn("verified", F.col("handle").cast("long") % 2 == 0)
        .withColumn("request_count", F.when(F.col("tool") != "view", F.col("request_count")))
    )
    return merge_daily(raw).select("date", "tool", "model", "origin", *TOKEN_COLUMNS, "cost_micro", "verified", "request_count")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session per account, tool and day; the order column tells repeats of one id apart."""
    return daily(spark, sf_dir).select(
        F.concat_ws("/", "handle", "tool").alias("session_id"), "handle", "tool", "model", *TOKEN_COLUMNS, "cost_micro",
        F.col("date").alias("last_day"),
        (F.date_diff("date", F.lit("2024-01-01").cast("date")) * 10 + F.length("model")).cast("long").alias("ord"),
    )


SESSIONS_SQL = f"""{DAILY_SQL},
sessions AS (SELECT handle || '/' || tool AS session_id, handle, tool, model, input_tokens, output_tokens, cache_creation_tokens,
  cache_read_tokens, cost_micro, tokens, date AS last_day,
  CAST(date_diff('day', DATE '2024-01-01', date) * 10 + length(model) AS BIGINT) AS ord FROM daily),
one AS (SELECT * FROM sessions QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY tokens DESC, ord DESC) = 1)
"""


@query("dedupe_sessions", f"WITH {SESSIONS_SQL} SELECT session_id, last_day, model, input_tokens, output_tokens, cost_micro FROM one")
def dedupe_sessions_query(spark, sf):
    return dedupe_sessions(sessions(spark, sf)).select("session_id", "last_day", "model", "input_tokens", "output_tokens", "cost_micro")


PRICED_SQL = f"""{USAGE_SQL},
priced AS (SELECT u.*, {TOTAL_SQL} AS tokens, {COST_SQL} AS cost_micro FROM usage u LEFT JOIN rates USING (model))"""


def priced(spark: SparkSession, sf_dir: str, since: str | None = None) -> DataFrame:
    u = usage(spark, sf_dir, since)
    return attach_cost(u, resolve_prices(u, price_dim(spark)), raw=True)


@query("cost_estimate", f"WITH {PRICED_SQL} SELECT event_id, model, cost_micro FROM priced")
def cost_estimate(spark, sf):
    return priced(spark, sf).select("event_id", "model", "cost_micro")


@query("hour_blocks", f"""WITH {PRICED_SQL} SELECT handle, CAST(epoch_ms(date_trunc('hour', ts)) AS BIGINT) AS start_ms,
  CAST(sum(tokens) AS BIGINT) AS total_tokens, CAST(floor((sum(cost_micro) + 50) / 100) * 100 AS BIGINT) AS cost_micro
  FROM priced GROUP BY ALL""")
def hour_blocks_query(spark, sf):
    return hour_blocks(priced(spark, sf), ("handle",)).select(
        "handle", F.unix_millis("start_time").alias("start_ms"), "total_tokens", "cost_micro")


@query("merge_blocks", f"""WITH {PRICED_SQL},
b AS (SELECT handle, date_trunc('hour', ts) AS h, sum(tokens) AS t, floor((sum(cost_micro) + 50) / 100) * 100 AS c FROM priced GROUP BY ALL)
SELECT CAST(epoch_ms(h) AS BIGINT) AS start_ms, CAST(sum(t) AS BIGINT) AS total_tokens, CAST(sum(c) AS BIGINT) AS cost_micro FROM b GROUP BY h""")
def merge_blocks_query(spark, sf):
    blocks = hour_blocks(priced(spark, sf), ("handle",))
    return merge_blocks(blocks).select(F.unix_millis("start_time").alias("start_ms"), "total_tokens", "cost_micro")


@query("request_priced_daily", f"""WITH {PRICED_SQL},
p AS (SELECT *, CASE WHEN k % 4 = 0 THEN k * 1000 + 1 ELSE cost_micro END AS c FROM priced)
SELECT tool, date, model, {SUMS_SQL}, CAST(sum(c) AS BIGINT) AS cost_micro, count(*) AS request_count FROM p GROUP BY tool, date, model""")
def request_priced_daily(spark, sf):
    """Task requests: the stored cost where there is one, else the estimate of each request."""
    u = usage(spark, sf).withColumn("stored_micro", F.when(F.col("k") % 4 == 0, F.col("k") * 1000 + 1))
    return task_daily(u, resolve_prices(u, price_dim(spark)))


@query("generation_daily", f"""WITH {PRICED_SQL},
g AS (SELECT date, model, input_tokens, output_tokens, CAST(round(coalesce(input_tokens * p_in + output_tokens * p_out, 0), 0) AS BIGINT) AS c
  FROM usage LEFT JOIN rates USING (model))
SELECT date, model, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
  CAST(sum(c) AS BIGINT) AS cost_micro, count(*) AS request_count FROM g WHERE input_tokens + output_tokens > 0 GROUP BY date, model""")
def generation_daily_query(spark, sf):
    zero = F.lit(0).cast("long")
    u = usage(spark, sf).withColumn("cache_creation_tokens", zero).withColumn("cache_read_tokens", zero).filter(total_tokens() > 0)
    return generation_daily(u, resolve_prices(u, price_dim(spark))).drop("cache_creation_tokens", "cache_read_tokens")


@query("cost_split", f"""WITH {DAILY_SQL},
d AS (SELECT handle, date, tool, model, tokens, sum(cost_micro) OVER (PARTITION BY handle, date) AS day_micro,
  sum(tokens) OVER (PARTITION BY handle, date) AS day_tokens FROM daily)
SELECT handle, date, tool, model, CASE WHEN day_tokens > 0 THEN
  CAST((2 * CAST(day_micro AS HUGEINT) * tokens + day_tokens) // (2 * day_tokens) AS BIGINT) ELSE 0 END AS cost_micro FROM d""")
def cost_split(spark, sf):
    d = daily(spark, sf)
    day = d.groupBy("handle", "date").agg(F.sum("cost_micro").alias("day_micro"))
    return split_cost(d.drop("cost_micro").join(day, ["handle", "date"]), ["handle", "date"]).select(
        "handle", "date", "tool", "model", "cost_micro")


# Raw model spellings of the resolution queries.
SPELLINGS = (
    "openrouter/anthropic/claude-opus-4-8", "us.anthropic.claude-sonnet-4-5-20250929-v1:0", "gpt-5-2025-08-07",
    "GPT-5-Codex ", "claude-opus-4-8-thinking", "gemini-2.5-flash", "grok-4", "mystery", "o3-mini", "claude-opus-99",
    "gpt-5-latest", "deepseek-chat:latest", "gemini-2.5-pro@20250219", "claude-v2:1",
)


def spelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = pick(SPELLINGS, F.col("k") % len(SPELLINGS))
    return usage(spark, sf_dir).withColumn("model", F.when(raw == "mystery", F.concat_ws("-", raw, "k")).otherwise(raw))


_SPELLED = "'" + "','".join(SPELLINGS) + "'"
RESOLVE_SQL = rf"""{USAGE_SQL},
spelled AS (SELECT u.* EXCLUDE (model), CASE WHEN s = 'mystery' THEN s || '-' || k ELSE s END AS model FROM
  (SELECT *, ([{_SPELLED}])[CAST(k % {len(SPELLINGS)} AS INTEGER) + 1] AS s FROM usage) u),
m AS (SELECT DISTINCT model FROM spelled),
n1 AS (SELECT model, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(model)), '^.*/', ''),
  '^(?:us|eu|au|jp|apac|global|anthropic|amazon|meta|openai|google|vertex|azure|mistral)\.(?:[a-z0-9_-]+\.)*([a-z])', '\1'),
  ':[0-9]+$', ''), ':latest$', '') AS norm FROM m),
n2 AS (SELECT *, regexp_replace(regexp_replace(norm, '[-@]20[0-9]{{6}}$', ''), '-20[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}$', '') AS dl FROM n1),
n3 AS (SELECT *, string_split(dl, '-') AS w FROM n2),
cand AS (SELECT model, 0 AS p, norm AS key FROM n3 UNION ALL SELECT model, 1, dl FROM n3
  UNION ALL SELECT model, 2, regexp_replace(norm, '-latest$', '') FROM n3 WHERE norm LIKE '%-latest'
  UNION ALL SELECT model, 2 + i, array_to_string(w[1:len(w) - i], '-') FROM n3, (VALUES (1), (2), (3)) t(i) WHERE len(w) - i >= 2),
dim(key, p_in) AS (VALUES ('claude-opus-4-8', 5::DECIMAL(12,6)), ('claude-sonnet-4-5', 3), ('gpt-5', 1.25), ('gemini-2.5-pro', 1.25)),
hit AS (SELECT c.model, c.key AS price_key, p_in FROM cand c JOIN dim USING (key) QUALIFY row_number() OVER (PARTITION BY c.model ORDER BY c.p) = 1),
tier AS (SELECT model, CASE WHEN regexp_matches(model, '(?i)fable') THEN 10 WHEN regexp_matches(model, '(?i)opus') THEN 5
  WHEN regexp_matches(model, '(?i)sonnet') THEN 3 WHEN regexp_matches(model, '(?i)haiku') THEN 1
  WHEN regexp_matches(model, '(?i)gpt-4o|gpt-4\.1') THEN 2.5 WHEN regexp_matches(model, '(?i)gpt-5|o[134](-|$)|codex') THEN 1.25
  WHEN regexp_matches(model, '(?i)gemini.*flash') THEN 0.3 WHEN regexp_matches(model, '(?i)gemini') THEN 2
  WHEN regexp_matches(model, '(?i)grok') THEN 3 WHEN regexp_matches(model, '(?i)deepseek') THEN 0.28 END AS t_in FROM m),
resolved AS (SELECT m.model, price_key, CASE WHEN hit.model IS NOT NULL THEN 'table' WHEN t_in IS NOT NULL THEN 'family' END AS price_via,
  CAST(coalesce(p_in, t_in) * 1000000 AS BIGINT) AS in_micro FROM m LEFT JOIN hit USING (model) LEFT JOIN tier USING (model))
"""


@query("price_resolve", f"WITH {RESOLVE_SQL} SELECT * FROM resolved")
def price_resolve(spark, sf):
    r = resolve_prices(spelled(spark, sf), price_dim(spark))
    return r.select("model", "price_key", "price_via", (F.col("price_in") * 1_000_000).cast("long").alias("in_micro"))


@query("price_family_fallback", f"""WITH {RESOLVE_SQL}
SELECT model, price_via, count(*) AS requests, CAST(sum(input_tokens) AS BIGINT) AS input_tokens FROM spelled JOIN resolved USING (model)
WHERE price_via = 'family' GROUP BY ALL""")
def price_family_fallback(spark, sf):
    s = spelled(spark, sf)
    family = resolve_prices(s, price_dim(spark)).filter("price_via = 'family'").select("model", "price_via")
    return s.join(family, "model").groupBy("model", "price_via").agg(
        F.count(F.lit(1)).alias("requests"), F.sum("input_tokens").alias("input_tokens"))


@query("price_live_override", f"""WITH {PRICED_SQL}
SELECT model, CAST(sum(CAST(round(coalesce(input_tokens * p, 0), 0) AS BIGINT)) AS BIGINT) AS input_cost FROM
 (SELECT model, input_tokens, CASE model WHEN 'gpt-5' THEN 2.5 WHEN 'gpt-5-codex' THEN 2.5 WHEN 'unknown-x' THEN 4 ELSE p_in END AS p
  FROM usage LEFT JOIN rates USING (model)) GROUP BY model""")
def price_live_override(spark, sf):
    """A live list that re-prices one key and adds another, over the baked list."""
    u = usage(spark, sf)
    baked = price_dim(spark)
    changed = baked.filter("key = 'gpt-5'").withColumn("price_in", F.lit("2.5").cast("decimal(12,6)"))
    added = changed.withColumn("key", F.lit("unknown-x")).withColumn("price_in", F.lit("4").cast("decimal(12,6)"))
    resolved = resolve_prices(u, baked, live=changed.unionByName(added))
    one = u.join(resolved.select("model", "price_in"), "model", "left")
    cost = F.round(F.coalesce(F.col("input_tokens").cast("decimal(20,0)") * F.col("price_in"), F.lit(0)), 0).cast("long")
    return one.groupBy("model").agg(F.sum(cost).alias("input_cost"))


@query("cache_savings", f"""WITH {DAILY_SQL},
m AS (SELECT handle, model, {SUMS_SQL} FROM daily GROUP BY ALL),
s AS (SELECT m.*, CAST(round(cache_read_tokens * greatest(coalesce(p_in - p_cr, 0), 0), 0) AS BIGINT) AS saved FROM m LEFT JOIN rates USING (model))
SELECT handle, CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens, CAST(sum(cache_creation_tokens) AS BIGINT) AS cache_creation_tokens,
  CAST(sum(saved) AS BIGINT) AS saved_micro,
  CAST(floor(1e6 * sum(cache_read_tokens) / (sum(cache_read_tokens) + sum(input_tokens))) AS BIGINT) AS hit_rate_ppm FROM s GROUP BY handle""")
def cache_savings(spark, sf):
    d = daily(spark, sf)
    out = cache_efficiency(d, resolve_prices(d, price_dim(spark)), ["handle"])
    return out.withColumn("hit_rate_ppm", F.floor(F.col("hit_rate") * 1e6 + 1e-6).cast("long")).drop("hit_rate")


@query("price_floor_check", f"""WITH {DAILY_SQL}, p AS (SELECT d.*, CASE WHEN p_cr > 0 THEN p_cr / 4 END AS fl,
  CASE WHEN CAST(handle AS BIGINT) % 5 = 0 THEN cost_micro // 100 ELSE cost_micro END AS c FROM daily d LEFT JOIN rates USING (model))
SELECT model, count(*) AS row_count, CAST(sum(CASE WHEN tokens > 0 AND c < tokens * fl THEN 1 ELSE 0 END) AS BIGINT) AS below,
  CAST(sum(CASE WHEN fl IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS without_floor FROM p GROUP BY model""")
def price_floor_check(spark, sf):
    d = daily(spark, sf)
    cheap = d.withColumn("cost_micro", F.when(F.col("handle").cast("long") % 5 == 0, F.floor(F.col("cost_micro") / 100).cast("long"))
                         .otherwise(F.col("cost_micro")))
    out = price_floor(cheap, resolve_prices(d, price_dim(spark)))
    return out.groupBy("model").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum(F.when(F.col("below_floor"), 1).otherwise(0)).alias("below"),
        F.sum(F.when(F.col("floor_rate").isNull(), 1).otherwise(0)).alias("without_floor"))


@query("cap_by_tokens", f"""WITH {DAILY_SQL}
SELECT handle, date, tool, model, tokens FROM daily
QUALIFY row_number() OVER (PARTITION BY handle ORDER BY tokens DESC, date, tool, model) <= 20""")
def cap_by_tokens_query(spark, sf):
    return cap_by_tokens(daily(spark, sf), 20, ["handle"], ["date", "tool", "model"]).select(
        "handle", "date", "tool", "model", total_tokens().alias("tokens"))


@query("cap_by_tokens_wide", f"""WITH {USAGE_SQL}
SELECT tool, event_id FROM usage QUALIFY row_number() OVER (PARTITION BY tool ORDER BY {TOTAL_SQL} DESC, event_id) <= 1500""")
def cap_by_tokens_wide(spark, sf):
    """A cap above the size Spark limits before the shuffle: the two-pass form."""
    return cap_by_tokens(usage(spark, sf), 1500, ["tool"], ["event_id"]).select("tool", "event_id")


@query("verify_export", f"""WITH {REQUESTS_SQL},
c AS (SELECT *, count(*) OVER (PARTITION BY handle) > 60 AS truncated FROM kept)
SELECT handle, date, epoch_us(ts) // 1000 AS ts_ms, model, input_tokens, substr(sha256(key), 1, 32) AS req_hash, truncated FROM c
QUALIFY row_number() OVER (PARTITION BY handle ORDER BY ts DESC, key) <= 60""")
def verify_export_query(spark, sf):
    kept = dedupe_requests(requests(spark, sf))
    return verify_export(kept, 60, ["handle"]).select("handle", "date", "ts_ms", "model", "input_tokens", "req_hash", "truncated")


@query("nonzero_usage", f"""WITH {USAGE_SQL} SELECT event_id FROM (SELECT event_id, input_tokens // 2000 + k // 60 AS t,
  CASE WHEN k % 10 = 0 THEN k ELSE 0 END AS c FROM usage) WHERE t > 0 OR c > 0""")
def nonzero_usage_query(spark, sf):
    zero = F.lit(0).cast("long")
    u = usage(spark, sf).select(
        "event_id", F.floor(F.col("input_tokens") / 2000).cast("long").alias("input_tokens"),
        F.floor(F.col("k") / 60).cast("long").alias("output_tokens"), zero.alias("cache_creation_tokens"),
        zero.alias("cache_read_tokens"), F.when(F.col("k") % 10 == 0, F.col("k")).otherwise(zero).alias("cost_micro"))
    return nonzero_usage(u).select("event_id")


@query("quarantine_rows", f"""WITH {DAILY_SQL}, r AS (SELECT date, CASE WHEN tokens % 13 = 0 THEN '' ELSE tool END AS tool,
  CASE WHEN tokens % 17 = 0 THEN repeat('m', 129) ELSE model END AS model,
  CASE WHEN tokens % 7 = 0 THEN -input_tokens - 1 ELSE input_tokens END AS input_tokens,
  CASE WHEN tokens % 19 = 0 THEN 100000000001 ELSE output_tokens END AS output_tokens, cost_micro FROM daily)
SELECT coalesce(CASE WHEN length(tool) < 1 THEN 'tool' WHEN length(model) > 128 THEN 'model' WHEN input_tokens < 0 THEN 'input_tokens'
  WHEN output_tokens > 100000000000 THEN 'output_tokens' END, 'valid') AS reason, count(*) AS row_count,
  CAST(sum(cost_micro) AS BIGINT) AS cost_micro FROM r GROUP BY 1""")
def quarantine_rows(spark, sf):
    t = total_tokens()
    d = daily(spark, sf).withColumn("t", t)
    bad = (
        d.withColumn("tool", F.when(F.col("t") % 13 == 0, "").otherwise(F.col("tool")))
        .withColumn("model", F.when(F.col("t") % 17 == 0, F.repeat(F.lit("m"), 129)).otherwise(F.col("model")))
        .withColumn("input_tokens", F.when(F.col("t") % 7 == 0, -F.col("input_tokens") - 1).otherwise(F.col("input_tokens")))
        .withColumn("output_tokens", F.when(F.col("t") % 19 == 0, F.lit(100_000_000_001)).otherwise(F.col("output_tokens")))
    )
    flagged = flag_rows(bad, daily_rules())
    return flagged.groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("cost_micro").alias("cost_micro"))


_LABEL_SQL = r"""CASE WHEN length(s) BETWEEN 1 AND 64 AND regexp_full_match(s, '[A-Za-z0-9][A-Za-z0-9._:/@+~-]*') THEN s
  ELSE 'agent-' || substr(sha256('agent' || chr(0) || s), 1, 12) END"""


@query("label_pseudonyms", rf"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source ELSE regexp_replace(text, '^\s+|\s+$', '', 'g') END AS s FROM documents)
SELECT doc_id, {_LABEL_SQL} AS label, 'local-' || substr(sha256('session' || chr(0) || CAST(doc_id AS VARCHAR)), 1, 24) AS session FROM d""")
def label_pseudonyms(spark, sf):
    d = load(spark, sf, "documents")
    s = F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(F.col("text"))
    return d.select("doc_id", machine_label(s, "agent", 64).alias("label"), session_pseudonym("doc_id").alias("session"))


@query("model_keys", f"WITH {RESOLVE_SQL} SELECT model, norm AS model_key FROM n1")
def model_keys(spark, sf):
    return spelled(spark, sf).select("model").distinct().withColumn("model_key", model_key("model"))


@query("coerce_numbers", """WITH t AS (SELECT event_id, CASE CAST(event_id % 6 AS INTEGER) WHEN 0 THEN CAST(value AS VARCHAR) WHEN 1 THEN 'x' || value
  WHEN 2 THEN '-' || value WHEN 3 THEN 'NaN' WHEN 4 THEN NULL ELSE CAST(event_id AS VARCHAR) END AS raw FROM events),
n AS (SELECT event_id, CASE WHEN isfinite(TRY_CAST(raw AS DOUBLE)) THEN TRY_CAST(raw AS DOUBLE) END AS x FROM t)
SELECT event_id, CAST(CASE WHEN x > 0 THEN floor(x + 0.5) ELSE 0 END AS BIGINT) AS tokens,
  CAST(CASE WHEN x > 0 THEN floor(x * 1000000 + 0.5) ELSE 0 END AS BIGINT) AS cost_micro FROM n""")
def coerce_numbers(spark, sf):
    e = load(spark, sf, "events")
    v = F.col("value").cast("string")
    raw = (F.when(F.col("event_id") % 6 == 0, v).when(F.col("event_id") % 6 == 1, F.concat(F.lit("x"), v))
           .when(F.col("event_id") % 6 == 2, F.concat(F.lit("-"), v)).when(F.col("event_id") % 6 == 3, F.lit("NaN"))
           .when(F.col("event_id") % 6 == 5, F.col("event_id").cast("string")))
    return e.select("event_id", token_count(raw).alias("tokens"), to_micro(cost_usd(raw)).alias("cost_micro"))


@query("epoch_normalize", """WITH t AS (SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events)
SELECT event_id, CAST(CASE CAST(event_id % 4 AS INTEGER) WHEN 0 THEN ms WHEN 1 THEN (ms // 1000) * 1000 WHEN 2 THEN ms END AS BIGINT) AS ms FROM t""")
def epoch_normalize(spark, sf):
    """Epoch milliseconds, epoch seconds, ISO text and junk, each made one instant."""
    e = load(spark, sf, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("raw"))
    iso = F.date_format(F.timestamp_millis("raw"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    case = F.col("event_id") % 4
    instant = (F.when(case == 0, epoch_to_ts("raw")).when(case == 1, epoch_to_ts(F.floor(F.col("raw") / 1000)))
               .when(case == 2, iso_to_ts(iso)).otherwise(F.coalesce(iso_to_ts(F.lit("not a time")), epoch_to_ts(F.lit(-5)))))
    return e.select("event_id", F.unix_millis(instant).alias("ms"))


@query("local_day", """WITH t AS (SELECT event_id, ts, (user_id % 27 - 13) * 60 + (event_id % 2) * 30 AS off FROM events)
SELECT event_id, CAST(ts + to_minutes(CAST(off AS INTEGER)) AS DATE) AS day,
  CAST(TIMESTAMP '2024-01-30 18:00:00' + to_minutes(CAST(off AS INTEGER)) AS DATE) AS today FROM t""")
def local_day_query(spark, sf):
    off = ((F.col("user_id") % 27 - 13) * 60 + (F.col("event_id") % 2) * 30).cast("int")
    e = load(spark, sf, "events").withColumn("off", off)
    return e.select("event_id", local_day(F.col("ts").cast("timestamp"), F.col("off")).alias("day"), submitter_today("off", now()).alias("today"))


@query("plausible_days", """WITH t AS (SELECT o_orderkey, CASE CAST(o_orderkey % 5 AS INTEGER) WHEN 0 THEN strftime(o_orderdate + INTERVAL 26 YEAR, '%Y-%m-%d')
  WHEN 1 THEN '2023-02-31' WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN '2024-1-05' ELSE strftime(o_orderdate + INTERVAL 24 YEAR, '%Y-%m-%d') END AS s FROM orders)
SELECT o_orderkey, TRY_CAST(s AS DATE) AS day FROM t WHERE length(s) = 10 AND TRY_CAST(s AS DATE) BETWEEN DATE '2020-01-01' AND DATE '2024-02-01'""")
def plausible_days(spark, sf):
    o = load(spark, sf, "orders")
    case = F.col("o_orderkey") % 5
    later = lambda years: F.date_format(F.add_months(F.to_date("o_orderdate"), 12 * years), "yyyy-MM-dd")
    s = (F.when(case == 0, later(26)).when(case == 1, F.lit("2023-02-31")).when(case == 2, later(0))
         .when(case == 3, F.lit("2024-1-05")).otherwise(later(24)))
    return o.select("o_orderkey", plausible_day(s, now()).alias("day")).filter("day IS NOT NULL")


@query("plausible_instants", f"""SELECT event_id FROM (SELECT event_id, ts + to_days(CAST(event_id % 9 AS INTEGER)) AS t FROM events)
WHERE t BETWEEN TIMESTAMP '2020-01-01' AND TIMESTAMP '{NOW}' + INTERVAL 2 DAY""")
def plausible_instants(spark, sf):
    e = load(spark, sf, "events")
    t = F.col("ts").cast("timestamp") + F.make_dt_interval((F.col("event_id") % 9).cast("int"))
    return e.select("event_id", t.alias("t")).filter(plausible_instant("t", now())).select("event_id")


@query("select_source", f"""WITH {DAILY_SQL},
n AS (SELECT handle, tool, date, model, tokens FROM daily WHERE (CAST(handle AS BIGINT) + length(tool)) % 2 = 0),
f AS (SELECT handle, tool, date, model, tokens + 1 AS tokens FROM daily),
u AS (SELECT * FROM n WHERE tool <> 'view')
SELECT * FROM u UNION ALL SELECT * FROM f WHERE (handle, tool) NOT IN (SELECT handle, tool FROM u)""")
def select_source_query(spark, sf):
    """Every tool has native rows for about half of the accounts and fallback rows for all; ``view`` stands for the replay-aware source."""
    d = daily(spark, sf).select("handle", "tool", "date", "model", total_tokens().alias("tokens"))
    native = d.filter("(cast(handle AS bigint) + length(tool)) % 2 = 0")
    fallback = d.withColumn("tokens", F.col("tokens") + 1)
    return select_source(native, fallback, replay_source="view")


@query("merge_tiers", f"""WITH {DAILY_SQL},
st AS (SELECT DISTINCT handle, tool FROM daily),
pick AS (SELECT handle, tool, CASE WHEN CAST(handle AS BIGINT) % 4 = 0 THEN 'fast' ELSE 'slow' END AS tier FROM st WHERE CAST(handle AS BIGINT) % 5 <> 4 OR CAST(handle AS BIGINT) % 4 = 0)
SELECT d.handle, d.tool, date, model, tokens FROM daily d JOIN pick USING (handle, tool) WHERE tier = 'fast'
UNION ALL SELECT d.handle, d.tool, date, model, tokens + 1 FROM daily d JOIN pick USING (handle, tool) WHERE tier = 'slow' AND d.tool <> 'view'""")
def merge_tiers_query(spark, sf):
    """Slow runs are newer but failed for some accounts, and came back empty (and successful) for ``view``."""
    d = daily(spark, sf).select("handle", "tool", "date", "model", total_tokens().alias("tokens"))
    slow = d.filter("tool <> 'view'").withColumn("tokens", F.col("tokens") + 1)
    account = F.col("handle").cast("long")
    pairs = d.select("handle", "tool").distinct()
    status = pairs.select("handle", "tool", F.lit("fast").alias("tier"), F.lit(1).alias("finished_at"), (account % 4 == 0).alias("succeeded")).union(
        pairs.select("handle", "tool", F.lit("slow"), F.when(account % 4 == 0, 0).otherwise(2), account % 5 != 4))
    return merge_tiers(d, slow, status)


@query("union_sources", f"""WITH {USAGE_SQL} SELECT tool, count(*) AS row_count, CAST(sum(t) AS BIGINT) AS tokens, CAST(sum(c) AS BIGINT) AS cost_micro FROM
 (SELECT tool, input_tokens AS t, NULL AS c FROM usage WHERE k % 2 = 0 UNION ALL SELECT tool, output_tokens, k FROM usage WHERE k % 2 = 1) GROUP BY tool""")
def union_sources_query(spark, sf):
    u = usage(spark, sf)
    a = u.filter("k % 2 = 0").select("tool", F.col("input_tokens").alias("t"))
    b = u.filter("k % 2 = 1").select("tool", F.col("output_tokens").alias("t"), F.col("k").alias("c"))
    return union_sources(a, b).groupBy("tool").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("t").alias("tokens"), F.sum("c").alias("cost_micro"))


@query("distinct_tools", "SELECT DISTINCT event_type AS tool FROM events UNION SELECT DISTINCT source FROM documents")
def distinct_tools_query(spark, sf):
    return distinct_tools(usage(spark, sf), load(spark, sf, "documents").select(F.col("source").alias("tool")))


@query("forced_origin", f"""WITH {DAILY_SQL} SELECT handle, date, tool, model, 'cli' AS origin, false AS verified FROM daily""")
def forced_origin(spark, sf):
    d = daily(spark, sf).withColumn("origin", F.lit("import")).withColumn("verified", F.lit(True))
    return label_daily(d).select("handle", "date", "tool", "model", "origin", "verified")
