"""Queries for state between runs and for plausibility checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import TOKEN_COLUMNS, total_tokens
from ..operators.integrity import moderation_rollup, request_checks, request_density, rollup_ratio
from ..operators.reconcile import (apply_correction, changed_scopes, correction_proof, merge_rollup, reconcile_agent,
                                   reconcile_requests, restate_days, tombstones, upsert_daily)
from ..operators.reports import latest_snapshots
from ..session import materialize
from ..sources.manifest import changed_files, deleted_files, newest_files, refresh_rows
from ..sources.paged import complete_batches
from ..sources.prices import active_price_dim
from .adapter import DAILY_SQL, NOW, SUMS_SQL, TODAY, TOTAL_SQL, USAGE_SQL, daily, load, now, price_dim, query, usage
from .usage_queries import PRICED_SQL, SESSIONS_SQL, sessions

_KEYS = ["handle", "date", "tool", "model"]


def _account():
    return F.col("handle").cast("long")


@query("upsert_daily", f"""WITH {DAILY_SQL}, inc AS (SELECT handle, date, tool, model, tokens + 7 AS tokens FROM daily WHERE tokens % 3 = 0 OR date = DATE '{TODAY}'),
cur AS (SELECT handle, date, tool, model, tokens FROM daily WHERE date < DATE '{TODAY}')
SELECT * FROM inc UNION ALL SELECT * FROM cur WHERE (handle, date, tool, model) NOT IN (SELECT handle, date, tool, model FROM inc)""")
def upsert_daily_query(spark, sf):
    d = daily(spark, sf).select(*_KEYS, total_tokens().alias("tokens"))
    day = F.lit(TODAY).cast("date")
    incoming = d.filter((F.col("tokens") % 3 == 0) | (F.col("date") == day)).withColumn("tokens", F.col("tokens") + 7)
    return upsert_daily(d.filter(F.col("date") < day), incoming, _KEYS)


@query("no_shrink_rollup", f"""WITH {USAGE_SQL}, c AS (SELECT handle, tool AS name, count(*) AS calls, CAST(sum(output_tokens) AS BIGINT) AS tokens FROM usage WHERE date < DATE '2024-01-20' GROUP BY ALL),
i AS (SELECT handle, tool AS name, count(*) AS calls, CAST(sum(output_tokens) AS BIGINT) AS tokens FROM usage WHERE date >= DATE '2024-01-20' GROUP BY ALL)
SELECT handle, name, CASE WHEN i.calls IS NULL THEN c.calls WHEN CAST(handle AS BIGINT) % 2 = 0 THEN i.calls ELSE greatest(c.calls, i.calls) END AS calls,
  CASE WHEN i.tokens IS NULL THEN c.tokens WHEN CAST(handle AS BIGINT) % 2 = 0 THEN i.tokens ELSE greatest(c.tokens, i.tokens) END AS tokens
FROM c FULL JOIN i USING (handle, name)""")
def no_shrink_rollup(spark, sf):
    """Even accounts send full snapshots, odd ones partial ones."""
    u = usage(spark, sf)

    def stats(rows):
        return rows.groupBy("handle", F.col("tool").alias("name")).agg(
            F.count(F.lit(1)).alias("calls"), F.sum("output_tokens").alias("tokens"))

    cut = F.lit("2024-01-20").cast("date")
    return merge_rollup(stats(u.filter(F.col("date") < cut)), stats(u.filter(F.col("date") >= cut)),
                        ["handle", "name"], ["calls", "tokens"], _account() % 2 == 0)


def _runs(d: DataFrame) -> DataFrame:
    return d.select("handle").distinct().withColumn("complete", _account() % 3 == 0)


_RECONCILE_SQL = f"""WITH {DAILY_SQL}, prov AS (SELECT handle, date, tool, CAST(sum(request_count) + hash_n AS BIGINT) AS best FROM
  (SELECT *, length(tool) + length(handle) - 6 AS hash_n FROM daily) GROUP BY handle, date, tool, hash_n),
cur AS (SELECT handle, date, tool, model, tokens, CASE WHEN model = 'unknown-x' THEN NULL ELSE request_count END AS rc FROM daily),
f AS (SELECT handle, date, tool, sum(rc) AS c FROM cur GROUP BY ALL),
h AS (SELECT handle, date, tool, model FROM cur QUALIFY row_number() OVER (PARTITION BY handle, date, tool ORDER BY tokens DESC, model) = 1),
def AS (SELECT handle, date, tool, h.model, best - coalesce(c, 0) AS d FROM f JOIN prov USING (handle, date, tool) JOIN h USING (handle, date, tool)
  WHERE CAST(handle AS BIGINT) % 3 <> 0 AND best > coalesce(c, 0))"""


def _reconciled(spark, sf):
    d = daily(spark, sf)
    best = d.groupBy("handle", "date", "tool").agg(
        (F.sum("request_count") + F.max(F.length("tool") + F.length("handle") - 6)).alias("best"))
    current = d.withColumn("request_count", F.when(F.col("model") != "unknown-x", F.col("request_count")))
    return reconcile_requests(current, best, _runs(d))


@query("reconcile_partial", f"""{_RECONCILE_SQL} SELECT handle, date, tool, model,
  CAST(CASE WHEN d IS NOT NULL THEN coalesce(rc, 0) + d ELSE rc END AS BIGINT) AS request_count FROM cur LEFT JOIN def USING (handle, date, tool, model)""")
def reconcile_partial(spark, sf):
    return _reconciled(spark, sf)[0].select(*_KEYS, "request_count")


@query("reconcile_provenance", f"""{_RECONCILE_SQL} SELECT handle, date, tool, CAST(CASE WHEN c IS NULL THEN best WHEN CAST(handle AS BIGINT) % 3 = 0 THEN c
  ELSE greatest(best, c) END AS BIGINT) AS best FROM prov LEFT JOIN f USING (handle, date, tool)""")
def reconcile_provenance(spark, sf):
    return _reconciled(spark, sf)[1]


@query("reconcile_agent", f"""WITH {USAGE_SQL}, c AS (SELECT handle, count(*) AS messages, CAST(sum(input_tokens) AS BIGINT) AS total_tokens FROM usage WHERE date >= DATE '2024-01-16' GROUP BY handle),
s AS (SELECT handle, count(*) AS messages, CAST(sum(input_tokens) AS BIGINT) AS total_tokens FROM usage WHERE date < DATE '2024-01-16' GROUP BY handle)
SELECT handle, CASE WHEN k THEN s.messages ELSE c.messages END AS messages, CASE WHEN k THEN s.total_tokens ELSE c.total_tokens END AS total_tokens
FROM (SELECT c.*, coalesce(CAST(handle AS BIGINT) % 3 <> 0 AND s.total_tokens > c.total_tokens, false) AS k FROM c LEFT JOIN s USING (handle)) c LEFT JOIN s USING (handle)""")
def reconcile_agent_query(spark, sf):
    u = usage(spark, sf)
    cut = F.lit("2024-01-16").cast("date")

    def agent(rows):
        return rows.groupBy("handle").agg(F.count(F.lit(1)).alias("messages"), F.sum("input_tokens").alias("total_tokens"))

    return reconcile_agent(agent(u.filter(F.col("date") >= cut)), agent(u.filter(F.col("date") < cut)), _runs(u), ["messages", "total_tokens"])


# legacy rows: everything; corrected rows: some days missing, some counters lower
_SCOPES_SQL = f"""WITH {DAILY_SQL}, legacy AS (SELECT handle, date, model, {SUMS_SQL} FROM daily GROUP BY ALL),
corrected AS (SELECT handle, date, model, CASE WHEN day(date) % 4 = 0 AND model = 'gpt-5' THEN input_tokens - 1 ELSE input_tokens END AS input_tokens,
  output_tokens, cache_creation_tokens, cache_read_tokens FROM legacy WHERE day(date) % 5 <> 0),
cand AS (SELECT DISTINCT handle, date FROM usage WHERE k < 30),
ok AS (SELECT DISTINCT handle FROM usage WHERE CAST(handle AS BIGINT) % 4 <> 1),
tomb AS (SELECT * FROM cand WHERE handle IN (SELECT handle FROM ok) AND (handle, date) NOT IN (SELECT handle, date FROM corrected)),
diff AS (SELECT handle, date FROM (SELECT handle, date, l.model IS NOT NULL AS kn,
    (l.input_tokens, l.output_tokens, l.cache_creation_tokens, l.cache_read_tokens) IS DISTINCT FROM (c.input_tokens, c.output_tokens, c.cache_creation_tokens, c.cache_read_tokens) AS df
  FROM legacy l FULL JOIN corrected c USING (handle, date, model)) GROUP BY handle, date HAVING bool_or(kn) AND bool_or(df)),
changed AS (SELECT * FROM tomb UNION SELECT * FROM diff)"""


def _scopes(spark, sf):
    legacy = materialize(daily(spark, sf).groupBy("handle", "date", "model").agg(*[F.sum(c).alias(c) for c in TOKEN_COLUMNS]), "legacy")
    lower = (F.day("date") % 4 == 0) & (F.col("model") == "gpt-5")
    corrected = legacy.filter(F.day("date") % 5 != 0).withColumn(
        "input_tokens", F.when(lower, F.col("input_tokens") - 1).otherwise(F.col("input_tokens")))
    u = usage(spark, sf)
    candidates = u.filter("k < 30").select("handle", "date").distinct()
    status = u.select("handle").distinct().select("handle", F.lit(True).alias("native_ok"), (_account() % 4 != 1).alias("replay_ok"))
    return legacy, corrected, tombstones(candidates, corrected, status)


@query("tombstones", f"{_SCOPES_SQL} SELECT handle, date FROM tomb")
def tombstones_query(spark, sf):
    return _scopes(spark, sf)[2]


@query("changed_scopes", f"{_SCOPES_SQL} SELECT handle, date FROM changed")
def changed_scopes_query(spark, sf):
    return changed_scopes(*_scopes(spark, sf))


@query("correction_proof", f"""{_SCOPES_SQL}, whole AS (SELECT DISTINCT handle FROM usage WHERE CAST(handle AS BIGINT) % 7 <> 2)
SELECT handle, date, count(*) AS models, CAST(sum{TOTAL_SQL} AS BIGINT) AS tokens FROM legacy JOIN changed USING (handle, date) WHERE handle IN (SELECT handle FROM whole) GROUP BY ALL""")
def correction_proof_query(spark, sf):
    legacy, corrected, dead = _scopes(spark, sf)
    whole = usage(spark, sf).select("handle").distinct().filter(_account() % 7 != 2)
    scopes, _ = correction_proof(legacy, changed_scopes(legacy, corrected, dead), dead, whole)
    tokens = F.aggregate("rows", F.lit(0).cast("long"), lambda a, r: a + r[TOKEN_COLUMNS[0]] + r[TOKEN_COLUMNS[1]] + r[TOKEN_COLUMNS[2]] + r[TOKEN_COLUMNS[3]])
    return scopes.select("handle", "date", F.size("rows").cast("long").alias("models"), tokens.alias("tokens"))


@query("proved_tombstones", f"""{_SCOPES_SQL} SELECT handle, date FROM tomb WHERE (handle, date) IN (SELECT handle, date FROM legacy)""")
def proved_tombstones(spark, sf):
    legacy, corrected, dead = _scopes(spark, sf)
    return correction_proof(legacy, changed_scopes(legacy, corrected, dead), dead)[1]


@query("apply_correction", f"""{_SCOPES_SQL}, prior AS (SELECT handle, date, model, CASE WHEN day(date) = 8 THEN input_tokens + 1 ELSE input_tokens END AS input_tokens, output_tokens, cache_creation_tokens, cache_read_tokens
  FROM legacy WHERE (handle, date) IN (SELECT handle, date FROM changed)),
acc AS (SELECT DISTINCT handle, date FROM prior WHERE day(date) <> 8 AND CAST(handle AS BIGINT) % 2 = 0)
SELECT handle, date, model, input_tokens FROM legacy WHERE (handle, date) NOT IN (SELECT handle, date FROM acc)
UNION ALL SELECT handle, date, model, input_tokens FROM corrected WHERE (handle, date) IN (SELECT handle, date FROM acc)""")
def apply_correction_query(spark, sf):
    """Stored rows are the legacy ones. Proofs of the eighth are out of date; odd accounts have a second device."""
    legacy, corrected, dead = _scopes(spark, sf)
    prior = materialize(legacy.join(changed_scopes(legacy, corrected, dead), ["handle", "date"], "left_semi").withColumn(
        "input_tokens", F.when(F.day("date") == 8, F.col("input_tokens") + 1).otherwise(F.col("input_tokens"))), "prior")
    u = usage(spark, sf).select("handle").distinct()
    devices = u.select("handle", F.explode(F.when(_account() % 2 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))).alias("device_id"),
                       F.lit(True).alias("confirmed"))
    return apply_correction(legacy, prior, corrected, devices).select("handle", "date", "model", "input_tokens")


@query("correct_mixed_tools", f"""WITH {DAILY_SQL}, st AS (SELECT handle, date, tool, model, input_tokens,
  tool = 'click' AND NOT (model = 'gpt-5' AND day(date) % 6 = 0) AND day(date) % 7 <> 0 AS own FROM daily)
SELECT handle, date, tool, model, input_tokens FROM st WHERE NOT own OR day(date) = 8 OR CAST(handle AS BIGINT) % 2 <> 0
UNION ALL SELECT handle, date, tool, model, input_tokens - 1 FROM st
WHERE own AND day(date) <> 8 AND CAST(handle AS BIGINT) % 2 = 0 AND day(date) % 5 <> 0""")
def correct_mixed_tools(spark, sf):
    """One tool's rows are corrected among those of others, of another origin and verified ones; proofs of the eighth are out of date."""
    stored = daily(spark, sf).select(*_KEYS, *TOKEN_COLUMNS).withColumns({
        "origin": F.when((F.col("model") == "gpt-5") & (F.day("date") % 6 == 0), "web").otherwise("cli"), "verified": F.day("date") % 7 == 0})
    one_less = lambda n: stored.withColumn("input_tokens", F.col("input_tokens") + n)
    prior = one_less(F.when(F.day("date") == 8, 1).otherwise(0))
    corrected = one_less(F.lit(-1)).filter(F.day("date") % 5 != 0)
    devices = usage(spark, sf).select("handle").distinct().select(
        "handle", F.explode(F.when(_account() % 2 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))).alias("device_id"),
        F.lit(True).alias("confirmed"))
    return apply_correction(stored, prior, corrected, devices, "click").select(*_KEYS, "input_tokens")


@query("restate_days", f"""WITH {DAILY_SQL}, t AS (SELECT handle, date, tool, model, tokens FROM daily WHERE date < DATE '2024-01-28'),
b AS (SELECT handle, date, tool, model, tokens + CASE WHEN tokens % 2 = 0 THEN -5 ELSE 5 END AS tokens FROM daily WHERE date >= DATE '2024-01-15')
SELECT handle, date, tool, model, CASE WHEN b.tokens IS NULL OR (t.tokens IS NOT NULL AND CAST(handle AS BIGINT) % 3 <> 0 AND t.tokens > b.tokens) THEN t.tokens ELSE b.tokens END AS tokens
FROM t FULL JOIN b USING (handle, date, tool, model)""")
def restate_days_query(spark, sf):
    d = daily(spark, sf).select(*_KEYS, *TOKEN_COLUMNS)
    shift = F.when(total_tokens() % 2 == 0, -5).otherwise(5)
    batch = d.filter(F.col("date") >= F.lit("2024-01-15").cast("date")).withColumn("cache_read_tokens", F.col("cache_read_tokens") + shift)
    table = d.filter(F.col("date") < F.lit("2024-01-28").cast("date"))
    return restate_days(table, batch, _runs(d), _KEYS).select(*_KEYS, total_tokens().alias("tokens"))


def _listing(spark, sf, grown=False):
    """One log file per account and day, sized by its events."""
    u = usage(spark, sf)
    size = F.count(F.lit(1)) * 1000
    if grown:
        u = u.filter(_account() % 10 != 3)
    else:
        u = u.filter(F.col("date") < F.lit("2024-01-25").cast("date"))
        size = F.when(F.first(_account()) % 5 == 0, size - 1).otherwise(size)
    return u.groupBy("handle", "date").agg(size.alias("size"), F.max("ts").alias("modified")).select(
        F.concat_ws("/", "handle", F.col("date").cast("string")).alias("file"), "size", "modified")


_FILES_SQL = f"""WITH {USAGE_SQL}, l AS (SELECT handle || '/' || date AS file, count(*) * 1000 AS size, max(ts) AS modified FROM usage WHERE CAST(handle AS BIGINT) % 10 <> 3 GROUP BY handle, date),
m AS (SELECT handle || '/' || date AS file, count(*) * 1000 - CASE WHEN CAST(handle AS BIGINT) % 5 = 0 THEN 1 ELSE 0 END AS size, max(ts) AS modified FROM usage WHERE date < DATE '2024-01-25' GROUP BY handle, date)"""


@query("changed_files", f"""{_FILES_SQL} SELECT file FROM l WHERE (file, size, modified) NOT IN (SELECT file, size, modified FROM m)""")
def changed_files_query(spark, sf):
    manifest = _listing(spark, sf).withColumn("parser_version", F.lit(2))
    return changed_files(_listing(spark, sf, grown=True), manifest, 2).select("file")


@query("newest_files", f"""{_FILES_SQL}, old AS (SELECT file, size, modified FROM l WHERE modified > TIMESTAMP '2024-01-20 12:00:00'),
n AS (SELECT file, size, modified FROM old ORDER BY modified DESC, file LIMIT 20)
SELECT file, CAST(size AS BIGINT) AS size, file IN (SELECT file FROM n) AS among_newest FROM old""")
def newest_files_query(spark, sf):
    """Files of the last days, and whether each is among the newest twenty."""
    recent = newest_files(_listing(spark, sf, grown=True), modified_after="2024-01-20 12:00:00")
    top = newest_files(recent, 20).select("file", F.lit(True).alias("among"))
    return recent.join(top, "file", "left").select("file", "size", F.coalesce("among", F.lit(False)).alias("among_newest"))


@query("deleted_files", f"""{_FILES_SQL} SELECT file FROM m WHERE file NOT IN (SELECT file FROM l)""")
def deleted_files_query(spark, sf):
    manifest = _listing(spark, sf).withColumn("parser_version", F.lit(2))
    return deleted_files(_listing(spark, sf, grown=True), manifest)


@query("refreshed_rows", f"""{_FILES_SQL}, ch AS (SELECT file FROM l WHERE (file, size, modified) NOT IN (SELECT file, size, modified FROM m)),
del AS (SELECT file FROM m WHERE file NOT IN (SELECT file FROM l))
SELECT file, 'old' AS parsed FROM m WHERE file NOT IN (SELECT file FROM ch UNION SELECT file FROM del) UNION ALL SELECT file, 'new' FROM ch""")
def refreshed_rows(spark, sf):
    manifest = _listing(spark, sf).withColumn("parser_version", F.lit(2))
    listing = _listing(spark, sf, grown=True)
    changed, deleted = changed_files(listing, manifest, 2), deleted_files(listing, manifest)
    stored = manifest.select("file", F.lit("old").alias("parsed"))
    return refresh_rows(stored, changed.select("file", F.lit("new").alias("parsed")), changed, deleted)


@query("complete_batches", f"""WITH p AS (SELECT user_id % 10 AS batch_id, CAST(day(ts) AS BIGINT) AS page, count(*) AS n_events, bool_and(user_id % 20 <> 3 OR event_id % 4 <> 0) AS ok FROM events
  WHERE NOT (user_id % 10 = 4 AND day(ts) = 12) AND NOT (user_id % 10 = 5 AND day(ts) > 20) GROUP BY ALL),
g AS (SELECT batch_id FROM p GROUP BY batch_id HAVING bool_and(ok) AND max(page) = count(*) AND max(page) = 30)
SELECT batch_id, page, n_events FROM p WHERE batch_id IN (SELECT batch_id FROM g)""")
def complete_batches_query(spark, sf):
    """Days as pages of ten batches: one has failed pages, one a gap, one stops on a full page too early."""
    day, batch = F.day("ts"), F.col("user_id") % 10
    e = load(spark, sf, "events").filter(~((batch == 4) & (day == 12)) & ~((batch == 5) & (day > 20)))
    pages = e.groupBy(batch.alias("batch_id"), day.alias("page")).agg(
        F.count(F.lit(1)).alias("n_events"), F.bool_and((F.col("user_id") % 20 != 3) | (F.col("event_id") % 4 != 0)).alias("ok"))
    return complete_batches(pages, page_size=1, max_pages=30).select("batch_id", F.col("page").cast("long").alias("page"), "n_events")


@query("request_density", f"""WITH {DAILY_SQL}, d AS (SELECT handle, date, tool, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(CASE WHEN model = 'gpt-5' THEN NULL ELSE request_count END) AS BIGINT) AS requests FROM daily GROUP BY ALL)
SELECT *, coalesce(requests IS NOT NULL AND tokens >= 5000 AND tokens > requests * 9000, false) AS flagged FROM d""")
def request_density_query(spark, sf):
    d = daily(spark, sf).withColumn("request_count", F.when(F.col("model") != "gpt-5", F.col("request_count")))
    return request_density(d, 5000, 9000)


@query("rollup_ratio", f"""WITH {DAILY_SQL}, s AS (SELECT handle, CAST(sum(tokens) AS BIGINT) AS session_tokens FROM daily WHERE tool <> 'view' AND CAST(handle AS BIGINT) % 9 <> 0 GROUP BY handle)
SELECT handle, CAST(sum(tokens) AS BIGINT) AS daily_tokens, any_value(session_tokens) AS session_tokens, coalesce(sum(tokens) > 1.25 * any_value(session_tokens), false) AS flagged
FROM daily LEFT JOIN s USING (handle) GROUP BY handle""")
def rollup_ratio_query(spark, sf):
    s = sessions(spark, sf).filter((F.col("tool") != "view") & (_account() % 9 != 0))
    return rollup_ratio(daily(spark, sf), s, 1.25).drop("ratio")


@query("request_checks", f"""WITH {USAGE_SQL}, r AS (SELECT handle, date, {TOTAL_SQL} AS t, epoch_us(ts) // 1000 AS ms, lag(epoch_us(ts) // 1000) OVER (PARTITION BY handle ORDER BY ts, event_id) AS p FROM usage),
g AS (SELECT handle, sum(CASE WHEN t > 12000 THEN 1 ELSE 0 END) AS token_fields, sum(CASE WHEN ms > p AND t / ((ms - p) / 1000.0) > 20 THEN 1 ELSE 0 END) AS throughput,
  sum(CASE WHEN ms = p THEN 1 ELSE 0 END) AS timing FROM r GROUP BY handle),
d AS (SELECT handle, sum(CASE WHEN n > 4 THEN 1 ELSE 0 END) AS density FROM (SELECT handle, date, count(*) AS n FROM usage GROUP BY ALL) GROUP BY handle),
u AS (UNPIVOT (SELECT * FROM g JOIN d USING (handle)) ON token_fields, throughput, timing, density INTO NAME check_name VALUE bad)
SELECT handle, check_name, CAST(bad AS BIGINT) AS bad, bad <= CASE WHEN check_name = 'timing' THEN 2 ELSE 0 END AS ok FROM u""")
def request_checks_query(spark, sf):
    r = usage(spark, sf).withColumn("key", F.col("event_id"))
    limits = {"tokens_per_second": 20.0, "requests_per_day": 4, "same_instant": 2, "total_tokens": 12_000}
    return request_checks(r, limits).withColumnRenamed("check", "check_name")


_PHRASES = ("daily total is 45x its own cross-tool session rollup", "carries no provenance for this day", "sustained near-ceiling days",
            "anomalous spike over prior peak", "below any real model", "suspiciously round totals", "retroactively inflated day", "Manual review", "nothing known")


@query("moderation_reasons", f"""WITH r AS (SELECT ([{', '.join(repr(p) for p in _PHRASES)}])[CAST(doc_id % {len(_PHRASES)} AS INTEGER) + 1] || ' ' || source AS reason,
  CASE WHEN toxic = 1 THEN 'suppressed' WHEN quality = 0 THEN 'flagged' ELSE 'review' END AS state, doc_id FROM labels JOIN documents USING (doc_id))
SELECT ['rollup_mismatch','no_provenance','near_ceiling','volume_spike','cost_floor','round_number','history_rewrite','manual','other'][CAST(doc_id % {len(_PHRASES)} AS INTEGER) + 1] AS category,
  state, count(*) AS cases FROM r GROUP BY ALL""")
def moderation_reasons(spark, sf):
    from .adapter import pick

    rows = load(spark, sf, "labels").join(load(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    reason = F.concat_ws(" ", pick(_PHRASES, F.col("doc_id") % len(_PHRASES)), "source")
    state = F.when(F.col("toxic") == 1, "suppressed").when(F.col("quality") == 0, "flagged").otherwise("review")
    return moderation_rollup(rows.select(reason.alias("reason"), state.alias("state")))


@query("latest_snapshots", f"""WITH {USAGE_SQL} SELECT handle, event_id FROM usage QUALIFY rank() OVER (PARTITION BY handle ORDER BY date DESC) = 1""")
def latest_snapshots_query(spark, sf):
    return latest_snapshots(usage(spark, sf).withColumnRenamed("date", "snapshot_at")).select("handle", "event_id")


@query("active_prices", f"""WITH {USAGE_SQL}, v AS (SELECT max(ts) AS f FROM usage WHERE ts <= TIMESTAMP '2024-01-28 12:00:00'),
l AS (SELECT DISTINCT model AS key FROM usage, v WHERE ts = f)
SELECT coalesce(l.key, b.key) AS key, CASE WHEN l.key IS NULL THEN 'baked' WHEN epoch_us(TIMESTAMP '2024-01-28 12:00:00') - epoch_us((SELECT f FROM v)) < 86400000000 THEN 'fresh' ELSE 'stale' END AS price_source
FROM l FULL JOIN (VALUES ('claude-opus-4-8'), ('claude-sonnet-4-5'), ('gpt-5'), ('gemini-2.5-pro')) b(key) ON l.key = b.key""")
def active_prices(spark, sf):
    """Each event instant as a price version naming the model it used."""
    rate = F.lit("1").cast("decimal(12,6)")
    versions = usage(spark, sf).select(F.col("ts").alias("fetched_at"), F.col("model").alias("key"), rate.alias("price_in"),
                                       rate.alias("price_out"), rate.alias("price_cache_write"), rate.alias("price_cache_read")).distinct()
    return active_price_dim(versions, price_dim(spark), F.to_timestamp(F.lit("2024-01-28 12:00:00"))).select("key", "price_source")
