"""Log readers on small files."""

import json
import os
from datetime import datetime, timezone

from pyspark.sql import functions as F

from conftest import NOW, rows
from meterlake.operators.attribution import agent_rollup, rollout_agent, rollout_tool_stats, session_messages, skill_stats, tool_stats
from meterlake.operators.cumulative import orphan_forks, rollout_days
from meterlake.operators.dedupe import dedupe_requests
from meterlake.operators.pricing import resolve_prices
from meterlake.operators.usage import daily_usage, generation_daily, hour_blocks, page_daily, rollout_daily, task_daily
from meterlake.plans.adapter import price_dim
from meterlake.sources.devdata import read_generations
from meterlake.sources.limit_samples import parse_usage_limits
from meterlake.sources.lines import read_lines
from meterlake.sources.manifest import changed_files, deleted_files, list_files, next_manifest
from meterlake.sources.paged import complete_batches, open_pages, parse_plan_usage, read_page_events, read_pages
from meterlake.sources.prices import active_price_dim, build_price_dim
from meterlake.sources.reports import parse_block_report, parse_daily_report, parse_model_report, parse_session_report, read_reports
from meterlake.sources.rollouts import prefer_live, read_rollout, read_rollout_limits, rollout_meta
from meterlake.sources.tasks import read_tasks
from meterlake.sources.transcripts import read_attribution, read_requests, session_labels


def write(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")


def message(id_, req, model="claude-opus-4-8", ts="2026-06-10T10:00:00.000Z", role="assistant", side=False, **usage):
    m = {"role": role, "model": model, "usage": usage}
    if id_:
        m["id"] = id_
    line = {"type": "assistant", "timestamp": ts, "isSidechain": side, "message": m}
    if req:
        line["requestId"] = req
    return line


def transcript_totals(spark, path):
    kept = dedupe_requests(read_requests(spark, str(path), NOW))
    daily = daily_usage(kept, resolve_prices(kept, price_dim(spark)))
    return daily, rows(daily, "date", "model", F.expr("input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens"), "request_count")


def test_largest_copy_of_a_request_wins(spark, tmp_path):
    write(tmp_path / "p" / "a.jsonl", [
        message("m1", "r1", input_tokens=5, output_tokens=1),
        message("m1", "r1", input_tokens=100, output_tokens=1093, cache_read_input_tokens=500),
    ])
    _, got = transcript_totals(spark, tmp_path)
    assert [(r[2], r[3]) for r in got] == [(1693, 1)]


def test_copies_meet_across_files_and_sidechains_count(spark, tmp_path):
    write(tmp_path / "p" / "a.jsonl", [message("m1", "r1", output_tokens=1000), message("m2", "r2", side=True, output_tokens=2000)])
    write(tmp_path / "p" / "b" / "c.jsonl", [message("m2", "r2", output_tokens=5)])
    _, got = transcript_totals(spark, tmp_path)
    assert [(r[2], r[3]) for r in got] == [(3000, 2)]


def test_lines_without_ids_never_merge_and_are_no_requests(spark, tmp_path):
    write(tmp_path / "a.jsonl", [message(None, None, output_tokens=21), message(None, None, output_tokens=21)])
    _, got = transcript_totals(spark, tmp_path)
    assert [(r[2], r[3]) for r in got] == [(42, 0)]


def test_unusable_transcript_lines_are_skipped(spark, tmp_path):
    write(tmp_path / "a.jsonl", [
        '{"broken "usage"', message("u", "u", role="user", output_tokens=9), message("old", "x", ts="1999-01-01T00:00:00Z", output_tokens=9),
        message("late", "x", ts="2026-08-23T00:00:00Z", output_tokens=9), {"type": "assistant", "message": {"usage": "text"}},
        message("neg", "x", output_tokens=-4, input_tokens="7"), message("ok", "x", model=7, output_tokens=2.5),
    ])
    _, got = transcript_totals(spark, tmp_path)
    assert [(r[1], r[2], r[3]) for r in got] == [("claude-opus-4-8", 7, 1), ("unknown", 3, 1)]


def test_a_day_starts_at_the_local_midnight(spark, tmp_path):
    write(tmp_path / "a.jsonl", [message("m", "r", ts="2026-06-10T22:30:00Z", output_tokens=1)])
    days = read_requests(spark, str(tmp_path), NOW, offset_minutes=120).select(F.col("date").cast("string"))
    assert rows(days) == [("2026-06-11",)]


def token_count(ts, cumulative, nested=True, last=None):
    fields = dict(zip(("input_tokens", "cached_input_tokens", "output_tokens"), cumulative))
    payload = {"type": "token_count"}
    if nested:
        payload["info"] = {"total_token_usage": fields}
        if last is not None:
            payload["info"]["last_token_usage"] = last
    else:
        payload.update(fields)
    return {"timestamp": ts, "type": "event_msg", "payload": payload}


def meta(id_, parent=None, ts="2026-08-09T10:00:00Z", model=None, **extra):
    payload = {"id": id_, **extra}
    if parent:
        payload["forked_from_id"] = parent
    if model:
        payload["model"] = model
    return {"timestamp": ts, "type": "session_meta", "payload": payload}


def rollout_rows(spark, path):
    days = rollout_days(read_rollout(spark, str(path), NOW))
    return rows(days, F.col("date").cast("string"), "model", "input_tokens", "output_tokens", "cache_read_tokens", "turns")


def test_cumulative_counters_become_day_deltas(spark, tmp_path):
    write(tmp_path / "r.jsonl", [
        meta("s", model="gpt-5"), token_count("2026-06-01T10:00:00Z", (100, 0, 50)), token_count("bad", (250, 0, 120)),
        token_count("2026-06-02T10:00:00Z", (400, 0, 200), nested=False), token_count("2026-06-03T10:00:00Z", (400, 0, 200)),
        {"timestamp": "2026-06-03T10:00:01Z", "type": "turn_context", "payload": {"model": "gpt-5-codex"}},
        token_count("2026-06-04T09:00:00Z", (1000, 600, 400)),
    ])
    assert rollout_rows(spark, tmp_path) == [
        ("2026-06-01", "gpt-5-codex", 250, 120, 0, 2), ("2026-06-02", "gpt-5-codex", 150, 80, 0, 1), ("2026-06-04", "gpt-5-codex", 0, 200, 600, 1)]


def test_cached_growth_is_capped_by_input_growth_and_a_reset_floors_at_zero(spark, tmp_path):
    write(tmp_path / "r.jsonl", [
        meta("s"), token_count("2026-06-01T10:00:00Z", (100, 80, 10)), token_count("2026-06-02T10:00:00Z", (120, 150, 20)),
        token_count("2026-06-03T10:00:00Z", (30, 10, 5)), token_count("2026-06-04T10:00:00Z", (50, 10, 9)),
    ])
    got = [(r[0], r[2], r[3], r[4]) for r in rollout_rows(spark, tmp_path)]
    assert got == [("2026-06-01", 20, 10, 80), ("2026-06-02", 0, 10, 20), ("2026-06-04", 20, 4, 0)]


def test_a_fork_adds_only_its_own_growth(spark, tmp_path):
    parent = [meta("P"), token_count("2026-08-09T10:00:01Z", (100, 80, 10)), token_count("2026-08-09T10:00:02Z", (200, 160, 20))]
    child = [meta("C", "P"), meta("P"), *parent[1:], token_count("2026-08-09T10:00:08Z", (300, 240, 30))]
    grandchild = [meta("G", "C"), *child[2:], token_count("2026-08-10T10:00:08Z", (310, 240, 30))]
    orphan = [meta("O", "missing"), token_count("2026-08-09T10:00:01Z", (900, 0, 9))]
    unnamed = [meta("U", source={"subagent": "review"}), token_count("2026-08-09T10:00:01Z", (900, 0, 9))]
    for name, lines in {"p": parent, "c": child, "g": grandchild, "o": orphan, "u": unnamed}.items():
        write(tmp_path / f"{name}.jsonl", lines)
    days = rollout_days(read_rollout(spark, str(tmp_path), NOW))
    total = F.sum(F.expr("input_tokens + output_tokens + cache_read_tokens"))
    assert rows(days.groupBy("session_id").agg(total)) == [("C", 110), ("G", 10), ("P", 220)]
    assert days.filter("session_id IN ('P', 'C')").agg(total).first()[0] == 330
    metas = rollout_meta(read_rollout(spark, str(tmp_path), NOW))
    assert rows(orphan_forks(metas), "session_id") == [("O",), ("U",)]


def test_rollout_days_fold_to_priced_buckets(spark, tmp_path):
    write(tmp_path / "a.jsonl", [meta("a", model="gpt-5"), token_count("2026-06-01T10:00:00Z", (1_000_000, 0, 0))])
    write(tmp_path / "b.jsonl", [meta("b", model="gpt-5"), token_count("2026-06-01T11:00:00Z", (1_000_000, 1_000_000, 1_000_000))])
    days = rollout_days(read_rollout(spark, str(tmp_path), NOW))
    got = rows(rollout_daily(days, resolve_prices(days, price_dim(spark))), "input_tokens", "cache_read_tokens", "output_tokens", "request_count", "cost_micro")
    assert got == [(1_000_000, 1_000_000, 1_000_000, 2, 1_250_000 + 125_000 + 10_000_000)]


def test_line_order_holds_when_a_file_is_split(spark, tmp_path):
    lines = [meta("s")] + [token_count("2026-06-01T10:00:00Z" if i < 2000 else "2026-06-02T10:00:00Z", (i + 1, 0, 0)) for i in range(4000)]
    write(tmp_path / "big.jsonl", lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        events = read_rollout(spark, str(tmp_path), NOW)
        assert events.rdd.getNumPartitions() > 3
        got = [(r[0], r[2], r[5]) for r in rollout_rows(spark, tmp_path)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [("2026-06-01", 2000, 2000), ("2026-06-02", 2000, 2000)]


def test_live_rollout_wins_over_its_archived_copy(spark):
    files = spark.createDataFrame([("/a/sessions/2026/x.jsonl", 0), ("/a/archived/x.jsonl", 1), ("/a/archived/y.jsonl", 1)], "file string, root_rank int")
    assert rows(prefer_live(files), "file") == [("/a/archived/y.jsonl",), ("/a/sessions/2026/x.jsonl",)]


def test_task_files(spark, tmp_path):
    root = tmp_path / "globalStorage"
    ts = 1_780_000_000_000  # 2026-05-28
    cline = [
        {"ts": ts, "say": "api_req_started", "text": json.dumps({"tokensIn": 100, "tokensOut": 50, "cacheWrites": 10, "cacheReads": 5, "cost": 0.25}), "modelInfo": {"modelId": "gpt-5"}},
        {"ts": ts, "say": "api_req_started", "text": {"tokensIn": 1_000_000, "model": "gpt-5"}},
        {"ts": ts, "say": "api_req_started", "text": json.dumps({"request": "started only"})},
        {"ts": ts, "say": "api_req_started", "text": "{broken"}, {"ts": ts, "say": "text", "text": "hi"}, {"ts": 5, "say": "api_req_started", "text": {"tokensIn": 9}},
    ]
    write(root / "saoudrizwan.claude-dev" / "tasks" / "1" / "ui_messages.json", [cline])
    write(root / "rooveterinaryinc.roo-cline" / "tasks" / "2" / "ui_messages.json", [[{"ts": ts, "say": "api_req_started", "text": json.dumps({"tokensOut": "7"})}]])
    write(root / "saoudrizwan.claude-dev" / "tasks" / "3" / "ui_messages.json", ["not json"])
    requests = read_tasks(spark, str(root), NOW)
    got = rows(task_daily(requests, resolve_prices(requests, price_dim(spark))), "tool", "model", "input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "cost_micro", "request_count")
    assert got == [("cline", "gpt-5", 1_000_100, 50, 10, 5, 250_000 + 1_250_000, 2), ("roo", "roo", 0, 7, 0, 0, 0, 1)]


def test_generation_ledgers(spark, tmp_path):
    write(tmp_path / "0.2.0" / "tokensGenerated.jsonl", [
        {"eventName": "tokensGenerated", "model": "gpt-5", "promptTokens": 100, "generatedTokens": 40, "timestamp": "2026-06-01T10:00:00Z"},
        {"model": "gpt-5", "prompt_tokens": 10, "generated_tokens": 4, "timestamp": 1_780_308_000},
        {"model": "gpt-5", "promptTokens": 1, "timestamp": None, "eventTimestamp": 1_780_308_000_000},
        {"eventName": "autocomplete", "model": "gpt-5", "promptTokens": 100, "timestamp": "2026-06-01T10:00:00Z"},
        {"model": "", "promptTokens": 100, "timestamp": "2026-06-01T10:00:00Z"}, {"model": "gpt-5", "timestamp": "2026-06-01T10:00:00Z"}, "{",
    ])
    write(tmp_path / "0.2.0" / "chat.jsonl", [{"model": "gpt-5", "promptTokens": 9, "timestamp": "2026-06-01T10:00:00Z"}])
    g = read_generations(spark, str(tmp_path), NOW)
    got = rows(generation_daily(g, resolve_prices(g, price_dim(spark))), F.col("date").cast("string"), "input_tokens", "output_tokens", "request_count", "cost_micro")
    assert got == [("2026-06-01", 111, 44, 3, 125 + 400 + 13 + 40 + 1)]


def page(path, n, events):
    write(path / f"page-{n}.json", [{"usageEventsDisplay": events}])


def test_paged_events_and_whole_batches(spark, tmp_path):
    ms = "1780308000000"
    use = {"inputTokens": 10, "outputTokens": 5, "totalCents": 400}
    page(tmp_path / "b1", 1, [{"timestamp": ms, "model": "gpt-5", "tokenUsage": {"inputTokens": 100, "outputTokens": 60, "cacheReadTokens": 5000, "totalCents": 100}},
                              {"timestamp": ms, "model": "gpt-5", "tokenUsage": use}, {"timestamp": ms, "model": "gpt-5"}, {"timestamp": "soon", "tokenUsage": use}])
    page(tmp_path / "b2", 2, [{"timestamp": ms, "model": "x", "tokenUsage": use}])  # page 1 never landed
    events = read_page_events(spark, str(tmp_path), NOW)
    assert rows(page_daily(events), "model", "input_tokens", "output_tokens", "cache_read_tokens", "cost_micro") == [("gpt-5", 110, 65, 5000, 5_000_000)]
    assert rows(hour_blocks(events), F.date_format("start_time", "HH:mm"), "total_tokens") == [("10:00", 5175)]
    assert rows(complete_batches(open_pages(read_pages(spark, str(tmp_path)))), "batch_id") == [("b1",)]


def test_plan_usage(spark):
    docs = [json.dumps({"gpt-4": {"numRequests": 320, "maxRequestUsage": 500}, "fast": {"numRequestsTotal": 10, "maxRequestUsage": 100}, "startOfMonth": "2026-08-01T00:00:00.000Z"}),
            json.dumps({"startOfMonth": "2026-08-01T00:00:00.000Z"}), json.dumps({"gpt-4": {"numRequests": 3, "maxRequestUsage": None}})]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, value string")
    got = rows(parse_plan_usage(df), "i", "used", "request_limit", "plan_percent", F.to_date("renews_at").cast("string"))
    assert got == [(0, 330, 600, 55.0, "2026-09-01"), (2, 3, None, None, None)]


def test_daily_report_shapes(spark, tmp_path):
    write(tmp_path / "codex.json", [{"daily": [
        {"date": "2026-06-01", "costUSD": 10, "models": {"a": {"inputTokens": 750}, "b": {"outputTokens": 250}}},
        {"period": "2026-06-02", "modelBreakdowns": [{"modelName": "m", "inputTokens": 3, "cost": 0.5}, {"inputTokens": 0, "cost": 0}]},
        {"date": "2026-06-03", "totalCost": 1.5, "inputTokens": "12", "modelsUsed": ["only"]}, {"date": "2026-06-04", "inputTokens": 1, "modelsUsed": ["x", "y"]},
        {"date": "2026-02-31", "inputTokens": 1}, {"date": "2026-06-05", "models": {"z": {"inputTokens": 0}}, "costUSD": 3},
    ]}])
    write(tmp_path / "broken.json", ["{"])
    got = rows(parse_daily_report(read_reports(spark, str(tmp_path)), NOW), "tool", F.col("date").cast("string"), "model", F.expr("input_tokens + output_tokens"), "cost_micro")
    assert got == [("codex", "2026-06-01", "a", 750, 7_500_000), ("codex", "2026-06-01", "b", 250, 2_500_000), ("codex", "2026-06-02", "m", 3, 500_000),
                   ("codex", "2026-06-03", "only", 12, 1_500_000), ("codex", "2026-06-04", "unknown", 1, 0)]


def test_session_block_and_model_reports(spark):
    doc = json.dumps({"session": [{"agent": "claude", "period": "p" * 200, "sessionId": "s", "modelsUsed": ["m1", "m2"], "inputTokens": 5, "totalCost": 2, "metadata": {"lastActivity": "2026-01-01"}},
                                  {"sessionId": "s2", "outputTokens": 1}, {"sessionId": "s3"}, {"outputTokens": 4}],
                      "blocks": [{"startTime": "t1", "totalTokens": 4, "costUSD": 1}, {"startTime": "t2", "isGap": True, "totalTokens": 4}, {"totalTokens": 4}, {"startTime": "t3", "totalTokens": 0}],
                      "entries": [{"model": "", "input": 1, "output": 2, "reasoning": 3, "cost": 0}, {"model": "z"}]})
    df = spark.createDataFrame([(doc,)], "value string")
    assert rows(parse_session_report(df, NOW), F.length("session_id"), "tool", "model", "cost_micro", "last_activity") == [
        (128, "claude", "m1", 2_000_000, "2026-01-01"), (2, "unknown", "unknown", 0, "2026-08-20T12:00:00.000Z")]
    assert rows(parse_block_report(df)) == [("t1", 4, 1_000_000)]
    assert rows(parse_model_report(df.withColumn("date", F.lit("2026-06-01"))), "model", "input_tokens", "output_tokens") == [("cursor", 1, 5)]


def test_price_list(spark):
    row = lambda mode, provider, i, o, **kw: {"mode": mode, "litellm_provider": provider, "input_cost_per_token": i, "output_cost_per_token": o, **kw}
    doc = json.dumps({
        "sample_spec": row("chat", "openai", 1, 1), "emb": row("embedding", "openai", 1e-6, 0), "free": row("chat", "openai", 0, 0),
        "bedrock/us.anthropic.claude-x": row("chat", "bedrock", 3e-6, 15e-6, cache_read_input_token_cost=3e-7, cache_creation_input_token_cost=4e-6),
        "claude-x": row("chat", "anthropic", 3e-6, 15e-6), "azure/gpt-9": row("chat", "azure", 9e-6, 9e-6), "gpt-9": row("responses", "openai", "1.25e-06", 1e-5),
    })
    got = rows(build_price_dim(spark.createDataFrame([(doc,)], "value string")), *[F.col(c).cast("string") for c in ("key", "price_in", "price_out", "price_cache_write", "price_cache_read")])
    assert got == [("claude-x", "3.000000", "15.000000", "4.000000", "0.300000"), ("gpt-9", "1.250000", "10.000000", "1.250000", "0.000000")]


def test_price_freshness(spark):
    baked = price_dim(spark)
    live = baked.filter("key = 'gpt-5'").withColumn("fetched_at", F.lit("2026-08-19 18:00:00").cast("timestamp"))
    source = lambda now: dict(rows(active_price_dim(live, baked, now), "key", "price_source"))
    assert source(NOW)["gpt-5"] == "fresh" and source(NOW)["claude-opus-4-8"] == "baked"
    assert source(datetime(2026, 8, 25))["gpt-5"] == "stale"
    assert set(source(datetime(2026, 8, 1)).values()) == {"baked"}


def limits(ts, primary=None, secondary=None, inside=False, **extra):
    rl = {"primary": primary, "secondary": secondary, "plan_type": "pro", **extra}
    payload = {"info": {"rate_limits": rl}} if inside else {"rate_limits": rl}
    return {"timestamp": ts, "type": "event_msg", "payload": payload}


def test_rate_limit_lines(spark, tmp_path):
    write(tmp_path / "r.jsonl", [
        limits("2026-08-01T10:00:00Z", {"used_percent": 42.5, "window_minutes": 300, "resets_in_seconds": 3600}, {"used_percent": 7, "window_minutes": 10080, "resets_at": 1_785_600_000}),
        limits("2026-08-01T11:00:00Z", {"used_percent": 9, "window_minutes": 10080, "resets_at": "2026-08-05T00:00:00Z"}, inside=True, credits={"has_credits": True, "unlimited": False, "balance": "3"}),
        limits("2026-08-01T12:00:00Z", {"used_percent": 1}), '{"rate_limits"', {"payload": {"rate_limits": None}},
    ])
    got = rows(read_rollout_limits(spark, str(tmp_path)), F.date_format("captured_at", "HH"), "session.used_percent", F.date_format("session.resets_at", "HH:mm"), "weekly.used_percent", "credits_balance", "has_credits")
    assert got == [("10", 42.5, "11:00", 7.0, None, None), ("11", None, None, 9.0, "3", True), ("12", 1.0, None, None, None, None)]


def test_usage_limit_document(spark):
    doc = json.dumps({"five_hour": {"utilization": 43, "resets_at": "2026-08-01T10:00:00Z"}, "seven_day": {"utilization": 44}, "extra": 1,
                      "limits": [{"kind": "weekly_scoped", "percent": 51, "scope": {"model": {"display_name": "big"}}}, {"kind": "session", "percent": 43}]})
    got = rows(parse_usage_limits(spark.createDataFrame([(doc,)], "value string")), "kind", "percent", "model_name")
    assert got == [("session", 43.0, None), ("session", 43.0, None), ("weekly", 44.0, None), ("weekly_scoped", 51.0, "big")]


def assistant(content, session="s1", side=False, skill=None, **usage):
    return {"type": "assistant", "sessionId": session, "isSidechain": side, "attributionSkill": skill, "message": {"role": "assistant", "content": content, "usage": usage}}


def user(content, **extra):
    return {"type": "user", "sessionId": "s1", "message": {"role": "user", "content": content}, **extra}


def test_attribution_records(spark, tmp_path):
    use = lambda name, id_=None: {"type": "tool_use", "name": name, "id": id_}
    result = lambda id_, bad: {"type": "tool_result", "tool_use_id": id_, "is_error": bad}
    write(tmp_path / "-home-me-proj" / "f1.jsonl", [
        user([result("t1", True)]), user("do it"), user("<system-reminder> x"), user([{"type": "text", "text": "  \n"}]), user("hidden", isMeta=True),
        assistant([use("Bash", "t1"), use("Read", "t2"), use("", "t9")], skill="commit", input_tokens=201),
        user([result("t1", True), result("t2", False)]), assistant([use("Bash", "t3")], side=True, output_tokens=50),
        assistant([use("Edit", "t1")]), user([result("t1", True)]), assistant("plain text", output_tokens=999), assistant([], session=""),
    ])
    write(tmp_path / "-home-me-proj" / "f2.jsonl", [user([result("t1", True)])])  # ids are matched inside one file
    records = read_attribution(spark, str(tmp_path))
    assert rows(tool_stats(records), "name", "calls", "errors", "tokens") == [("Bash", 2, 1, 150), ("Edit", 1, 1, 0), ("Read", 1, 0, 100)]
    assert rows(skill_stats(records)) == [("commit", 1, 201)]
    assert rows(agent_rollup(records)) == [(4, 1, 50, 251, 1)]
    assert rows(session_messages(records)) == [("s1", 3)]
    assert rows(session_labels(records.select("file").distinct())) == [("f1", "me/proj"), ("f2", "me/proj")]


def test_rollout_tool_calls_share_the_next_turn(spark, tmp_path):
    call = lambda name, kind="function_call": {"type": "response_item", "payload": {"type": kind, "name": name}}
    turn = lambda last: {"type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": last} if last is not None else None}}
    write(tmp_path / "r.jsonl", [
        call("apply"), turn(None), call("web", "custom_tool_call"), turn({"total_tokens": 201}), turn({"input_tokens": 5, "output_tokens": 5, "reasoning_output_tokens": 1}),
        call("apply"), turn({"total_tokens": 0}), call(None, "local_shell_call"), call(None),
    ])
    events = read_rollout(spark, str(tmp_path), NOW)
    assert rows(rollout_tool_stats(events)) == [("apply", 2, 100), ("local_shell", 1, 0), ("web", 1, 100)]
    assert rows(rollout_agent(events)) == [(2, 212)]


def test_incremental_scan(spark, tmp_path):
    for name in ("a", "b", "c"):
        write(tmp_path / f"{name}.jsonl", [name])
    first = list_files(spark, str(tmp_path))
    manifest = spark.createDataFrame(next_manifest(first, 3).collect(), next_manifest(first, 3).schema)
    write(tmp_path / "b.jsonl", ["b", "more"])
    (tmp_path / "c.jsonl").unlink()
    listing = list_files(spark, str(tmp_path))
    names = lambda df: [r[0].rsplit("/", 1)[1] for r in rows(df, "file")]
    assert names(changed_files(listing, manifest, 3)) == ["b.jsonl"]
    assert names(deleted_files(listing, manifest)) == ["c.jsonl"]
    assert names(changed_files(listing, manifest, 4)) == ["a.jsonl", "b.jsonl"]
    assert names(changed_files(listing, manifest, 4, max_bytes=3)) == ["a.jsonl"]


def test_older_files_stay_unopened(spark, tmp_path):
    for name, second in (("old", 0), ("edge", 3600), ("new", 7200)):
        write(tmp_path / f"{name}.jsonl", [name])
        os.utime(tmp_path / f"{name}.jsonl", (1_780_000_000 + second,) * 2)
    since = datetime.fromtimestamp(1_780_000_000 + 3000, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S")
    found = read_lines(spark, str(tmp_path), modified_after=since)
    assert sorted(r.value for r in found.collect()) == ["edge", "new"]
    assert read_lines(spark, str(tmp_path)).count() == 3
