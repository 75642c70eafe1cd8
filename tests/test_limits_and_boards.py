"""Limit series, boards and report shapes on small tables."""

from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from conftest import rows
from meterlake.operators.board import board_rows, context_rows, current_streak, daily_leader, leaderboard, longest_streak, rank_movement
from meterlake.operators.limits import forecast_alarm, forecast_hit, last_known_good, latest_limit, threshold_alerts, tightest_limit, window_meter
from meterlake.operators.ordered import time_chunk
from meterlake.operators.reports import day_series, hourly_24, insights_models, pace, stale_devices, suppress_small, summary, token_mix, trend
from meterlake.streaming.ingest import changed_only

T0 = datetime(2026, 8, 1, 9, 30)
TODAY = date(2026, 8, 20)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def percents(spark, *data):
    """(minutes, percent) samples of one account."""
    return spark.createDataFrame([("a", at(m), i, p) for i, (m, p) in enumerate(data)], "handle string, at timestamp, id long, percent double")


def test_forecast(spark):
    s = percents(spark, (0, 40.0), (30, 60.0), (60, 50.0), (90, 75.0), (200, 99.0), (210, 100.0), (215, 101.0), (216, None), (216, float("nan")))
    base = int((T0 - datetime(1970, 1, 1)).total_seconds() * 1000)
    got = {r[0]: None if r[1] is None else (r[1] - base) / 60000 for r in rows(forecast_hit(s), "id", "hit_ms")}
    # third: 40 at 0 to 50 at 60; fourth: from 60 at 30 to 75 at 90, one hour on the dot
    assert got == {0: None, 1: 90.0, 2: 360.0, 3: 190.0, 4: None, 5: 210.0, 6: 215.0}


def test_alerts_fire_once_per_climb_and_resets_hide_them(spark):
    s = percents(spark, (0, 70.0), (10, 81.0), (20, 96.0), (70, 97.0), (80, 10.0), (90, 99.0), (95, float("inf")), (100, 68.0), (110, 79.0), (120, 80.0), (130, 79.9))
    assert rows(threshold_alerts(s).orderBy("at"), "id", "kind", "level") == [
        (1, "threshold", 80), (10, "reset", None), (2, "threshold", 95), (4, "reset", None), (5, "threshold", 80), (5, "threshold", 95), (7, "reset", None), (9, "threshold", 80)]
    assert rows(threshold_alerts(s, levels=(50,)), "id", "kind") == [(4, "reset"), (5, "threshold"), (7, "reset")]
    assert rows(threshold_alerts(percents(spark, (0, 99.0)))) == []


def test_forecast_alarm_rearms_when_calm(spark):
    data = [(0, 60.0, 120), (10, 80.0, 30), (20, 85.0, 35), (30, 40.0, None), (40, 90.0, 45), (50, 95.0, 52), (60, 30.0, 61), (61, 99.0, 61)]
    s = spark.createDataFrame([("a", at(m), i, p, None if h is None else int((at(h) - datetime(1970, 1, 1)).total_seconds() * 1000)) for i, (m, p, h) in enumerate(data)],
                              "handle string, at timestamp, id long, percent double, hit_ms long")
    assert rows(forecast_alarm(s), "id") == [(1,), (4,), (6,)]


def meter(spark, *data):
    s = spark.createDataFrame([("a", at(m), i, t, None if r is None else at(r)) for i, (m, t, r) in enumerate(data)], "handle string, at timestamp, id long, day_tokens long, reset_at timestamp")
    return [r[1] for r in sorted(rows(window_meter(s), "id", "meter"))]


def test_window_meter(spark):
    assert meter(spark, (0, 1000, 300), (5, 1500, 300), (6, 1500, 300), (90, 4000, 300)) == [0, 500, 500, 3000]
    assert meter(spark, (0, 9_000_000, 900), (5, 9_500_000, 900), (400, 40_000, 900)) == [0, 500_000, 540_000]
    # a later reset starts over; small moves do not; an elapsed one with none newer does
    assert meter(spark, (0, 100, 60), (10, 200, 61), (20, 300, 360), (30, 450, None), (400, 500, None), (410, 520, 360)) == [0, 100, 100, 250, 50, 20]


def test_last_known_latest_and_tightest(spark):
    s = percents(spark, (0, None), (10, 5.0), (80, None), (200, 7.0), (700, None))
    assert [r[1] for r in sorted(rows(last_known_good(s), "id", "known_percent"))] == [None, 5.0, 5.0, 7.0, 7.0]
    caught = spark.createDataFrame([("a", at(5), "f1", 1.0), ("a", at(9), "f2", 2.0), ("a", None, "f3", 3.0), ("b", None, "f1", 4.0)], "handle string, captured_at timestamp, file string, percent double")
    assert rows(latest_limit(caught, tie=["file"]), "handle", "percent") == [("a", 2.0), ("b", 4.0)]
    w = spark.createDataFrame([("a", "x", 99.0, at(-5)), ("a", "y", 60.0, at(60)), ("a", "z", 60.0, None), ("b", "x", None, None)], "handle string, provider string, percent double, reset_at timestamp")
    assert rows(tightest_limit(w, T0)) == [("a", 60.0, "y")]


USAGE = "handle string, date date, tool string, model string, input_tokens long, output_tokens long, cache_creation_tokens long, cache_read_tokens long, cost_micro long"


def usage(spark, *data):
    return spark.createDataFrame([(h, TODAY - timedelta(days=ago), tool, model, n, 0, 0, 0, n * 10) for h, ago, tool, model, n in data], USAGE)


def test_summary_and_series(spark):
    d = usage(spark, ("a", 0, "t", "m", 150), ("a", 2, "t", "m", 1000), ("a", 13, "t", "m", 7), ("a", 14, "t", "m", 99))
    assert rows(summary(d, TODAY), "today_tokens", "week_tokens", "fortnight_tokens") == [(150, 1150, 1157)]
    series = day_series(d, 14, TODAY, ["handle"])
    assert series.count() == 14 and series.filter("tokens = 0").count() == 11
    assert day_series(d.filter("false"), 30, TODAY).filter("tokens = 0").count() == 30
    assert rows(token_mix(d.filter("false")), "kind", "share") == [(k, 0.0) for k in ("cache_creation_tokens", "cache_read_tokens", "input_tokens", "output_tokens")]


def board(spark, n):
    return spark.createDataFrame([(i, f"user{i:02d}", 100 - i) for i in range(1, n + 1)], "rank long, handle string, today_tokens long")


def test_context_rows(spark):
    ranks = lambda b, who, n: [r[0] for r in context_rows(b, who, n).collect()]
    assert ranks(board(spark, 15), "User12", 5) == [1, 2, 11, 12, 13]
    assert ranks(board(spark, 8), "nobody", 5) == [1, 2, 3, 4, 5]
    assert ranks(board(spark, 8), "user08", 4) == [1, 2, 7, 8]
    assert ranks(board(spark, 8), "user01", 4) == [1, 2, 3, 4] and ranks(board(spark, 3), "user02", 9) == [1, 2, 3] and ranks(board(spark, 3), "user02", 0) == []
    twice = board(spark, 4).union(spark.createDataFrame([(9, "USER01", 1)], "rank long, handle string, today_tokens long"))
    assert ranks(twice, "user04", 9) == [1, 2, 3, 4]
    tie = spark.createDataFrame([(3, "a", 7), (2, "b", 7), (1, "c", 0)], "rank long, handle string, today_tokens long")
    assert rows(daily_leader(tie), "handle") == [("b",)] and rows(daily_leader(tie.filter("today_tokens = 0"))) == []


def test_boards_and_streaks(spark):
    d = usage(spark, ("a", 0, "t", "m", 5), ("a", 1, "u", "m", 9), ("a", 3, "t", "n", 50), ("b", 0, "t", "m", 14), ("c", 8, "t", "m", 1), ("c", 9, "t", "m", 1), ("c", 10, "t", "m", 1), ("z", 0, "t", "m", 0))
    assert rows(leaderboard(d, "7d", "tokens", TODAY), "rank", "handle", "tokens") == [(1, "a", 64), (2, "b", 14)]
    assert rows(leaderboard(d, "today", "cost", TODAY, tool="t"), "rank", "handle") == [(1, "b"), (2, "a")]
    assert rows(leaderboard(d.filter("date >= '2026-08-19'"), "7d", "tokens", TODAY), "rank", "handle") == [(1, "a"), (1, "b")]
    assert rows(current_streak(d, TODAY)) == [("a", 2), ("b", 1)] and rows(longest_streak(d)) == [("a", 2), ("b", 1), ("c", 3)]
    got = {r.handle: r for r in board_rows(d, "7d", "tokens", TODAY).collect()}
    assert (got["a"].today_tokens, got["a"].streak_days, got["a"].top_tool, got["a"].top_model) == (5, 2, "t", "n")
    assert got["a"].spark7d == [0, 0, 0, 50, 0, 9, 5]
    now_ranks = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "handle string, rank long")
    snaps = spark.createDataFrame([(at(-120), "a", 2), (at(-120), "b", 1), (at(-30), "c", 9), (at(-600), "c", 1)], "bucket timestamp, handle string, rank long")
    assert rows(rank_movement(now_ranks, snaps, 1, F.lit(T0)), "handle", "direction", "places") == [("a", "up", 1), ("b", "down", 1), ("c", "new", 0)]


def test_insights_trend_and_pace(spark):
    d = usage(spark, ("a", 0, "t", "openrouter/gpt-5", 30), ("b", 0, "u", "gpt-5-2025-08-07", 50), ("a", 1, "t", "x", 20))
    assert [(r.norm_model, r.variants, r.tools, r.devs, r.share) for r in insights_models(d).orderBy("norm_model").collect()] == [
        ("gpt-5", ["gpt-5-2025-08-07", "openrouter/gpt-5"], ["u", "t"], 2, 0.8), ("x", ["x"], ["t"], 1, 0.2)]
    assert insights_models(d, approx=True).filter("norm_model = 'gpt-5'").first().devs == 2
    t = {r.date: (r.total_tokens, r.by_model) for r in trend(d, 1, TODAY).collect()}
    assert len(t) == 30 and t[TODAY] == (80, {"gpt-5": 80}) and t[TODAY - timedelta(days=1)] == (20, {})
    p = pace(d, datetime(2026, 8, 20, 6, 0)).filter("handle = 'a'").first()
    assert (p.today_tokens, p.projected_cost_micro, p.avg_daily_tokens) == (30, 1200, 20)
    blocks = spark.createDataFrame([(datetime(2026, 8, 20, 5), 7, 1)], "start_time timestamp, total_tokens long, cost_micro long")
    hours = rows(hourly_24(blocks, TODAY), "hour", "tokens")
    assert len(hours) == 24 and (5, 7) in hours
    orgs = spark.createDataFrame([("o", 2, 10, 10), ("p", 3, 10, 10)], "org string, members long, tokens long, cost_micro long")
    assert rows(suppress_small(orgs, 3), "org", "tokens", "aggregates_hidden") == [("o", 0, True), ("p", 10, False)]
    syncs = spark.createDataFrame([("d1", at(-10)), ("d1", at(-90)), ("d2", at(-31)), ("d3", None)], "device_id string, synced_at timestamp")
    assert rows(stale_devices(syncs, T0), "device_id", "stale") == [("d1", False), ("d2", True), ("d3", True)]


def test_changed_only(spark):
    s = spark.createDataFrame([("a", at(m), v) for m, v in ((0, 1), (50, 1), (130, 2), (140, 2), (300, 1))], "k string, generated_at timestamp, v int")
    assert [r[0] for r in rows(changed_only(s, ["k"], time_chunk("generated_at"), ["generated_at"]), F.date_format("generated_at", "HH:mm"))] == ["09:30", "11:40", "14:30"]
