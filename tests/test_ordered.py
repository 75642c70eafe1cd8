"""Chunked scans, ranks and greedy windows against plain windows and brute force."""

import random
from datetime import datetime, timedelta

import numpy as np
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import Window as W, functions as F

from conftest import rows
from meterlake.operators.dedupe import dedupe_requests, dedupe_sessions, merge_blocks, merge_daily
from meterlake.operators.greedy import NEVER, burst_exits, coalesce_bursts, composed, through, throttle, throttle_exit, throttle_run, throttle_summary
from meterlake.operators.ordered import Scan, _band, earliest_within, rank_desc, scan
from meterlake.operators.reports import above_cut

quick = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


@quick
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 40), st.one_of(st.none(), st.integers(-5, 5))), max_size=40, unique_by=lambda r: (r[0], r[1])), st.integers(1, 9))
def test_scan_equals_a_window_over_the_whole_key(spark, data, size):
    df = spark.createDataFrame(data, "k string, t int, v int").withColumn("c", F.floor(F.col("t") / size))
    out = scan(df, ["k"], "c", ["t"], [
        Scan("sum", F.col("v"), "s"), Scan("sum", F.col("v"), "s0", False), Scan("last", F.col("v"), "l"), Scan("last", F.col("v"), "l0", False), Scan("previous", F.col("v"), "p")])
    w = W.partitionBy("k").orderBy("t")
    upto, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0)
    plain = df.select("*", F.coalesce(F.sum("v").over(upto), zero).alias("s"), F.coalesce(F.sum("v").over(before), zero).alias("s0"),
                      F.last("v", True).over(upto).alias("l"), F.last("v", True).over(before).alias("l0"), F.lag("v").over(w).alias("p"))
    assert rows(out) == rows(plain)


@quick
@given(st.lists(st.integers(0, 300), max_size=30, unique=True), st.integers(1, 120))
def test_earliest_within_the_lookback(spark, times, lookback):
    df = spark.createDataFrame([("a", t, t * 2) for t in times], "k string, at long, id long")
    got = rows(earliest_within(df, ["k"], "at", lookback, ["at"], ["at", "id"], "first", chunk_ms=50), "at", "first.at")
    assert got == sorted(((t, min(x for x in times if t - lookback <= x <= t)) for t in times), key=lambda r: tuple(str(x) for x in (0, r[0]))[1:] and (str(r[0]), str(r[1])))


@quick
@given(st.lists(st.one_of(st.integers(-3, 6), st.integers(-(10**15), 10**15)), max_size=40))
def test_rank_over_the_whole_table(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v long")
    plain = df.withColumn("rank", F.rank().over(W.orderBy(F.desc("v"))).cast("long"))
    assert rows(rank_desc(df, "v", steps=8), "i", "rank") == rows(plain, "i", "rank")


def test_bands_grow_with_the_value(spark):
    values = sorted({0, 1, 2, 255, 256, 257, 511, 512, 513, *[2**i + d for i in range(3, 62) for d in (-1, 0, 1)]})
    values = [-v for v in reversed(values) if v] + values
    df = spark.createDataFrame([(v,) for v in values], "v long").withColumn("b", _band(F.col("v"), 256))
    bands = [r[1] for r in df.orderBy("v").collect()]
    assert bands == sorted(bands)


def bursts(times, delay):
    out, end = {}, None
    for t in sorted(times):
        if end is None or t >= end:
            opened, end = t, t + delay
        out[opened] = out.get(opened, 0) + 1
    return [("a", k, v) for k, v in out.items()]


@quick
@given(st.lists(st.integers(0, 3000), max_size=60), st.integers(1, 40))
def test_bursts_equal_a_sequential_walk(spark, times, delay):
    df = spark.createDataFrame([("a", t) for t in times], "handle string, at_ms long")
    assert rows(coalesce_bursts(df, delay)) == sorted(bursts(times, delay), key=lambda r: tuple((False, str(x)) for x in r))


@quick
@given(st.lists(st.integers(0, 3000), min_size=1, max_size=120, unique=True), st.integers(1, 400), st.integers(1, 90), st.integers(2, 5))
def test_burst_summaries_compose(times, delay, width, fan):
    """Chunks narrower than the delay, composed in a tree, leave as a sequential walk does, for every way to enter."""
    times = sorted(times)
    level = {}
    for chunk in sorted({t // width for t in times}):
        t = np.array([x for x in times if x // width == chunk])
        level[chunk] = (t, burst_exits(t, delay))
    size = width
    while len(level) > 1:
        size *= fan
        groups = {}
        for node in sorted(level):
            groups.setdefault(node // fan, []).append(level[node])
        level = {node: composed(parts, node * size + delay) for node, parts in groups.items()}
        for node, (upto, leaves) in level.items():
            mine = [x for x in times if node * size <= x < (node + 1) * size]
            for entry in range(node * size, node * size + delay + 1):
                end = entry
                for x in mine:
                    end = x + delay if x >= end else end
                assert through([(upto, leaves)], np.array([entry]))[0] == end


def test_bursts_of_a_busy_key_through_several_levels(spark):
    rng = np.random.default_rng(4)
    times = np.cumsum(rng.integers(1, 9, 6000)).tolist()
    df = spark.createDataFrame([("a", t) for t in times] + [("b", t) for t in times[::50]], "handle string, at_ms long")
    for delay in (37, 900):  # one longer than a chunk
        got = coalesce_bursts(df, delay, chunk_rows=200, fan=3)
        want = [("b", *r[1:]) for r in bursts(times[::50], delay)] + bursts(times, delay)
        assert rows(got) == sorted(want, key=lambda r: tuple((False, str(x)) for x in r))


def throttled(data, interval):
    """The throttle, asked each millisecond."""
    out, last, synced, pending, seen = [], None, None, 0, sorted(data)
    for now in range(seen[0][0], seen[-1][0] + interval + 1) if seen else ():
        while seen and seen[0][0] == now:
            pending = max(seen.pop(0)[2], 0)
        if pending > 0 and pending != synced and (last is None or now - last >= interval):
            out.append(("a", now, pending))
            last, synced = now, pending
    return out


def throttle_of(spark, data, interval, **options):
    df = spark.createDataFrame([("a", *r) for r in data], "handle string, at_ms long, id long, tokens long")
    return rows(throttle(df, interval, **options))


def as_rows(found):
    return sorted(found, key=lambda r: tuple((False, str(x)) for x in r))


@quick
@given(st.lists(st.tuples(st.integers(0, 2000), st.integers(-1, 5)), max_size=60), st.integers(1, 40))
def test_throttle_equals_a_sequential_walk(spark, data, interval):
    numbered = [(t, i, v) for i, (t, v) in enumerate(data)]
    assert throttle_of(spark, numbered, interval) == as_rows(throttled(numbered, interval))


@settings(deadline=None)
@given(st.lists(st.tuples(st.integers(0, 400), st.integers(-1, 4)), min_size=1, max_size=60), st.integers(1, 40), st.sampled_from([1, 2, 5, 32]))
def test_throttle_chunks_chain(data, interval, windows):
    numbered = [(t, i, v) for i, (t, v) in enumerate(data)]
    moments = {t: max(v, 0) for t, _, v in sorted(numbered)}
    width, state, out = interval * windows, (NEVER, 0, 0), []
    chunks = sorted({t // width for t in moments})
    for chunk in chunks:
        t = np.array(sorted(m for m in moments if m // width == chunk))
        v, end = np.array([moments[m] for m in t]), (chunk + 1) * width
        out += zip(*throttle_run(t, v, *state, interval, float("inf") if chunk == chunks[-1] else end))
        summary = {k: np.array(x) for k, x in throttle_summary(t, v, interval, end).items()}
        state = (*throttle_exit(summary, *state, interval, end), int(v[-1]))
    assert [("a", *r) for r in out] == throttled(numbered, interval)


def test_throttle_sends_the_newest_value_when_the_interval_ends(spark):
    assert throttle_of(spark, [(0, 1, 100), (5, 2, 200), (29, 3, 300), (60, 4, 400)], 30) == [("a", 0, 100), ("a", 30, 300), ("a", 60, 400)]
    assert throttle_of(spark, [(0, 1, 100), (10, 2, 200), (20, 3, 300)], 1000) == [("a", 0, 100), ("a", 1000, 300)]
    assert throttle_of(spark, [(0, 1, 100), (10, 2, 200)], 1000, until_ms=999) == [("a", 0, 100)]
    assert throttle_of(spark, [(0, 1, 0), (0, 3, 50), (0, 2, 40), (9, 4, 50), (70, 5, 50), (71, 6, None)], 30) == [("a", 0, 50)]


def test_throttle_of_many_keys(spark):
    pick = random.Random(5)
    data = {f"k{k}": [(pick.randint(0, 2000), i, pick.choice([-1, 0, 1, 2, 3, 5])) for i in range(pick.randint(1, 60))] for k in range(60)}
    data["silent"] = [(1, 1, 0), (900, 2, -4)]
    df = spark.createDataFrame([(k, *r) for k, d in data.items() for r in d], "handle string, at_ms long, id long, tokens long")
    assert sorted(map(tuple, throttle(df, 7).collect())) == sorted((k, t, v) for k, d in data.items() for _, t, v in throttled(d, 7))
    assert throttle(df.filter("handle = 'silent'"), 7).count() == 0


def test_throttle_skips_long_runs_of_the_synced_value(spark):
    data = [(t, t, 7) for t in range(0, 5000, 3)] + [(5000, 5000, 8), (5001, 5001, 7), (9999, 9999, 8)]
    assert throttle_of(spark, data, 10) == as_rows(throttled(data, 10))


TOKENS = "input_tokens long, output_tokens long, cache_creation_tokens long, cache_read_tokens long"


def test_duplicate_rules_do_not_depend_on_row_order(spark):
    data = [("k1", 5, "a", 0, 1), ("k1", 9, "a", 0, 2), ("k1", 9, "b", 0, 0), ("k2", 1, "b", 0, 3)]
    for seed in range(3):
        random.Random(seed).shuffle(data)
        df = spark.createDataFrame([(k, t, 0, 0, 0, f, c, o) for k, t, f, c, o in data], f"key string, {TOKENS}, file string, chunk int, ord int").repartition(3)
        assert rows(dedupe_requests(df), "key", "input_tokens", "file", "ord") == [("k1", 9, "a", 2), ("k2", 1, "b", 3)]
        assert rows(dedupe_sessions(df, ("key",)), "key", "ord") == [("k1", 2), ("k2", 3)]


def test_daily_rows_and_blocks_merge(spark):
    df = spark.createDataFrame(
        [("d", "t", "m", "cli", 1, 2, 3, 4, 10, True, None), ("d", "t", "m", "cli", 1, 0, 0, 0, 5, False, 3), ("d", "t", "n", "cli", 1, 0, 0, 0, 5, True, None)],
        f"date string, tool string, model string, origin string, {TOKENS}, cost_micro long, verified boolean, request_count long")
    assert rows(merge_daily(df), "model", "input_tokens", "output_tokens", "cost_micro", "verified", "request_count") == [("m", 2, 2, 15, False, 3), ("n", 1, 0, 5, True, None)]
    blocks = spark.createDataFrame([("t1", 1, 2), ("t1", 3, 4)], "start_time string, total_tokens long, cost_micro long")
    assert rows(merge_blocks(blocks)) == [("t1", 4, 6)]


def test_wide_caps_are_exact(spark):
    df = spark.range(6000).select((F.col("id") % 2).alias("g"), "id", (F.col("id") * 7919 % 6007).alias("v"))
    kept = above_cut(df, ["g"], "v", [F.col("id")], 1200, rows=40, fan=3)
    plain = df.withColumn("n", F.row_number().over(W.partitionBy("g").orderBy(F.desc("v"), "id"))).filter("n <= 1200").drop("n")
    assert rows(kept) == rows(plain)


def test_caps_of_a_hot_group_and_equal_values(spark):
    """A third of all rows in one group, most of them equal, beside small groups, a NULL group and NULL values."""
    g = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 != 1, F.concat(F.lit("g"), (F.col("id") % 40).cast("string")))
    v = F.when(F.col("id") % 17 == 0, F.col("id") % 1000 - 300).when(F.col("id") % 11 != 0, F.lit(5)).cast("long")
    df = spark.range(9000).select(g.alias("g"), "id", v.alias("v"))
    for n in (50, 1500, 5000):
        kept = above_cut(df, ["g"], "v", [F.col("id")], n, rows=100, fan=4)
        plain = df.withColumn("n", F.row_number().over(W.partitionBy("g").orderBy(F.desc_nulls_last("v"), "id"))).filter(F.col("n") <= n).drop("n")
        assert rows(kept) == rows(plain)
    assert rows(above_cut(df, [], "v", [F.col("id")], 70, rows=100, fan=4)) == rows(df.orderBy(F.desc_nulls_last("v"), "id").limit(70))


def test_rank_keeps_null_values(spark):
    df = spark.createDataFrame([("a", 5), ("b", None), ("c", 7)], "k string, v long")
    assert {(r.k, r["rank"]) for r in rank_desc(df, "v").collect()} == {("a", 2), ("b", None), ("c", 1)}
