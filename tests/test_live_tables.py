"""Tables that micro-batches restate: limits, newest rows by key, request days, published changes, submissions."""

import random
import subprocess
import sys
from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import rows
from meterlake.operators.limits import forecast_hit, threshold_alerts
from meterlake.sources.folders import names, numbers
from meterlake.sources.sinks import collect_versions, commit_version, read_submission, write_submission, write_version
from meterlake.streaming.ingest import key_days, live_requests, merge_requests, publish_changes
from meterlake.streaming.latest import Latest
from meterlake.streaming.limit_tables import LimitTables

SAMPLE = "key string, at timestamp, id long, percent double, reset_at timestamp"
BASE = datetime(2026, 8, 1, 10, 0)


def known_by_hand(data, now):
    """(key, at, percent, reset) by walking each key's samples in order."""
    out = []
    for key in {r[0] for r in data}:
        mine = sorted((r for r in data if r[0] == key), key=lambda r: (r[1], r[2]))
        for i, (_, at, _, percent, reset) in enumerate(mine):
            if at > now:
                break
            late = reset is not None and reset <= at
            out.append((key, at, 0.0 if late else percent, None if late else reset))
            following = mine[i + 1][1] if i + 1 < len(mine) else None
            if reset is not None and at < reset <= now and (following is None or following > reset):
                out.append((key, reset, 0.0, None))
    return out


def test_limit_tables_equal_batch_results_in_any_order(spark, tmp_path):
    """Six mixed micro-batches, some repeated, one key with a third of all rows and far more than 240 samples an hour."""
    rng = random.Random(11)
    data = []
    for i in range(1800):
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(12)}"
        at = BASE + timedelta(seconds=rng.randrange(7200) if key == "hot" else rng.randrange(400_000))
        reset = rng.choice([None, at + timedelta(minutes=rng.randrange(-10, 400))])
        data.append((key, at, i, rng.choice([rng.uniform(0, 110), 79.0, 80.0, 96.0]), reset))
    rng.shuffle(data)
    tables = LimitTables(spark, str(tmp_path / "limits"), every=3)
    now = BASE + timedelta(days=2)
    seen = []
    for number in range(6):
        part = data[number * 300:(number + 1) * 300]
        noise = [("hot", BASE, 5000 + number, float("nan"), None), ("k1", BASE, 6000 + number, None, None), (None, BASE, 7000, 5.0, None)]
        batch = spark.createDataFrame(part + noise + seen[:20], SAMPLE)  # some samples come again
        seen += part
        for _ in range(2 if number == 3 else 1):
            tables.add(batch, number)
        if number in (2, 5):
            whole = spark.createDataFrame(seen, SAMPLE)
            assert rows(tables.alerts(), "key", "id", "kind", "level", "percent") == rows(threshold_alerts(whole, ["key"]), "key", "id", "kind", "level", "percent")
            assert rows(tables.forecasts(), "key", "id", "hit_ms") == rows(forecast_hit(whole, ["key"]), "key", "id", "hit_ms")
            got = sorted((tuple(r) for r in tables.limits(now).collect()), key=str)
            assert got == sorted(known_by_hand(seen, now), key=str)


def test_the_clock_alone_shows_a_reset(spark, tmp_path):
    tables = LimitTables(spark, str(tmp_path / "limits"))
    reset = BASE + timedelta(hours=5)
    tables.add(spark.createDataFrame([("a", BASE, 1, 80.0, reset), ("b", BASE, 1, 70.0, BASE), ("c", BASE, 1, 60.0, None)], SAMPLE), 0)
    assert rows(tables.limits(BASE + timedelta(hours=4)), "key", "percent") == [("a", 80.0), ("b", 0.0), ("c", 60.0)]
    assert rows(tables.limits(reset), "key", "percent") == [("a", 0.0), ("a", 80.0), ("b", 0.0), ("c", 60.0)]
    # a sample that comes late, but was taken before the reset and lies beyond another hour, takes the zero back
    tables.add(spark.createDataFrame([("a", BASE + timedelta(hours=4), 2, 90.0, reset + timedelta(hours=5))], SAMPLE), 1)
    assert rows(tables.limits(reset), "key", "percent") == [("a", 80.0), ("a", 90.0), ("b", 0.0), ("c", 60.0)]
    tables.forget_before(int((BASE + timedelta(days=3)).timestamp() // 3600))
    assert not any(n.startswith("day=") for n in names(spark, str(tmp_path / "limits/samples"))) and tables.limits(reset).count() == 4


def test_limit_stream_runs_from_any_folder(tmp_path):
    """A stream in a process of its own, in a folder without the package."""
    root = Path(__file__).resolve().parent.parent
    script = f"""
import sys
sys.path.insert(0, {str(root)!r})
from datetime import datetime, timedelta
from meterlake.session import build_session
from meterlake.streaming.limit_tables import LimitTables, write_limit_tables
sys.path.pop(0)
spark = build_session("elsewhere", "local[2]", 2, spark__ui__enabled="false", spark__checkpoint__dir="shared", spark__sql__warehouse__dir="warehouse")
schema = "{SAMPLE}"
for i, percent in enumerate((70.0, 81.0, 10.0)):
    spark.createDataFrame([("a", datetime(2026, 8, 1) + timedelta(minutes=i), i, percent, None)], schema).write.mode("append").parquet("in")
    stream = spark.readStream.schema(schema).parquet("in")
    write_limit_tables(stream, "tables", "state").trigger(availableNow=True).start().awaitTermination()
print(sorted(tuple(r) for r in LimitTables(spark, "tables").alerts().select("id", "kind").collect()))
"""
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.stdout.strip().endswith("[(1, 'threshold'), (2, 'reset')]"), done.stderr[-2000:]


def latest(spark, path, **options):
    schema = spark.createDataFrame([], "key string, value long").schema
    return Latest(spark, path, schema, ["key"], **options)


def test_newest_rows_across_compaction(spark, tmp_path):
    rng, path = random.Random(2), str(tmp_path / "latest")
    table, want = latest(spark, path, every=3, rows_per_bucket=20), {}
    for number in range(11):
        before = rows(table.rows(number))
        assert before == sorted(want.items())
        fresh = {f"k{rng.randrange(120)}": rng.randrange(1000) for _ in range(40)}
        batch = spark.createDataFrame(list(fresh.items()), "key string, value long")
        for _ in range(3 if number % 2 else 1):
            table.write(number, batch)
            assert rows(table.rows(number)) == before  # a repeated batch sees what the first attempt saw
        want |= fresh
        some = spark.createDataFrame([("k1",), ("k7",), ("none",)], "key string")
        assert rows(table.rows(number + 1, some)) == sorted((k, v) for k, v in want.items() if k in ("k1", "k7"))
    assert len(numbers(spark, f"{path}/base", "upto")) == 2 and len(names(spark, f"{path}/log")) < 9


def test_a_lookup_reads_as_much_however_long_the_history(spark, tmp_path):
    read = []
    for size in (2_000, 16_000):
        table = latest(spark, str(tmp_path / str(size)), rows_per_bucket=100)
        table.write(0, spark.range(size).selectExpr("concat('k', id) AS key", "id AS value"))
        table.compact(0)
        table.write(1, spark.createDataFrame([("k5", 1)], "key string, value long"))
        wanted = spark.createDataFrame([("k5",), ("k6",)], "key string")
        assert rows(table.rows(2, wanted)) == [("k5", 1), ("k6", 6)]
        read.append(table.parts(2, wanted).count())
    assert read[1] < 1.5 * read[0] and read[1] < 400


def test_an_unfinished_base_is_not_read(spark, tmp_path):
    path = str(tmp_path / "latest")
    table = latest(spark, path, every=100)
    table.write(0, spark.createDataFrame([("a", 1)], "key string, value long"))
    table.compact(0)
    table.write(1, spark.createDataFrame([("a", 2)], "key string, value long"))
    table.compact(1)
    for file in (tmp_path / "latest/base/upto=1").rglob("*_SUCCESS*"):
        file.unlink()  # as if its writer had died
    table.write(2, spark.createDataFrame([("b", 3)], "key string, value long"))
    assert rows(table.rows(3)) == [("a", 2), ("b", 3)]


REQUEST = ("key string, has_real_id boolean, date date, model string, input_tokens long, output_tokens long, cache_creation_tokens long, "
           "cache_read_tokens long, ts timestamp, file string, chunk long, ord long")


def request(key, day, tokens, ord_=0):
    return (key, True, date(2026, 6, day), "m", tokens, 0, 0, 0, datetime(2026, 6, day), "f", 0, ord_)


def test_requests_move_between_days_and_repeat(spark, tmp_path):
    path = str(tmp_path / "requests")
    batches = [[request("a", 1, 5), request("b", 2, 5)], [request("a", 3, 9), request("c", 1, 1)], [request("a", 2, 7), request("b", 4, 4)], [request("b", 5, 50)]]
    days = []
    for number, batch in enumerate(batches):
        df = spark.createDataFrame(batch, REQUEST)
        for _ in range(2):
            touched = merge_requests(df, path, number, every=2)
            days.append(sorted(r.date.day for r in touched.collect()))
    assert days == [[1, 2], [1, 2]] + [[1, 3], [1, 3]] + [[2, 3, 4], [2, 3, 4]] + [[2, 5], [2, 5]]
    assert rows(live_requests(spark, path), "key", F.day("date"), "input_tokens") == [("a", 3, 9), ("b", 5, 50), ("c", 1, 1)]
    index = key_days(spark, path, spark.createDataFrame([], REQUEST))
    assert rows(index.rows(9), "key", F.day("date")) == [("a", 3), ("b", 5), ("c", 1)]


def test_published_changes_across_a_compaction(spark, tmp_path):
    path = str(tmp_path / "published")
    frame = lambda **totals: spark.createDataFrame(list(totals.items()), "handle string, tokens long")
    snapshots = [{"a": 1, "b": 1}, {"a": 1, "b": 2}, {"a": 1, "b": 2}, {"a": 1, "c": 1}, {"a": 2, "b": 2}]
    for number, totals in enumerate(snapshots):
        for _ in range(2):
            publish_changes(frame(**totals), path, ["handle"], batch=number, every=2)
    got = rows(spark.read.parquet(f"{path}/log"), "batch", "handle", "tokens")
    assert got == [(0, "a", 1), (0, "b", 1), (1, "b", 2), (3, "c", 1), (4, "a", 2)]


ENTRY = "handle string, date date, tokens long"


def entries(spark, *data):
    return spark.createDataFrame([(h, date(2026, 6, d), n) for h, d, n in data], ENTRY)


def test_submissions_appear_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "out")
    with pytest.raises(ValueError, match="no committed version"):
        read_submission(spark, path, "entries")
    first = write_submission({"entries": entries(spark, ("a", 1, 1), ("a", 2, 2)), "sessions": entries(spark), "agent": spark.range(3)}, path)
    # a writer dies midway: its day and table stay unseen
    dead = write_version({"entries": entries(spark, ("a", 1, 100), ("a", 9, 100)), "agent": spark.range(50)}, path)
    assert rows(read_submission(spark, path, "entries"), "handle", F.day("date"), "tokens") == [("a", 1, 1), ("a", 2, 2)]
    assert read_submission(spark, path, "agent").count() == 3
    assert "sessions" not in names(spark, f"{path}/versions/version={first}")
    emptied = spark.createDataFrame([("entries", date(2026, 6, 2))], "table string, date date")
    last = write_submission({"entries": entries(spark, ("b", 1, 7), ("b", 3, 8))}, path, emptied)
    want = [("b", 1, 7), ("b", 3, 8)]
    assert first < dead < last and rows(read_submission(spark, path, "entries"), "handle", F.day("date"), "tokens") == want
    gone = collect_versions(spark, path)
    assert f"{path}/versions/version={first}/entries" in gone
    assert f"{path}/versions/version={dead}" in gone and not any(f"version={last}" in g for g in gone)
    assert rows(read_submission(spark, path, "entries"), "handle", F.day("date"), "tokens") == want
    assert read_submission(spark, path, "agent").count() == 3 and collect_versions(spark, path) == []


def test_a_commit_without_its_last_file_is_none(spark, tmp_path):
    path = str(tmp_path / "out")
    write_submission({"entries": entries(spark, ("a", 1, 1))}, path)
    version = write_version({"entries": entries(spark, ("a", 1, 2))}, path)
    commit_version(spark, path, version)
    for file in (tmp_path / f"out/commits/version={version}").glob("*_SUCCESS*"):
        file.unlink()
    assert rows(read_submission(spark, path, "entries"), "tokens") == [(1,)]


def test_an_empty_submission_replaces_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    write_submission({"entries": entries(spark, ("a", 1, 1))}, path)
    write_submission({"entries": entries(spark)}, path)
    assert rows(read_submission(spark, path, "entries"), "tokens") == [(1,)]
    write_submission({"entries": entries(spark)}, path, spark.createDataFrame([("entries", date(2026, 6, 1))], "table string, date date"))
    assert read_submission(spark, path, "entries").count() == 0
