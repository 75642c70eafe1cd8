"""Streams on small files: batch equivalence and change-only publishing."""

from datetime import datetime

from pyspark.sql import functions as F

from conftest import NOW, rows
from meterlake.operators.dedupe import dedupe_requests
from meterlake.operators.pricing import resolve_prices
from meterlake.operators.usage import daily_usage
from meterlake.plans.adapter import price_dim
from meterlake.sources.transcripts import parse_requests, read_requests
from meterlake.streaming.ingest import live_daily, live_requests, number_lines, publish_changes, stable_keys, stream_logs, stream_requests, write_snapshots
from meterlake.streaming.windows import publish_windows, read_windows, stream_hourly, stream_rate, stream_sessions
from test_sources import message, write

def test_live_requests_equal_the_batch_result(spark, tmp_path):
    logs, requests, daily = tmp_path / "logs", str(tmp_path / "requests"), str(tmp_path / "daily")
    resolve = lambda df: resolve_prices(df, price_dim(spark))

    def run():
        lines = stream_logs(spark, str(logs), files_per_trigger=1)
        writer = stream_requests(lines, lambda b: parse_requests(b, NOW), resolve, requests, daily, str(tmp_path / "state"))
        writer.trigger(availableNow=True).start().awaitTermination()

    write(logs / "1.jsonl", [message("m1", "r1", output_tokens=5), message("m2", "r2", output_tokens=7), message(None, None, output_tokens=1)])
    write(logs / "2.jsonl", [message("m1", "r1", output_tokens=50), message("m1", "r1", output_tokens=20)])
    run()
    # a larger copy stamped just after midnight takes the request to the next day, whose old day is left empty
    write(logs / "3.jsonl", [message("late", "r9", ts="2026-06-20T23:59:59Z", output_tokens=3)])
    run()
    write(logs / "4.jsonl", [message("late", "r9", ts="2026-06-21T00:00:01Z", output_tokens=30)])
    run()
    whole = dedupe_requests(read_requests(spark, str(logs), NOW))
    columns = ["has_real_id", "date", "model", "output_tokens"]
    assert rows(live_requests(spark, requests), *columns) == rows(whole, *columns)
    expected = daily_usage(whole, resolve(whole))
    columns = ["date", "model", "output_tokens", "request_count", "cost_micro"]
    assert rows(live_daily(spark, daily), *columns) == rows(expected, *columns)


def test_only_changed_snapshots_are_published(spark, tmp_path):
    path = str(tmp_path / "published")

    def publish(minute, **totals):
        df = spark.createDataFrame([(k, v, datetime(2026, 8, 1, 0, minute)) for k, v in totals.items()], "handle string, tokens long, generated_at timestamp")
        publish_changes(df, path, ["handle"])

    publish(1, a=1, b=1)
    publish(2, a=1, b=2)
    publish(3, a=1, b=2)
    publish(4, a=2)
    assert rows(spark.read.parquet(path + "/log"), "handle", "tokens", F.minute("generated_at")) == [("a", 1, 1), ("a", 2, 4), ("b", 1, 1), ("b", 2, 2)]


def test_a_repeated_batch_publishes_once(spark, tmp_path):
    path = str(tmp_path / "published")
    frame = lambda **totals: spark.createDataFrame(list(totals.items()), "handle string, tokens long")
    for number, totals in ((0, {"a": 1, "b": 1}), (1, {"a": 2, "b": 1}), (1, {"a": 2, "b": 1}), (2, {"a": 1}), (2, {"a": 1})):
        publish_changes(frame(**totals), path, ["handle"], batch=number)
    assert rows(spark.read.parquet(path + "/log"), "handle", "tokens", "batch") == [("a", 1, 0), ("a", 1, 2), ("a", 2, 1), ("b", 1, 0)]


def test_snapshots_of_a_stream(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    for part in ([("a", 1), ("b", 5)], [("a", 1), ("b", 6)], [("a", 3)]):
        spark.createDataFrame(part, "handle string, tokens long").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("handle string, tokens long").parquet(source)
        summary = lambda batch: batch.groupBy("handle").agg(F.sum("tokens").alias("tokens"))
        write_snapshots(stream, summary, path, str(tmp_path / "state"), ["handle"]).trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.read.parquet(path + "/log"), "handle", "tokens") == [("a", 1), ("a", 3), ("b", 5), ("b", 6)]


def test_keys_of_lines_without_ids_do_not_follow_the_splits(spark, tmp_path):
    for name in "123":
        write(tmp_path / f"{name}.jsonl", [message(None, None, output_tokens=i % 2 + 1) for i in range(4)] + [message("m", "r")])
    found = []
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for split in ("128", before):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            text = spark.read.option("recursiveFileLookup", "true").text(str(tmp_path))
            lines = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("chunk"), "value")
            found.append(rows(stable_keys(parse_requests(number_lines(lines), NOW)), "key", "output_tokens"))
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found[0] == found[1] and len({k for k, _ in found[0] if k.startswith("synthetic")}) == 12


def test_windows_hold_open_hours_and_late_rows(spark, tmp_path):
    schema = "handle string, ts timestamp, tokens long, cost_micro long"
    at = lambda hour, minute: datetime(2026, 6, 1, hour, minute)
    batches = [[("a", at(9, 0), 1, 1), ("a", at(12, 0), 2, 2)], [("a", at(9, 20), 4, 4), ("a", at(12, 10), 8, 8)]]  # 9:20 comes late
    for name, windows in (("hours", lambda df: stream_hourly(df, None)), ("rates", lambda df: stream_rate(df, None)), ("sessions", lambda df: stream_sessions(df, delay=None))):
        source = str(tmp_path / name / "in")
        whole = spark.createDataFrame(sum(batches, []), schema)
        for part in batches:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(schema).parquet(source)
            publish_windows(stream, windows, str(tmp_path / name / "out"), str(tmp_path / name / "state")).trigger(availableNow=True).start().awaitTermination()
        got = read_windows(spark, str(tmp_path / name / "out"), windows(whole).schema)
        assert got.columns == windows(whole).columns and rows(got) == rows(windows(whole))
