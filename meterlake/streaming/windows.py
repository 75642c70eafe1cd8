"""Event-time windows over live usage ``(handle, ts, tokens, cost_micro)``.

The window functions work on streams, where a window appears once ``delay`` has passed, and with ``delay=None`` on plain
tables. ``publish_windows`` writes the windows of each micro-batch, open ones included, and ``read_windows`` adds them up,
so late rows count and the current window is visible.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType


def _totals(grouped) -> DataFrame:
    return grouped.agg(F.sum("tokens").alias("tokens"), F.sum("cost_micro").alias("cost_micro"))


def _timely(stream: DataFrame, delay: str | None) -> DataFrame:
    return stream.withWatermark("ts", delay) if delay else stream


def stream_hourly(stream: DataFrame, delay: str | None = "2 hours", keys: tuple[str, ...] = ()) -> DataFrame:
    """Tokens and cost per UTC hour. A window closes ``delay`` after the newest instant seen."""
    out = _totals(_timely(stream, delay).groupBy(*keys, F.window("ts", "1 hour")))
    return out.select(*keys, F.col("window.start").alias("start_time"), "tokens", "cost_micro")


def stream_rate(stream: DataFrame, delay: str | None = "10 minutes", keys: tuple[str, ...] = ("handle",)) -> DataFrame:
    """Tokens of the last hour, every five minutes."""
    out = _totals(_timely(stream, delay).groupBy(*keys, F.window("ts", "1 hour", "5 minutes")))
    return out.select(*keys, F.col("window.end").alias("until"), "tokens", "cost_micro")


def stream_sessions(stream: DataFrame, gap: str = "30 minutes", delay: str | None = "1 hour", keys: tuple[str, ...] = ("handle",)) -> DataFrame:
    """Activity sessions: a session ends after ``gap`` without usage."""
    out = _totals(_timely(stream, delay).groupBy(*keys, F.session_window("ts", gap)))
    return out.select(*keys, F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "tokens", "cost_micro")


def publish_windows(stream: DataFrame, windows: Callable[[DataFrame], DataFrame], path: str, state: str) -> DataStreamWriter:
    """Writes each micro-batch's ``windows`` to a folder of its number under ``path``; a repeated batch replaces its own."""
    def write(batch: DataFrame, number: int) -> None:
        windows(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", state)


def read_windows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The windows of all micro-batches under ``path``, equal ones added up and sessions that meet joined."""
    parts = spark.read.schema(schema).parquet(path).select(*schema.names)
    keys = [c for c in schema.names if c not in ("tokens", "cost_micro")]
    if "started" not in keys:
        return _totals(parts.groupBy(*keys)).select(*schema.names)
    keys = [c for c in keys if c not in ("started", "ended")]
    length = F.concat(F.unix_micros("ended") - F.unix_micros("started"), F.lit(" microseconds"))
    met = _totals(parts.groupBy(*keys, F.session_window("started", length)))
    return met.select(*keys, F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "tokens", "cost_micro")
