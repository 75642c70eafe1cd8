"""Live ingest: new log files into the request and daily tables, and change-only publishing.

The file source takes each file once and ignores later appends, so writers rotate into new part
files; a directory whose files do grow is scanned with ``sources.manifest`` in a scheduled job.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from ..operators.dedupe import dedupe_requests, merge_deduped
from ..operators.ordered import previous, running_sum
from ..operators.usage import daily_usage
from ..session import materialize, passing
from ..sources.folders import numbers
from ..sources.lines import PLACE
from ..sources.sinks import write_days
from .latest import EVERY, Latest


def stream_logs(spark: SparkSession, path: str, glob: str = "*.jsonl", files_per_trigger: int = 1000) -> DataFrame:
    """New log lines as (file, chunk, value). Line ids are given per micro-batch by ``number_lines``."""
    return (
        spark.readStream.format("text")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(path)
        .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("chunk"), "value")
    )


def number_lines(batch: DataFrame) -> DataFrame:
    """A micro-batch with the line order column the parsers expect."""
    return batch.select("file", "chunk", F.monotonically_increasing_id().alias("ord"), "value")


def stable_keys(batch: DataFrame) -> DataFrame:
    """Request records whose keys do not depend on how the files were split into tasks.

    A record without an id is keyed by its file, its content and its number among equal records of the file. The file
    source hands over whole files, so a repeated micro-batch gives the same keys.
    """
    parsed = materialize(batch, "parsed")
    content = [c for c in parsed.columns if c not in (*PLACE, "key")]
    nameless = parsed.filter("NOT has_real_id").withColumn("__content", F.sha2(F.to_json(F.struct(*content)), 256))
    numbered = running_sum(nameless, ["file", "__content"], "chunk", ["ord"], F.lit(1), "__number")
    key = F.concat_ws("|", F.lit("synthetic"), "file", "__content", F.col("__number").cast("string"))
    return parsed.filter("has_real_id").unionByName(numbered.withColumn("key", key).select(parsed.columns))


def _table(spark: SparkSession, path: str, like: DataFrame) -> DataFrame | None:
    try:
        return spark.read.schema(like.schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def merge_requests(batch: DataFrame, table_path: str, number: int, every: int = EVERY) -> DataFrame:
    """Merges request records into the request table by max-wins; returns the touched days.

    An index beside the table holds each key's day, so of the history only the batch's keys are looked up, and only days of
    the batch, and days that hold one of its keys, are read and rewritten. Days are calendar days, so few enough to name.
    """
    spark = batch.sparkSession
    fresh = materialize(dedupe_requests(batch), "requests")
    index = key_days(spark, table_path, fresh, every)
    known = index.rows(number, fresh.select("key"))
    days = materialize(fresh.select("date").union(known.select("date")).distinct(), "days")
    stored, merged, seen = _table(spark, table_path, fresh), fresh, fresh
    if stored is not None:
        old = stored.filter(F.col("key").isNotNull() & F.col("date").isin([r.date for r in days.collect()]))
        both = materialize(merge_deduped(old, fresh, "__fresh"), "merged")
        merged, seen = both.drop("__fresh"), both.filter("__fresh")
    replace_days(merged, days, table_path)
    index.write(number, seen)
    return days


def key_days(spark: SparkSession, table_path: str, requests: DataFrame, every: int = EVERY) -> Latest:
    """Which day of the request table holds a key."""
    return Latest(spark, f"{table_path}-days", requests.select("key", "date").schema, ["key"], every=every)


def replace_days(rows: DataFrame, days: DataFrame, table_path: str) -> None:
    """Replaces exactly ``days`` by ``rows``. A partition overwrite cannot leave a day empty, so a day without
    rows gets one row of NULLs, which the readers below drop."""
    empty = days.join(rows.select("date").distinct(), "date", "left_anti").select("date")
    write_days(rows.unionByName(empty, allowMissingColumns=True), table_path)


def live_requests(spark: SparkSession, table_path: str) -> DataFrame:
    return spark.read.parquet(table_path).filter("key IS NOT NULL")


def live_daily(spark: SparkSession, table_path: str) -> DataFrame:
    return spark.read.parquet(table_path).filter("model IS NOT NULL")


def restate_daily(spark: SparkSession, requests_path: str, daily_path: str, days: DataFrame, resolve: Callable[[DataFrame], DataFrame],
                  keys: tuple[str, ...] = ()) -> None:
    """Recomputes the daily rows of the touched days from the request table."""
    requests = live_requests(spark, requests_path).filter(F.col("date").isin([r.date for r in days.collect()]))
    replace_days(materialize(daily_usage(requests, resolve(requests), keys), "daily"), days, daily_path)


def stream_requests(lines: DataFrame, parse: Callable[[DataFrame], DataFrame], resolve: Callable[[DataFrame], DataFrame],
                    requests_path: str, daily_path: str, checkpoint: str, keys: tuple[str, ...] = ()) -> DataStreamWriter:
    """A writer that keeps the request table and its daily rows up to date with each micro-batch.

    Merging is idempotent (largest copy wins, keys do not depend on task splits), so a batch replayed after a
    failure changes nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        with passing(batch.sparkSession):
            days = merge_requests(stable_keys(parse(number_lines(batch))), requests_path, number)
            restate_daily(batch.sparkSession, requests_path, daily_path, days, resolve, keys)

    return lines.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).outputMode("append")


def content_hash(df: DataFrame, ignore: Sequence[str]) -> Column:
    return F.xxhash64(F.to_json(F.struct(*[c for c in sorted(df.columns) if c not in ignore])))


def changed_against(df: DataFrame, published: DataFrame | None, keys: Sequence[str], ignore: Sequence[str] = ("generated_at",)) -> DataFrame:
    """Rows whose content differs from what was last published for their key, with ``content_hash``."""
    hashed = df.withColumn("content_hash", content_hash(df, ignore))
    if published is None:
        return hashed
    return hashed.join(published.select(*keys, "content_hash"), [*keys, "content_hash"], "left_anti")


def publish_changes(snapshot: DataFrame, path: str, keys: Sequence[str], ignore: Sequence[str] = ("generated_at",), batch: int | None = None,
                    every: int = EVERY) -> None:
    """Writes changed snapshots to ``path/log``, partitioned by batch; without a number, the batch follows the last one.

    What was last published for a key is looked up in ``path/last``, whose log is compacted every so many batches. A batch
    sees only what batches before it published and replaces its own partition, so one that is repeated after a failure
    publishes the same rows, once. Keys must not be NULL.
    """
    spark, log = snapshot.sparkSession, f"{path}/log"
    if batch is None:
        batch = max(numbers(spark, log, "batch"), default=-1) + 1
    with passing(spark):
        hashed = materialize(snapshot.withColumn("content_hash", content_hash(snapshot, ignore)), "snapshot")
        last = Latest(spark, f"{path}/last", hashed.select(*keys, "content_hash").schema, keys, every=every)
        changed = changed_against(hashed.drop("content_hash"), last.rows(batch, hashed.select(*keys)), keys, ignore)
        changed = materialize(changed, "changed")
        write_days(changed.withColumn("batch", F.lit(batch).cast("long")), log, "batch")
        last.write(batch, changed)


def changed_only(df: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence[str], ignore: Sequence[str] = ("generated_at",)) -> DataFrame:
    """Of a history of snapshots, those that differ from the one before in their key."""
    skip = [*ignore, *order]
    hashed = df.withColumn("content_hash", content_hash(df, skip)).withColumn("__chunk", chunk)
    seen = previous(hashed, list(keys), "__chunk", list(order), F.col("content_hash"), "__before")
    return seen.filter(~F.col("content_hash").eqNullSafe(F.col("__before"))).drop("__before", "__chunk", "content_hash")


def write_snapshots(stream: DataFrame, summarise: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, keys: Sequence[str],
                    every: int = EVERY) -> DataStreamWriter:
    """Publishes the summary of each micro-batch only where it changed."""

    def publish(batch: DataFrame, number: int) -> None:
        publish_changes(summarise(batch), path, keys, batch=number, every=every)

    return stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
