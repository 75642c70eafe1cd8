"""Live limits as tables that are restated: alerts, forecasts and known limits of every sample so far.

A sample of a micro-batch, late or not, may change what followed from others of its key: alerts and known limits of the
sample before and after it, forecasts of the hours after it. Each batch therefore adds its samples to a table, reads the
(key, hour) chunks that these touch, with the lookback and the neighbouring samples from chunk summaries, runs the batch
operators of ``operators.limits`` over them, and writes the results of exactly these chunks with its number. Readers take
the newest results of each chunk, so after any batch they equal the batch operators over all samples so far.

Samples are ``(key STRING, at TIMESTAMP, id LONG, percent DOUBLE[, reset_at TIMESTAMP])``. Samples of equal (key, at, id)
are one: the first batch's, and in a batch the least percent's. Non-finite percents and NULL keys tell nothing. A chunk
is a task at most, also for the busiest key, and what a batch reads is bounded by its hours and lookback, not by a count.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter
from pyspark.sql.types import StructType

from ..operators.limits import ALERT_LEVELS, LOOKBACK_MINUTES, finite_samples, forecast_hit, known_limits, limit_steps, threshold_alerts
from ..operators.ordered import CHUNK_SECONDS, time_chunk
from ..session import materialize, passing
from ..sources.folders import drop, names, numbers
from .latest import EVERY, Latest

PLACE = ["key", "at", "id"]
SAMPLE = "at timestamp, id long, percent double, reset_at timestamp"
STORED = f"key string, hour long, {SAMPLE}"
ALERTS = "key string, hour long, edge boolean, at timestamp, id long, percent double, kind string, level int"
FORECASTS = "key string, hour long, at timestamp, id long, percent double, hit_ms long"
STEPS = "key string, hour long, edge boolean, at timestamp, id long, percent double, reset_at timestamp, next_at timestamp"
HOURS_PER_DAY = 24 * 3600 // CHUNK_SECONDS


def day_of(hour: Column | str) -> Column:
    return F.floor((F.col(hour) if isinstance(hour, str) else hour) / F.lit(HOURS_PER_DAY)).cast("int")


def _schema(spark: SparkSession, ddl: str) -> StructType:
    return spark.createDataFrame([], ddl).schema


class LimitTables:
    """The tables under ``path``; ``add`` takes the micro-batches in the order of their numbers.

    ``results`` names the tables to keep: ``alerts``, ``forecasts`` and ``steps`` (for ``limits``).
    """

    def __init__(self, spark: SparkSession, path: str, levels: Sequence[float] = ALERT_LEVELS, lookback_minutes: int = LOOKBACK_MINUTES,
                 every: int = EVERY, results: Sequence[str] = ("alerts", "forecasts", "steps")) -> None:
        self.spark, self.path, self.levels, self.lookback_minutes, self.results = spark, path, levels, lookback_minutes, results
        inner = ", ".join(f"{n}: {t}" for n, t in (c.split(" ") for c in SAMPLE.split(", ")))
        summary = _schema(spark, f"key string, hour long, first struct<{inner}>, last struct<{inner}>")
        self.chunks = Latest(spark, f"{path}/chunks", summary, ["key", "hour"], by=["key"], every=every)

    # ------------------------------------------------------------ tables by day and batch

    def _store(self, rows: DataFrame, batch: int) -> None:
        """The samples of a batch in folders of their day; a repeated batch replaces its own."""
        numbered = rows.withColumns({"day": day_of("hour"), "batch": F.lit(batch).cast("long")})
        (numbered.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("day", "batch").parquet(f"{self.path}/samples"))

    def _stored(self, days: Sequence[int], upto: int) -> DataFrame:
        top, held = f"{self.path}/samples", {*names(self.spark, f"{self.path}/samples")}
        folders = [f"{top}/day={d}" for d in days if f"day={d}" in held]
        rows = self.spark.read.schema(_schema(self.spark, f"{STORED}, day int, batch long")).option("basePath", top).parquet(*folders)
        return rows.filter(F.col("batch") <= upto)

    def _write(self, rows: DataFrame, table: str, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{table}/batch={batch}")

    def _newest(self, table: str, ddl: str, chunk: Sequence[str]) -> DataFrame:
        """Of each chunk the rows of the batch that restated it last."""
        if not names(self.spark, f"{self.path}/{table}"):
            return self.spark.createDataFrame([], _schema(self.spark, ddl))
        rows = self.spark.read.schema(_schema(self.spark, f"{ddl}, batch long")).parquet(f"{self.path}/{table}")
        last = rows.groupBy(*chunk).agg(F.max("batch").alias("batch"))
        return rows.join(last, [*chunk, "batch"], "left_semi").filter("id IS NOT NULL")

    # ------------------------------------------------------------ a micro-batch

    def add(self, batch: DataFrame, number: int) -> None:
        with passing(self.spark):
            self._add(batch, number)

    def _add(self, batch: DataFrame, number: int) -> None:
        if "reset_at" not in batch.columns:
            batch = batch.withColumn("reset_at", F.lit(None).cast("timestamp"))
        clean = finite_samples(batch).filter("key IS NOT NULL AND at IS NOT NULL AND id IS NOT NULL")
        one = clean.groupBy(*PLACE).agg(F.min(F.struct("percent", "reset_at")).alias("r")).select("key", time_chunk("at").alias("hour"), "at", "id", "r.*")
        new = materialize(one, "samples")
        if new.isEmpty():
            return
        self._store(new, number)
        rows = materialize(self._around(new, number), "around")
        if "forecasts" in self.results:
            forecasts = forecast_hit(rows, ["key"], self.lookback_minutes).filter("restated")
            self._write(forecasts.select("key", "hour", "at", "id", "percent", "hit_ms"), "forecasts", number)
        if "alerts" in self.results or "steps" in self.results:
            self._restate_neighbours(rows.filter("touched").drop("touched", "restated"), number)

    def _around(self, new: DataFrame, number: int) -> DataFrame:
        """Samples of the chunks that the new ones touch, of those whose forecasts they change, and of these ones' lookback."""
        reach = -(-self.lookback_minutes * 60 // CHUNK_SECONDS) if "forecasts" in self.results else 0
        near = new.select("key", "hour").distinct().select("key", F.explode(F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda k: F.struct(
            (F.col("hour") + k).alias("hour"), (k == 0).alias("touched"), (k >= 0).alias("restated")))).alias("c")).select("key", "c.*")
        near = materialize(near.groupBy("key", "hour").agg(F.bool_or("touched").alias("touched"), F.bool_or("restated").alias("restated")), "near")
        days = [r[0] for r in near.select(day_of("hour")).distinct().collect()]  # calendar days
        stored = self._stored(days, number)
        kept = stored.groupBy(*PLACE, "hour").agg(F.min_by(F.struct("percent", "reset_at"), F.struct("batch", "percent", "reset_at")).alias("r"))
        return kept.select(*PLACE, "hour", "r.*").join(near, ["key", "hour"])

    def _restate_neighbours(self, rows: DataFrame, number: int) -> None:
        """Alerts and steps of the touched chunks' ``rows``, of the sample after them and of the one before."""
        sample = F.struct("at", "id", "percent", "reset_at")
        fresh = materialize(rows.groupBy("key", "hour").agg(
            F.min_by(sample, F.struct("at", "id")).alias("first"), F.max_by(sample, F.struct("at", "id")).alias("last")), "summaries")
        stored = self.chunks.rows(number, fresh.select("key")).join(fresh, ["key", "hour"], "left_anti")
        chain = stored.withColumn("touched", F.lit(False)).unionByName(fresh.withColumn("touched", F.lit(True)))
        # a row an hour of a key
        order = "OVER (PARTITION BY key ORDER BY hour)"
        chain = chain.selectExpr("*", f"lag(touched) {order} AS after", f"lead(touched) {order} AS before")
        ends = materialize(chain.where("NOT touched AND (after OR before)"), "ends")
        following = ends.where("after").select("key", "hour", "first.*").withColumns({"role": F.lit(1), "edge": F.lit(True)})
        leading = ends.where("before").select("key", "hour", "last.*").withColumns({"role": F.lit(2), "edge": F.lit(True)})
        edges = fresh.select("key", "hour", F.struct("first.at", "first.id").alias("__first"), F.struct("last.at", "last.id").alias("__last"))
        own = rows.join(edges, ["key", "hour"]).withColumn("role", F.lit(0))
        place = F.struct("at", "id")
        columns = ["key", "hour", "at", "id", "percent", "reset_at", "role", "edge"]

        def with_ends(edge: str, first: int) -> DataFrame:
            """Each sample once; one alone in its hour may both follow and lead, and counts as ``first``.

            The ends lie in other hours than the chunks' own samples, so only they can meet. Written, for the scan reads it twice.
            """
            pick = F.min_by(F.struct("hour", "percent", "reset_at", "role", "edge"), F.when(F.col("role") == first, -1).otherwise(F.col("role")))
            both = following.select(columns).unionByName(leading.select(columns)).groupBy(*PLACE).agg(pick.alias("r")).select(*PLACE, "r.*")
            return materialize(own.withColumn("edge", place == F.col(edge)).select(columns).unionByName(both), "with-ends")

        marks = fresh.select("key", "hour", F.explode(F.array(F.lit(True), F.lit(False))).alias("edge"))
        if "alerts" in self.results:
            alerts = threshold_alerts(with_ends("__first", 1), ["key"], self.levels, ["hour", "edge", "role"]).filter("role < 2")
            # also a chunk without alerts replaces those it had
            every = marks.unionByName(following.select("key", "hour", "edge"))
            self._write(alerts.drop("role").unionByName(every, allowMissingColumns=True), "alerts", number)
        if "steps" in self.results:
            steps = limit_steps(with_ends("__last", 2), ["key"]).filter("role <> 1")
            self._write(steps.drop("role").unionByName(marks, allowMissingColumns=True), "steps", number)
        self.chunks.write(number, fresh)

    # ------------------------------------------------------------ readers

    def alerts(self) -> DataFrame:
        """(key, at, id, percent, kind, level), as ``threshold_alerts`` gives them."""
        return self._newest("alerts", ALERTS, ["key", "hour", "edge"]).select(*PLACE, "percent", "kind", "level")

    def forecasts(self) -> DataFrame:
        """(key, at, id, percent, hit_ms), as ``forecast_hit`` gives them."""
        return self._newest("forecasts", FORECASTS, ["key", "hour"]).select(*PLACE, "percent", "hit_ms")

    def limits(self, now: Column | datetime) -> DataFrame:
        """(key, at, percent, reset_at) known until ``now``. A reset shows as soon as the clock passes it, without a new sample."""
        steps = self._newest("steps", STEPS, ["key", "hour", "edge"])
        return known_limits(steps.select(*PLACE, "percent", "reset_at", "next_at"), now, ["key"])

    def forget_before(self, hour: int) -> None:
        """Drops the samples of days that end before ``hour``; results stay. Later samples of such days see no others of them."""
        for day in numbers(self.spark, f"{self.path}/samples", "day"):
            if (day + 1) * HOURS_PER_DAY <= hour:
                drop(self.spark, f"{self.path}/samples/day={day}")


def write_limit_tables(samples: DataFrame, path: str, checkpoint: str, **options) -> DataStreamWriter:
    """A writer that keeps the tables under ``path`` up to date with each micro-batch of ``samples``."""
    add: Callable[[DataFrame, int], None] = lambda batch, number: LimitTables(batch.sparkSession, path, **options).add(batch, number)
    return samples.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
