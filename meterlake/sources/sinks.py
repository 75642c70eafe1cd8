"""Writing submission tables: partitioned by day, replaced one day at a time, or published as whole versions."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..operators.reconcile import DAILY_KEY, upsert_daily
from ..session import materialize
from .folders import drop, names, numbers


def write_days(df: DataFrame, path: str, partition: str = "date") -> None:
    """Replaces only the day partitions present in ``df``. Rows are gathered by day, and large days split by size."""
    (df.hint("rebalance", partition).write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path))


def write_version(tables: dict[str, DataFrame], path: str) -> int:
    """Writes the tables of a submission as the next version, unseen by readers until ``commit_version``.

    Tables with a ``date`` go to day folders, the others are whole. Sessions stay at home. One writer at a time.
    """
    spark = next(iter(tables.values())).sparkSession
    version = max(numbers(spark, f"{path}/versions", "version"), default=-1) + 1
    for name, df in tables.items():
        if name != "sessions":
            rows = df.hint("rebalance", "date").write.partitionBy("date") if "date" in df.columns else df.write
            rows.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{path}/versions/version={version}/{name}")
    kinds = [(name, df.schema.json()) for name, df in tables.items()]
    spark.createDataFrame(kinds, "table string, kind string").coalesce(1).write.mode("overwrite").parquet(f"{path}/kinds/version={version}")
    return version


def commit_version(spark: SparkSession, path: str, version: int, days: DataFrame | None = None) -> None:
    """Makes a version visible at once, by a list of what it replaces that is written last.

    ``days(table, date)`` are days that the version replaces although it may have no rows for them.
    """
    held = []
    for name in names(spark, f"{path}/versions/version={version}"):
        found = names(spark, f"{path}/versions/version={version}/{name}")
        held += [(name, n.split("=", 1)[1]) for n in found if n.startswith("date=")]
        held += [(name, None)] if any(n.startswith("part-") for n in found) else []
    listed = spark.createDataFrame(held, "table string, date string")
    if days is not None:
        listed = listed.unionByName(days.select("table", F.col("date").cast("string")))
    listed.distinct().coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/version={version}")


def write_submission(tables: dict[str, DataFrame], path: str, days: DataFrame | None = None) -> int:
    """Publishes a submission whole or not at all: readers see all its tables, or those before it."""
    version = write_version(tables, path)
    commit_version(next(iter(tables.values())).sparkSession, path, version, days)
    return version


def _committed(spark: SparkSession, path: str) -> DataFrame | None:
    """(table, date, version) of all versions whose commit is complete."""
    done = numbers(spark, f"{path}/commits", "version", complete=True)
    if not done:
        return None
    return spark.read.schema("table string, date string, version long").option("basePath", f"{path}/commits").parquet(
        *(f"{path}/commits/version={v}" for v in done))


def read_submission(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table as the committed versions have it: of each day, or of a table without days as a whole, the newest."""
    commits = _committed(spark, path)
    newest = [] if commits is None else commits.filter(F.col("table") == name).groupBy("date").agg(F.max("version").alias("version")).collect()  # a row a day
    if not newest:
        raise ValueError(f"no committed version of {name} in {path}")
    folder = lambda v: f"{path}/versions/version={v}/{name}"
    kinds = spark.read.schema("table string, kind string, version long").parquet(f"{path}/kinds")
    last = kinds.filter((F.col("table") == name) & F.col("version").isin([r.version for r in newest])).agg(F.max_by("kind", "version")).first()[0]
    reader = spark.read.schema(StructType.fromJson(json.loads(last)))
    if newest[0].date is None:
        return reader.parquet(folder(newest[0].version))
    parts = [spark.createDataFrame([], StructType.fromJson(json.loads(last)))]
    for version in sorted({r.version for r in newest}):
        held = {*names(spark, folder(version))}
        found = [f"{folder(version)}/date={r.date}" for r in newest if r.version == version and f"date={r.date}" in held]
        if found:
            parts.append(reader.option("basePath", folder(version)).parquet(*found))
    return reduce(DataFrame.unionByName, parts)


def collect_versions(spark: SparkSession, path: str) -> list[str]:
    """Drops, and names, the folders that no reader of the newest commit takes: replaced days, and versions never committed.

    Readers that began before the newest commit should have ended.
    """
    commits, gone = _committed(spark, path), []
    if commits is None:
        return gone
    last = commits.agg(F.max("version")).first()[0]
    kept = {(r.table, r.date): r.version for r in commits.groupBy("table", "date").agg(F.max("version").alias("version")).collect()}
    for version in [v for v in numbers(spark, f"{path}/versions", "version") if v <= last]:
        top, live = f"{path}/versions/version={version}", False
        for name in names(spark, top):
            days = [n.split("=", 1)[1] for n in names(spark, f"{top}/{name}") if n.startswith("date=")] or [None]
            old = [d for d in days if kept.get((name, d)) != version]
            live |= len(old) < len(days)
            gone += [f"{top}/{name}/date={d}" for d in old] if len(old) < len(days) else [f"{top}/{name}"]
        gone += [] if live else [top]
    for folder in gone:
        drop(spark, folder)
    return gone


def upsert_table(spark: SparkSession, path: str, incoming: DataFrame, keys=DAILY_KEY) -> None:
    """Idempotent upsert into a date-partitioned table: only the touched days are read and rewritten.

    The merged days go through the shared checkpoint folder first, because the table is read and
    written in one step.
    """
    try:
        table = spark.read.schema(incoming.schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        write_days(incoming, path)
        return
    days = incoming.select("date").distinct()
    stored = table.join(days, "date", "left_semi")
    write_days(materialize(upsert_daily(stored, incoming, keys)), path)
