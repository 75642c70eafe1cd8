"""Incremental scans: what changed since the last listing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def list_files(spark: SparkSession, paths: str | Sequence[str], glob: str = "*.jsonl") -> DataFrame:
    """(file, size, modified) of every matching file, from metadata alone: no content is read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(paths if isinstance(paths, str) else list(paths))
        .select(F.col("_metadata.file_path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    )


def changed_files(listing: DataFrame, manifest: DataFrame, version: int, max_bytes: int | None = None) -> DataFrame:
    """Files to read again. A file is unchanged when path, size, time and parser version all match."""
    if max_bytes is not None:
        listing = listing.filter(F.col("size") <= max_bytes)
    known = manifest.filter(F.col("parser_version") == version).select("file", "size", "modified")
    return listing.join(known, ["file", "size", "modified"], "left_anti")


def newest_files(listing: DataFrame, newest: int | None = None, modified_after: str | None = None) -> DataFrame:
    """Files modified after an instant, or the ``newest`` ones, as a listing: of equal times the first names.

    Spark needs neither limit for memory; they keep a scan to what a reader of recent logs wants.
    """
    if modified_after is not None:
        listing = listing.filter(F.col("modified") > F.lit(modified_after).cast("timestamp"))
    return listing if newest is None else listing.orderBy(F.desc("modified"), "file").limit(newest)


def deleted_files(listing: DataFrame, manifest: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Files whose stored rows must go: no longer listed, or now above the size limit."""
    if max_bytes is not None:
        listing = listing.filter(F.col("size") <= max_bytes)
    return manifest.select("file").distinct().join(listing.select("file"), "file", "left_anti")


def refresh_rows(stored: DataFrame, fresh: DataFrame, changed: DataFrame, deleted: DataFrame) -> DataFrame:
    """Stored rows of untouched files plus the new rows of changed ones."""
    touched = changed.select("file").union(deleted.select("file")).distinct()
    return stored.join(touched, "file", "left_anti").unionByName(fresh, allowMissingColumns=True)


def next_manifest(listing: DataFrame, version: int, max_bytes: int | None = None) -> DataFrame:
    if max_bytes is not None:
        listing = listing.filter(F.col("size") <= max_bytes)
    return listing.select("file", "size", "modified", F.lit(version).alias("parser_version"))
