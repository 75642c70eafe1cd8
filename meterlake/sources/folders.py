"""Folders of tables, through Hadoop's file systems, so any store that Spark reads."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Spark's writers leave this file last, when all of a folder is there.
COMPLETE = "_SUCCESS"


def _at(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder; nothing where there is none."""
    files, place = _at(spark, path)
    return [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []


def numbers(spark: SparkSession, path: str, column: str, complete: bool = False) -> list[int]:
    """The numbers N of the folders ``column=N``, ascending; ``complete`` leaves out those a writer has not ended."""
    found = [n.split("=", 1)[1] for n in names(spark, path) if n.startswith(f"{column}=")]
    return sorted(int(n) for n in found if not complete or COMPLETE in names(spark, f"{path}/{column}={n}"))


def drop(spark: SparkSession, path: str) -> None:
    files, place = _at(spark, path)
    files.delete(place, True)
