"""Session settings and tables in the shared checkpoint folder."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .sources.folders import drop


def build_session(app: str = "meterlake", master: str | None = None, shuffle_partitions: int | None = None,
                  **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC days and skew handling on.

    On a cluster ``master`` and the partition count come from spark-submit; AQE then
    splits or coalesces the shuffle partitions it finds at run time.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return ship_package(builder.getOrCreate())


_LOCAL_DIRS: dict[str, str] = {}
_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors once, so that functions that run there find it from any folder."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        _SHIPPED.add(app)
        root = Path(__file__).resolve().parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='meterlake-')}/meterlake", "zip", root.parent, root.name)
        spark.sparkContext.addPyFile(archive)  # the driver serves the file
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="meterlake-")
    return _LOCAL_DIRS[app]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


_PASSING: list[list[str]] = []


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialize`` writes inside this block are dropped at its end, also after an error."""
    _PASSING.append([])
    try:
        yield
    finally:
        for path in _PASSING.pop():
            drop(spark, path)


def materialize(df: DataFrame, name: str = "stage", lasting: bool = False) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it back.

    Lineage ends there, so lost executors cost nothing; and unlike an RDD checkpoint the table keeps
    column pruning and a known size for join planning. A ``lasting`` one stays beyond the block of ``passing``, until
    the end of the block around it if there is one.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    blocks = _PASSING[:-1] if lasting else _PASSING
    if blocks:
        blocks[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
