"""The newest row of each key over numbered batches, read by key without reading the whole history.

A table has a *log*, one folder a batch, and a *base*: the newest row of each key up to a batch, in folders by the key's
hash. A reader takes the base's folders of the keys it wants and the log since. Every ``every`` batches a new base is
written; its number of folders follows its rows, so a folder stays about as large as before, however long the history.

A batch reads only what batches before it wrote and replaces its own folder, so one repeated after a failure changes
nothing. The base before the newest one stays, with the log since, for the newest may hold the batch that is repeated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..session import materialize
from ..sources.folders import drop, numbers

EVERY = 16
ROWS_PER_BUCKET = 50_000
MOST_BUCKETS = 1 << 16


class Latest:
    """``keys`` name a row, ``by`` (default: the keys) are the ones that readers look for; ``schema`` has keys and values.

    Batch numbers grow; each is written once, or again with the same rows. Keys must not be NULL.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], by: Sequence[str] | None = None,
                 every: int = EVERY, rows_per_bucket: int = ROWS_PER_BUCKET) -> None:
        self.spark, self.path, self.schema, self.keys, self.by = spark, path, schema, list(keys), list(by or keys)
        self.every, self.rows_per_bucket = every, rows_per_bucket

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(buckets)).cast("int")

    def _bases(self) -> list[int]:
        folder = f"{self.path}/base"
        return [n for n in numbers(self.spark, folder, "upto") if numbers(self.spark, f"{folder}/upto={n}", "buckets", complete=True)]

    def _numbered(self) -> StructType:
        return StructType([*self.schema.fields, StructField("batch", LongType())])

    def parts(self, before: int, wanted: DataFrame | None = None) -> DataFrame:
        """The stored rows that a reader of ``wanted`` (its ``by`` columns) has to read, with the batch that wrote them."""
        base = max((n for n in self._bases() if n < before), default=None)
        log = [n for n in numbers(self.spark, f"{self.path}/log", "batch") if n < before and (base is None or n > base)]
        reader = self.spark.read.schema(self._numbered())
        parts = [reader.option("basePath", f"{self.path}/log").parquet(*(f"{self.path}/log/batch={n}" for n in log))] if log else []
        if base is not None:
            folder = f"{self.path}/base/upto={base}"
            buckets, = numbers(self.spark, folder, "buckets")
            rows = self.spark.read.schema(self._numbered().add(StructField("bucket", IntegerType()))).option("basePath", f"{folder}/buckets={buckets}").parquet(f"{folder}/buckets={buckets}")
            if wanted is not None and buckets > 1:
                # a number a folder at most
                touched = [r[0] for r in wanted.select(self._bucket(buckets)).distinct().collect()]
                rows = rows.filter(F.col("bucket").isin(touched)) if len(touched) < buckets else rows
            parts.append(rows.drop("bucket"))
        if not parts:
            return self.spark.createDataFrame([], self._numbered())
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def rows(self, before: int, wanted: DataFrame | None = None) -> DataFrame:
        """The newest row of each key by the batches before ``before``; of ``wanted``'s only, where given."""
        parts = self.parts(before, wanted)
        if wanted is not None:
            parts = parts.join(wanted.select(*self.by).distinct(), self.by, "left_semi")
        values = [c for c in self.schema.names if c not in self.keys]
        # a key is once in a batch, so all values come from one row; plain ones fold in a hash table, a struct would be sorted
        return parts.groupBy(*self.keys).agg(*[F.max_by(v, "batch").alias(v) for v in values]).select(*self.schema.names)

    def write(self, batch: int, rows: DataFrame) -> None:
        """The rows of a batch, a key once; then a new base if it is time."""
        rows.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/log/batch={batch}")
        bases = self._bases()
        since = [n for n in numbers(self.spark, f"{self.path}/log", "batch") if not bases or n > bases[-1]]
        if len(since) >= self.every:
            self.compact(batch)

    def compact(self, batch: int) -> None:
        """Writes the base up to ``batch``; drops the bases before the last one, and the log that this one holds."""
        rows = materialize(self.rows(batch + 1), "newest")
        count, buckets = rows.count(), 1
        while buckets < MOST_BUCKETS and buckets * self.rows_per_bucket < count:
            buckets *= 2
        folder, last = f"{self.path}/base/upto={batch}", max((n for n in self._bases() if n < batch), default=None)
        drop(self.spark, folder)
        numbered = rows.withColumns({"batch": F.lit(batch).cast("long"), "bucket": self._bucket(buckets)})
        numbered.repartition("bucket").write.partitionBy("bucket").parquet(f"{folder}/buckets={buckets}")
        for n in self._bases():
            if last is not None and n < last:
                drop(self.spark, f"{self.path}/base/upto={n}")
        for n in numbers(self.spark, f"{self.path}/log", "batch"):
            if last is not None and n <= last:
                drop(self.spark, f"{self.path}/log/batch={n}")
