"""What several corpus operators share: words, splits, payload columns and row numbers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.session import materialize

#: A word is a longest run of characters other than space and U+0009 to U+000D.
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def packed(df: DataFrame, carry: list[str] | None, **inputs: str) -> DataFrame:
    """``row`` holds the columns ``carry`` (None: all); beside it the named inputs, so that no column name can clash."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in carry or df.columns)).alias("row"),
                     *(F.col(f"`{c}`").alias(name) for name, c in inputs.items()))


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*(F.col("row").getField(c).alias(c) for c in columns))


def map_column(df: DataFrame, column: str, fields: str, rows_of: Callable[[list], list[tuple]], keep: list[str]) -> DataFrame:
    """Adds the columns ``fields``, which ``rows_of`` computes for a batch of values of ``column``; keeps ``keep``."""
    added = df.sparkSession.createDataFrame([], fields).schema
    kept = df.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in added.fields]
        for batch in batches:
            found = list(zip(*rows_of(batch.column(column).to_pylist()), strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(v, k) for v, k in zip(found, kinds, strict=True)],
                names=[*keep, *(f.name for f in added.fields)])

    schema = kept
    for field in added.fields:
        schema = schema.add(field)
    return df.select(*dict.fromkeys([*keep, column])).mapInArrow(run, schema)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds ``name``, the position from 0 under ``order``, by a range-partitioned sort and one count a partition."""
    pos = "numbered_pos"
    done = materialize(df.sort(*order).withColumn(pos, F.monotonically_increasing_id()), "numbered")
    part = F.shiftrightunsigned(F.col(pos), 33)
    sizes = done.groupBy(part.alias("numbered_part")).agg(F.count("*").alias("numbered_rows"))
    before = sizes.selectExpr(
        "numbered_part", "sum(numbered_rows) OVER (ORDER BY numbered_part) - numbered_rows AS numbered_base")
    return (done.join(before, part == F.col("numbered_part"))
            .withColumn(name, F.col("numbered_base") + F.col(pos).bitwiseAND(F.lit((1 << 33) - 1)))
            .drop(pos, "numbered_part", "numbered_base"))
