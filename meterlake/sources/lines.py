"""Reading text logs as ordered lines, and parsing each line once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# columns that place a line: its file, the split of the file, and an id that grows inside the split
PLACE = ("file", "chunk", "ord")


def read_lines(spark: SparkSession, paths: str | Sequence[str], glob: str = "*.jsonl",
               modified_after: str | None = None) -> DataFrame:
    """Lines of all matching files with (file, chunk, ord). Large files split over tasks.

    The id is taken straight after the scan, before any filter or shuffle can move rows.
    ``modified_after`` (``YYYY-MM-DDTHH:MM:SS``) leaves older files unopened.
    """
    reader = spark.read.format("text").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    return (
        reader.load(paths if isinstance(paths, str) else list(paths))
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("chunk"),
            F.monotonically_increasing_id().alias("ord"),
            "value",
        )
    )


def read_documents(spark: SparkSession, paths: str | Sequence[str], glob: str = "*.json") -> DataFrame:
    """One row per file, for formats whose whole file is one JSON value."""
    return (
        spark.read.format("text")
        .option("wholetext", "true")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(paths if isinstance(paths, str) else list(paths))
        .select(F.col("_metadata.file_path").alias("file"), "value")
    )


def parse_lines(lines: DataFrame, must_contain: str | None = None) -> DataFrame:
    """Adds ``rec`` (VARIANT) and drops lines that are not JSON.

    The one-element explode keeps later filters on ``rec`` from copying the parse into
    themselves, so each line is parsed once. ``must_contain`` drops lines by a plain text
    test before the parse.
    """
    if must_contain:
        lines = lines.filter(F.col("value").contains(must_contain))
    kept = [c for c in lines.columns if c != "value"]
    parsed = lines.select(*kept, F.explode(F.array(F.try_parse_json("value"))).alias("rec"))
    return parsed.filter(F.col("rec").isNotNull())


def open_lines(lines: DataFrame, schema: str, must_contain: str | None = None) -> DataFrame:
    """Adds ``rec`` of a pinned ``schema``; lines that are not JSON, or hold none of it, give NULL fields.

    Only the named fields are built, the rest of a line is skipped over. Fields whose JSON type matters are
    declared VARIANT. As in ``parse_lines`` the explode keeps the parse from being repeated.
    """
    if must_contain:
        lines = lines.filter(F.col("value").contains(must_contain))
    kept = [c for c in lines.columns if c != "value"]
    return lines.select(*kept, F.explode(F.array(F.from_json("value", schema))).alias("rec"))


def string_of(value: Column | str) -> Column:
    """A VARIANT as text when it is a JSON string, else NULL."""
    v = F.col(value) if isinstance(value, str) else value
    return F.when(kind_of(v) == "STRING", v.cast("string"))


def is_true(value: Column | str) -> Column:
    """True only for a VARIANT holding JSON ``true``."""
    v = F.col(value) if isinstance(value, str) else value
    return F.coalesce((kind_of(v) == "BOOLEAN") & (F.try_variant_get(v, "$", "string") == "true"), F.lit(False))


def text_at(rec: Column | str, path: str) -> Column:
    """The value at ``path`` as text, whatever scalar it is."""
    return F.try_variant_get(rec, path, "string")


def variant_at(rec: Column | str, path: str) -> Column:
    return F.try_variant_get(rec, path, "variant")


def kind_of(value: Column) -> Column:
    return F.schema_of_variant(value)


def string_at(rec: Column | str, path: str) -> Column:
    """The value at ``path`` only when it is a JSON string."""
    return F.when(kind_of(variant_at(rec, path)) == "STRING", text_at(rec, path))


def is_object(value: Column) -> Column:
    return F.coalesce(kind_of(value).startswith("OBJECT"), F.lit(False))


def true_at(rec: Column | str, path: str) -> Column:
    """True only for a JSON ``true``."""
    v = variant_at(rec, path)
    return F.coalesce((kind_of(v) == "BOOLEAN") & F.try_variant_get(rec, path, "boolean"), F.lit(False))


def file_stem(file: Column | str = "file") -> Column:
    return F.regexp_extract(file, r"([^/]+?)(?:\.[^./]*)?$", 1)


def parent_folder(file: Column | str = "file") -> Column:
    return F.regexp_extract(file, r"([^/]+)/[^/]+$", 1)
