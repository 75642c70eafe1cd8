"""Development-data ledgers: one generation per line."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import epoch_to_ts, iso_to_ts, local_day, plausible_instant, token_count
from .lines import kind_of, open_lines, read_lines, string_of
from .rollouts import NUMBER_KIND

# Pinned parse schema; VARIANT where the JSON type decides.
RECORD_SCHEMA = """struct<eventName:variant,model:variant,timestamp:variant,eventTimestamp:variant,promptTokens:string,
    prompt_tokens:string,generatedTokens:string,generated_tokens:string>"""


def parse_generations(lines: DataFrame, now: Column | datetime, offset_minutes: Column | int = 0) -> DataFrame:
    """Generations with tokens. A record of another event is dropped; a missing event name is allowed."""
    kept = [c for c in lines.columns if c != "value"]
    given = lambda name: F.when(kind_of(F.col(f"rec.{name}")) != "VOID", F.col(f"rec.{name}"))
    opened = open_lines(lines, RECORD_SCHEMA).select(
        *kept, "rec", F.explode(F.array(F.coalesce(given("timestamp"), given("eventTimestamp")))).alias("stamp"))
    text = F.try_variant_get("stamp", "$", "string")
    instant = F.when(kind_of("stamp") == "STRING", iso_to_ts(text)).when(kind_of("stamp").rlike(NUMBER_KIND), epoch_to_ts(text))
    event = string_of("rec.eventName")
    rows = opened.filter(event.isNull() | (event == "tokensGenerated")).select(
        *kept,
        F.nullif(string_of("rec.model"), F.lit("")).alias("model"),
        F.explode(F.array(instant)).alias("ts"),
        token_count(F.coalesce("rec.promptTokens", "rec.prompt_tokens")).alias("input_tokens"),
        token_count(F.coalesce("rec.generatedTokens", "rec.generated_tokens")).alias("output_tokens"),
        F.lit(0).cast("long").alias("cache_creation_tokens"),
        F.lit(0).cast("long").alias("cache_read_tokens"),
    )
    return (
        rows.filter("model IS NOT NULL AND input_tokens + output_tokens > 0")
        .filter(plausible_instant("ts", now))
        .withColumn("date", local_day("ts", offset_minutes))
    )


def read_generations(spark: SparkSession, paths: str | Sequence[str], now: Column | datetime,
                     offset_minutes: int = 0) -> DataFrame:
    return parse_generations(read_lines(spark, paths, "tokensGenerated.jsonl"), now, offset_minutes)
