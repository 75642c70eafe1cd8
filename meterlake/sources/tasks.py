"""Editor task files: one JSON array of UI messages per task."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import cost_usd, finite_number, local_day, plausible_instant, to_micro, token_count, total_tokens
from .lines import kind_of, read_documents, string_at, text_at, variant_at

# Extension folder to tool id.
TASK_TOOLS = {"saoudrizwan.claude-dev": "cline", "rooveterinaryinc.roo-cline": "roo"}


def tool_of_path(file: Column | str = "file") -> Column:
    path = F.col(file) if isinstance(file, str) else file
    tool = F.lit(None).cast("string")
    for folder, name in TASK_TOOLS.items():
        tool = F.when(path.contains(f"/{folder}/tasks/"), F.lit(name)).otherwise(tool)
    return tool


def parse_tasks(documents: DataFrame, now: Column | datetime, offset_minutes: Column | int = 0) -> DataFrame:
    """Finished requests of task documents ``(…, tool, value)``; ``value`` is the whole JSON array.

    ``text`` may be JSON text or an object. Model: the row's, else the text's, else the tool id.
    ``stored_micro`` is the recorded cost, NULL when there is none.
    """
    kept = [c for c in documents.columns if c != "value"]
    messages = (
        documents.select(*kept, F.explode(F.array(F.try_parse_json("value"))).alias("doc"))
        .select(*kept, F.explode(F.try_variant_get("doc", "$", "array<variant>")).alias("msg"))
        .filter(F.coalesce(text_at("msg", "$.say") == "api_req_started", F.lit(False)))
    )
    text = variant_at("msg", "$.text")
    payload = F.when(kind_of(text) == "STRING", F.try_parse_json(text_at("msg", "$.text"))).otherwise(text)
    opened = messages.select(*kept, "msg", F.explode(F.array(payload)).alias("body"))
    instant = F.timestamp_millis(finite_number(text_at("msg", "$.ts")).cast("long"))
    stored = cost_usd(text_at("body", "$.cost"))
    return (
        opened.select(
            *kept,
            instant.alias("ts"),
            F.coalesce(
                F.nullif(string_at("msg", "$.modelInfo.modelId"), F.lit("")),
                F.nullif(string_at("body", "$.model"), F.lit("")),
                F.col("tool"),
            ).alias("model"),
            token_count(text_at("body", "$.tokensIn")).alias("input_tokens"),
            token_count(text_at("body", "$.tokensOut")).alias("output_tokens"),
            token_count(text_at("body", "$.cacheWrites")).alias("cache_creation_tokens"),
            token_count(text_at("body", "$.cacheReads")).alias("cache_read_tokens"),
            F.when(stored > 0, to_micro(stored)).alias("stored_micro"),
        )
        .filter(plausible_instant("ts", now))
        .filter(total_tokens() > 0)
        .withColumn("date", local_day("ts", offset_minutes))
    )


def read_tasks(spark: SparkSession, paths: str | Sequence[str], now: Column | datetime,
               offset_minutes: int = 0) -> DataFrame:
    docs = read_documents(spark, paths, "ui_messages.json").withColumn("tool", tool_of_path())
    return parse_tasks(docs.filter("tool IS NOT NULL"), now, offset_minutes)
