"""JSON Lines transcripts with per-message usage: request records and attribution records."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import iso_to_ts, local_day, plausible_instant, token_count
from ..functions.labels import is_human_text, session_label
from .lines import PLACE, file_stem, is_true, open_lines, parent_folder, read_lines, string_at, string_of, true_at

# Pinned parse schemas; VARIANT where the JSON type decides.
_USAGE = """struct<input_tokens:string,output_tokens:string,cache_creation_input_tokens:string,
    cache_read_input_tokens:string>"""
REQUEST_SCHEMA = f"struct<timestamp:string,requestId:variant,message:struct<id:variant,role:variant,model:variant,usage:{_USAGE}>>"
RECORD_SCHEMA = f"""struct<type:string,isSidechain:variant,isMeta:variant,sessionId:variant,attributionSkill:variant,
    message:struct<role:string,content:variant,usage:{_USAGE}>>"""
USAGE_FIELDS = {
    "input_tokens": "input_tokens",
    "output_tokens": "output_tokens",
    "cache_creation_tokens": "cache_creation_input_tokens",
    "cache_read_tokens": "cache_read_input_tokens",
}


def _counts(source: str) -> list[Column]:
    return [token_count(f"{source}.{field}").alias(name) for name, field in USAGE_FIELDS.items()]


def parse_requests(lines: DataFrame, now: Column | datetime, offset_minutes: Column | int = 0) -> DataFrame:
    """Request records of transcript lines, before dedupe. Extra columns of ``lines`` are kept.

    A line counts when ``message.usage`` is an object, the role is absent or ``assistant`` and the
    instant is plausible. Lines with neither id get a key of their own and never merge.
    """
    kept = [c for c in lines.columns if c != "value"]
    opened = open_lines(lines, REQUEST_SCHEMA, must_contain='"usage"')
    role = F.col("rec.message.role")
    usable = opened.filter(F.col("rec.message.usage").isNotNull() & (role.isNull() | (string_of(role) == "assistant")))
    timed = usable.select(
        *kept, F.col("rec.message.usage").alias("usage"),
        string_of("rec.message.id").alias("message_id"), string_of("rec.requestId").alias("request_id"),
        string_of("rec.message.model").alias("model"),
        F.explode(F.array(iso_to_ts("rec.timestamp"))).alias("ts"),
    )
    message_id, request_id = F.coalesce("message_id", F.lit("")), F.coalesce("request_id", F.lit(""))
    real = (message_id != "") | (request_id != "")
    synthetic = F.concat_ws("|", F.lit("synthetic"), *[F.col(c).cast("string") for c in PLACE])
    return timed.filter(plausible_instant("ts", now)).select(
        *kept, "ts",
        F.coalesce("model", F.lit("unknown")).alias("model"),
        *_counts("usage"),
        real.alias("has_real_id"),
        F.when(real, F.concat_ws("|", message_id, request_id)).otherwise(synthetic).alias("key"),
        local_day("ts", offset_minutes).alias("date"),
    )


def read_requests(spark: SparkSession, paths: str | Sequence[str], now: Column | datetime,
                  offset_minutes: int = 0) -> DataFrame:
    return parse_requests(read_lines(spark, paths), now, offset_minutes)


def parse_attribution(lines: DataFrame) -> DataFrame:
    """One row per transcript record with its role flags, tokens, tool calls and errored call ids.

    ``calls`` is an array of (name, call_id), ``errors`` an array of call ids; both empty unless the
    content is an array and the role fits. Nothing of the content itself is kept.
    """
    kept = [c for c in lines.columns if c != "value"]
    opened = open_lines(lines, RECORD_SCHEMA).filter("rec IS NOT NULL")
    false = F.lit(False)
    says = lambda who: F.coalesce(F.col("rec.type") == who, false) | F.coalesce(F.col("rec.message.role") == who, false)
    content = F.col("rec.message.content")
    base = opened.select(
        *kept, says("assistant").alias("is_assistant"), says("user").alias("is_user"),
        is_true("rec.isSidechain").alias("is_sidechain"), is_true("rec.isMeta").alias("is_meta"),
        F.nullif(string_of("rec.sessionId"), F.lit("")).alias("session_id"),
        F.substring(F.nullif(string_of("rec.attributionSkill"), F.lit("")), 1, 128).alias("skill"),
        *_counts("rec.message.usage"),
        F.explode(F.array(F.try_variant_get(content, "$", "array<variant>"))).alias("blocks"),
        content.alias("content"),
    ).withColumn("plain", F.when(F.col("blocks").isNull(), string_of("content")))

    def block_text(b: Column, field: str) -> Column:
        return string_at(b, f"$.{field}")

    calls = F.filter(
        F.transform(
            F.filter("blocks", lambda b: block_text(b, "type") == "tool_use"),
            lambda b: F.struct(
                F.substring(block_text(b, "name"), 1, 128).alias("name"), block_text(b, "id").alias("call_id")
            ),
        ),
        lambda c: F.length(c["name"]) > 0,
    )
    errors = F.filter(
        F.transform(
            F.filter("blocks", lambda b: (block_text(b, "type") == "tool_result") & true_at(b, "$.is_error")),
            lambda b: block_text(b, "tool_use_id"),
        ),
        lambda i: i.isNotNull(),
    )
    said = F.when(
        F.col("blocks").isNotNull(),
        F.exists(
            "blocks",
            lambda b: F.coalesce((block_text(b, "type") == "text") & is_human_text(block_text(b, "text")), false),
        ),
    ).otherwise(is_human_text(F.col("plain")))
    none_called = F.array().cast("array<struct<name:string,call_id:string>>")
    none_failed = F.array().cast("array<string>")
    has_blocks = F.col("blocks").isNotNull()
    return base.select(
        *kept,
        "is_assistant", "is_sidechain", "session_id", "skill",
        (F.col("is_user") & ~F.col("is_assistant")).alias("is_user"),
        (F.col("is_user") & ~F.col("is_sidechain") & ~F.col("is_meta") & said).alias("is_human_prompt"),
        (F.col("input_tokens") + F.col("output_tokens") + F.col("cache_creation_tokens")
         + F.col("cache_read_tokens")).alias("tokens"),
        (F.col("is_assistant") & has_blocks).alias("is_message"),
        F.when(F.col("is_assistant") & has_blocks, calls).otherwise(none_called).alias("calls"),
        F.when(~F.col("is_assistant") & F.col("is_user") & has_blocks, errors).otherwise(none_failed).alias("errors"),
    )


def read_attribution(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return parse_attribution(read_lines(spark, paths))


def session_labels(files: DataFrame) -> DataFrame:
    """(session_id, label) of transcript paths: file stem, and the last two parts of the folder name."""
    return files.select(
        file_stem("file").alias("session_id"), session_label(parent_folder("file")).alias("label")
    ).distinct()
