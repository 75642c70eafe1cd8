"""Rollout logs: cumulative token events, turn contexts, tool calls and rate limits."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import epoch_to_ts, iso_to_ts, local_day, plausible_instant, token_count
from ..functions.limits import classify_windows
from ..operators.ordered import Scan, scan
from .lines import file_stem, kind_of, open_lines, parse_lines, read_lines, string_at, string_of, text_at, variant_at

# Pinned parse schema; VARIANT where the JSON type decides.
_COUNTS = "input_tokens:string,cached_input_tokens:string,output_tokens:string,reasoning_output_tokens:string,total_tokens:string"
RECORD_SCHEMA = f"""struct<timestamp:string,type:string,payload:struct<type:string,id:variant,model:variant,name:variant,
    forked_from_id:variant,parent_thread_id:variant,source:variant,{_COUNTS},
    info:struct<total_token_usage:struct<{_COUNTS}>,last_token_usage:struct<{_COUNTS}>>>>"""
NUMBER_KIND = r"^(BIGINT|DOUBLE|DECIMAL|FLOAT)"


def parse_rollout(lines: DataFrame, now: Column | datetime, offset_minutes: Column | int = 0) -> DataFrame:
    """One row per rollout record that later steps use. Columns not asked for cost nothing.

    ``input``/``cached``/``output`` are the cumulative counters (``has_total`` tells a real token event),
    ``turn_tokens`` the last turn's tokens (NULL when the event carries none), ``call_name`` the tool called.
    """
    kept = [c for c in lines.columns if c != "value"]
    opened = open_lines(lines, RECORD_SCHEMA, must_contain='"payload"').filter("rec.payload IS NOT NULL")
    pay = F.col("rec.payload")
    raw = opened.select(
        *kept, F.explode(F.array(iso_to_ts("rec.timestamp"))).alias("ts"), F.col("rec.type").alias("kind"), pay["type"].alias("ptype"), pay.alias("pay"))
    is_token, is_meta = F.col("ptype") == "token_count", F.col("kind") == "session_meta"
    is_context = F.col("kind").isin("session_meta", "turn_context")
    is_call = F.col("ptype").isin("function_call", "custom_tool_call", "local_shell_call")
    pay, totals = F.col("pay"), F.col("pay.info.total_token_usage")
    subagent = variant_at(pay["source"], "$.subagent")
    forked, threaded = string_of(pay["forked_from_id"]), string_of(pay["parent_thread_id"])
    parent = F.coalesce(forked, threaded, string_at(pay["source"], "$.subagent.thread_spawn.parent_thread_id"))

    def total(field: str) -> Column:
        return F.when(is_token, F.when(totals.isNotNull(), totals[field]).otherwise(pay[field]))

    no, yes = F.lit(False), F.coalesce
    last_usage = F.col("pay.info.last_token_usage")
    last = lambda field: token_count(last_usage[field])
    parts = last("input_tokens") + last("cached_input_tokens") + last("output_tokens") + last("reasoning_output_tokens")
    shell = F.when(F.col("ptype") == "local_shell_call", F.lit("local_shell"))
    in_context = yes(is_context, no)
    return raw.select(
        *kept, "ts",
        F.when(plausible_instant("ts", now), local_day("ts", offset_minutes)).alias("event_day"),
        yes(is_meta, no).alias("is_meta"),
        F.when(is_meta, string_of(pay["id"])).alias("session_id"),
        F.when(is_meta, parent).alias("parent_id"),
        (yes(is_meta, no) & (forked.isNotNull() | threaded.isNotNull() | subagent.isNotNull())).alias("is_fork"),
        F.when(is_context, F.nullif(string_of(pay["model"]), F.lit(""))).alias("model"),
        (yes(is_token, no) & (total("input_tokens").isNotNull() | total("output_tokens").isNotNull())).alias("has_total"),
        token_count(total("input_tokens")).alias("input"),
        token_count(total("cached_input_tokens")).alias("cached"),
        token_count(total("output_tokens")).alias("output"),
        F.when(yes(is_token, no) & ~in_context & last_usage.isNotNull(),
               F.when(last("total_tokens") > 0, last("total_tokens")).otherwise(parts)).alias("turn_tokens"),
        F.nullif(F.substring(F.when(yes(is_call, no) & ~in_context, F.coalesce(string_of(pay["name"]), shell)), 1, 128), F.lit("")).alias("call_name"),
    )


def read_rollout(spark: SparkSession, paths: str | Sequence[str], now: Column | datetime,
                 offset_minutes: int = 0) -> DataFrame:
    return parse_rollout(read_lines(spark, paths), now, offset_minutes)


def rollout_meta(events: DataFrame) -> DataFrame:
    """One row per rollout file: its id, its parent, and the last model named. The first meta decides."""
    place = F.struct("chunk", "ord")
    per_file = events.groupBy("file").agg(
        F.min_by(F.struct("session_id", "parent_id", "is_fork"), F.when(F.col("is_meta"), place)).alias("head"),
        F.max_by("model", F.when(F.col("model").isNotNull(), place)).alias("model"),
    )
    return per_file.select(
        "file",
        F.coalesce("head.session_id", file_stem("file")).alias("session_id"),
        F.col("head.parent_id").alias("parent_id"),
        F.coalesce("head.is_fork", F.lit(False)).alias("is_fork"),
        F.coalesce("model", F.lit("unknown")).alias("model"),
    )


def token_events(events: DataFrame) -> DataFrame:
    """Cumulative token events numbered 1, 2, … inside their file (``k``), each with its ``day``: its own, or the
    last known one of the file (NULL before any)."""
    tokens = events.filter("has_total").select("file", "chunk", "ord", "event_day", "input", "cached", "output")
    return scan(tokens, ["file"], "chunk", ["ord"], [Scan("sum", F.lit(1), "k"), Scan("last", F.col("event_day"), "day")])


def prefer_live(files: DataFrame) -> DataFrame:
    """``files(file, root_rank)`` without archived copies: the lowest root rank wins per base name."""
    ranked = files.withColumn("base", F.regexp_extract("file", r"([^/]+)$", 1))
    winners = ranked.groupBy("base").agg(
        F.min_by(F.struct("file", "root_rank"), F.struct("root_rank", "file")).alias("w")
    )
    return winners.select("w.file", "w.root_rank")


def _reset(window: str, event_ts: Column) -> Column:
    """Absolute ISO text, else epoch seconds or milliseconds, else the event instant plus relative seconds."""
    raw = variant_at("limits", f"$.{window}.resets_at")
    absolute = F.when(kind_of(raw) == "STRING", iso_to_ts(text_at("limits", f"$.{window}.resets_at"))).when(
        kind_of(raw).rlike(NUMBER_KIND), epoch_to_ts(text_at("limits", f"$.{window}.resets_at"))
    )
    return F.coalesce(absolute, relative_reset(event_ts, number_at("limits", f"$.{window}.resets_in_seconds")))


def relative_reset(event_ts: Column, seconds: Column) -> Column:
    return F.timestamp_micros((F.unix_micros(event_ts) + F.round(seconds * 1e6)).cast("long"))


def number_at(rec: Column | str, path: str) -> Column:
    """The value at ``path`` only when it is a JSON number."""
    return F.when(kind_of(variant_at(rec, path)).rlike(NUMBER_KIND), F.try_variant_get(rec, path, "double"))


def parse_limits(lines: DataFrame) -> DataFrame:
    """Rate-limit samples of rollout lines, with the session and weekly windows told apart."""
    kept = [c for c in lines.columns if c != "value"]
    parsed = parse_lines(lines, must_contain='"rate_limits"')
    direct = variant_at("rec", "$.payload.rate_limits")
    nested = variant_at("rec", "$.payload.info.rate_limits")
    found = parsed.select(
        *kept,
        iso_to_ts(string_at("rec", "$.timestamp")).alias("captured_at"),
        F.coalesce(F.when(kind_of(direct) != "VOID", direct), nested).alias("limits"),
    ).filter(is_struct("limits"))

    def window(name: str) -> Column:
        percent = number_at("limits", f"$.{name}.used_percent")
        minutes = number_at("limits", f"$.{name}.window_minutes")
        reset = _reset(name, F.col("captured_at"))
        return F.when(
            percent.isNotNull() | minutes.isNotNull() | reset.isNotNull(),
            F.struct(percent.alias("used_percent"), minutes.alias("window_minutes"), reset.alias("resets_at")),
        )

    raw = found.select(
        *kept, "captured_at",
        string_at("limits", "$.plan_type").alias("plan_type"),
        string_at("limits", "$.limit_id").alias("limit_id"),
        window("primary").alias("p"),
        window("secondary").alias("s"),
        string_at("limits", "$.credits.balance").alias("credits_balance"),
        F.try_variant_get("limits", "$.credits.has_credits", "boolean").alias("has_credits"),
        F.try_variant_get("limits", "$.credits.unlimited", "boolean").alias("unlimited"),
    )
    session, weekly = classify_windows(F.col("p"), F.col("s"))
    return raw.select(
        *kept, "captured_at", "plan_type", "limit_id",
        session.alias("session"), weekly.alias("weekly"), "credits_balance", "has_credits", "unlimited",
    )


def is_struct(name: str) -> Column:
    return F.coalesce(kind_of(F.col(name)).startswith("OBJECT"), F.lit(False))


def read_rollout_limits(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return parse_limits(read_lines(spark, paths))
