"""Tool, skill and agent rollups of transcript and rollout records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .ordered import carry_last, running_sum


def tool_calls(events: DataFrame) -> DataFrame:
    """One row per tool call; the record's tokens are split evenly over its calls, rounded down."""
    kept = [c for c in events.columns if c not in ("calls", "errors")]
    return (
        events.filter(F.size("calls") > 0)
        .withColumn("call_tokens", F.floor(F.col("tokens") / F.size("calls")).cast("long"))
        .select(*kept, "call_tokens", F.posexplode("calls").alias("pos", "call"))
        .select(*kept, "call_tokens", "pos", F.col("call.name").alias("name"), F.col("call.call_id").alias("call_id"))
    )


def tool_errors(calls: DataFrame, results: DataFrame, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """Errored results with the name of the latest earlier call of the same id in the same file.

    ``calls(keys, chunk, ord, pos, call_id, name)``, ``results(keys, chunk, ord, call_id)``. Results without an
    earlier call are dropped. Calls and results of one id are merged in order and the name is carried forward,
    which stays linear when one id is reused very often.
    """
    made = calls.filter("call_id IS NOT NULL").select(
        *keys, "call_id", "chunk", "ord", F.col("pos").cast("int").alias("pos"), "name", F.lit(False).alias("is_result"))
    failed = results.select(
        *keys, "call_id", "chunk", "ord", F.lit(0).alias("pos"), F.lit(None).cast("string").alias("name"),
        F.lit(True).alias("is_result"))
    both = made.unionByName(failed)
    named = carry_last(both, [*keys, "call_id"], "chunk", ["ord", "pos"], F.col("name"), "called")
    return named.filter("is_result AND called IS NOT NULL").select(*keys, F.col("called").alias("name"))


def tool_stats(events: DataFrame, groups: tuple[str, ...] = (), file_keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """Calls, errors and tokens per tool. ``groups`` are extra columns constant within a file.

    Several passes follow, so the few parsed columns are written once and the raw text is not parsed again.
    """
    keys = tuple(dict.fromkeys([*groups, *file_keys]))
    used = materialize(events.filter("size(calls) > 0 OR size(errors) > 0").select(*keys, "chunk", "ord", "tokens", "calls", "errors"), "calls")
    calls = tool_calls(used)
    results = used.select(*keys, "chunk", "ord", F.explode("errors").alias("call_id"))
    errors = tool_errors(calls, results, keys).groupBy(*groups, "name").agg(F.count(F.lit(1)).alias("errors"))
    counted = calls.groupBy(*groups, "name").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("call_tokens").alias("tokens")
    )
    joined = counted.join(errors, [*groups, "name"], "left")
    return joined.select(*groups, "name", "calls", F.coalesce("errors", F.lit(0)).cast("long").alias("errors"), "tokens")


def turn_id(events: DataFrame, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """Adds ``turn``: token events before the row in its file, so calls share the turn of the next token event.

    ``turn_tokens`` is set on token events that carry a turn's usage.
    """
    closing = F.when(F.col("turn_tokens").isNotNull(), 1).otherwise(0)
    return running_sum(events, list(keys), "chunk", ["ord"], closing, "turn", include_current=False)


def rollout_tool_stats(events: DataFrame, groups: tuple[str, ...] = (), file_keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """Calls and tokens per tool of rollouts: a turn's tokens split over the calls since the last token event.

    Calls that no token event closes, or that a zero-token event closes, get none.
    """
    keys = tuple(dict.fromkeys([*groups, *file_keys]))
    used = materialize(events.filter("call_name IS NOT NULL OR turn_tokens IS NOT NULL")
                       .select(*keys, "chunk", "ord", "call_name", "turn_tokens"), "turns")
    placed = turn_id(used, keys)
    per_tool = placed.filter("call_name IS NOT NULL").groupBy(*keys, "turn", F.col("call_name").alias("name")).agg(
        F.count(F.lit(1)).alias("calls")
    )
    turns = placed.groupBy(*keys, "turn").agg(
        F.max("turn_tokens").alias("turn_tokens"), F.count("call_name").alias("turn_calls")
    ).filter("turn_calls > 0")
    shared = per_tool.join(turns, [*keys, "turn"])
    each = F.floor(F.coalesce("turn_tokens", F.lit(0)) / F.col("turn_calls")).cast("long")
    return shared.groupBy(*groups, "name").agg(
        F.sum("calls").alias("calls"), F.sum(F.col("calls") * each).alias("tokens")
    )


def rollout_agent(events: DataFrame, groups: tuple[str, ...] = ()) -> DataFrame:
    """Each rollout turn with tokens is one message; rollouts have no subagents."""
    return events.filter("turn_tokens > 0").groupBy(*groups).agg(
        F.count(F.lit(1)).alias("messages"), F.sum("turn_tokens").alias("total_tokens")
    )


def skill_stats(events: DataFrame, groups: tuple[str, ...] = ()) -> DataFrame:
    return events.filter("skill IS NOT NULL").groupBy(*groups, F.col("skill").alias("name")).agg(
        F.count(F.lit(1)).alias("records"), F.sum("tokens").alias("tokens")
    )


def agent_rollup(events: DataFrame, groups: tuple[str, ...] = ()) -> DataFrame:
    """Messages, subagent messages and tokens, total tokens, human prompts. Not deduped by request."""
    side = F.col("is_message") & F.col("is_sidechain")

    def count_if(test):
        return F.sum(F.when(test, 1).otherwise(0))

    def tokens_if(test):
        return F.sum(F.when(test, F.col("tokens")).otherwise(0))

    return events.groupBy(*groups).agg(
        count_if(F.col("is_message")).alias("messages"),
        count_if(side).alias("subagent_messages"),
        tokens_if(side).alias("subagent_tokens"),
        tokens_if(F.col("is_message")).alias("total_tokens"),
        count_if(F.col("is_human_prompt")).alias("user_messages"),
    )


def session_messages(events: DataFrame, groups: tuple[str, ...] = ()) -> DataFrame:
    return events.filter("is_message AND session_id IS NOT NULL").groupBy(*groups, "session_id").agg(
        F.count(F.lit(1)).alias("message_count")
    )


def attach_message_counts(sessions: DataFrame, counts: DataFrame, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Sessions with their assistant messages; a missing or zero count stays NULL."""
    known = counts.filter("message_count > 0").select(*keys, "message_count")
    return sessions.join(known, list(keys), "left")


def merge_rollups(df: DataFrame, keys: tuple[str, ...], measures: tuple[str, ...]) -> DataFrame:
    """Per-file rollups added up: every measure is additive."""
    return df.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])


def top_stats(df: DataFrame, groups: tuple[str, ...] = (), n: int = 300, calls: str = "calls") -> DataFrame:
    """The ``n`` rows with most tokens, then most calls, per group; rows without a call are dropped."""
    from .reports import top_per_group

    return top_per_group(df.filter(F.col(calls) > 0), list(groups), [F.desc("tokens"), F.desc(calls), F.asc("name")], n)
