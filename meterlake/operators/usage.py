"""Daily usage from request records, and the choice between readers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import TOKEN_COLUMNS, micro_cost, round_half_up_micro, total_tokens
from .pricing import attach_cost, with_rates


def nonzero_usage(df: DataFrame, with_cost: bool = True) -> DataFrame:
    keep = total_tokens() > 0
    return df.filter(keep | (F.col("cost_micro") > 0)) if with_cost else df.filter(keep)


def force_origin(df: DataFrame) -> DataFrame:
    return df.withColumn("origin", F.lit("cli")).withColumn("verified", F.lit(False))


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in TOKEN_COLUMNS]


def daily_usage(requests: DataFrame, resolved: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Day and model buckets of deduped requests; only requests with a real id are counted. Priced on the bucket."""
    buckets = requests.groupBy(*keys, "date", "model").agg(
        *_sums(), F.sum(F.when(F.col("has_real_id"), 1).otherwise(0)).alias("request_count")
    )
    return attach_cost(nonzero_usage(buckets, with_cost=False), resolved)


def rollout_daily(days: DataFrame, resolved: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    buckets = days.groupBy(*keys, "date", "model").agg(*_sums(), F.sum("turns").alias("request_count"))
    return attach_cost(buckets, resolved)


def priced_per_request(requests: DataFrame, resolved: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Day and model buckets whose cost is the sum of per-request costs, each rounded to micro-USD.

    A ``stored_micro`` column, where present and set, stands in for the estimate.
    """
    priced = with_rates(requests, resolved)
    estimate = micro_cost()
    cost = F.coalesce(F.col("stored_micro"), estimate) if "stored_micro" in requests.columns else estimate
    buckets = priced.withColumn("cost_micro", cost).groupBy(*keys, "date", "model").agg(
        *_sums(), F.sum("cost_micro").alias("cost_micro"), F.count(F.lit(1)).alias("request_count")
    )
    return nonzero_usage(buckets, with_cost=False)


def task_daily(requests: DataFrame, resolved: DataFrame, keys: tuple[str, ...] = ("tool",)) -> DataFrame:
    return priced_per_request(requests, resolved, keys)


def generation_daily(requests: DataFrame, resolved: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return priced_per_request(requests, resolved, keys)


def page_daily(events: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Day and model buckets of paged events; cost to 4 decimals."""
    return events.groupBy(*keys, "date", "model").agg(
        *_sums(), round_half_up_micro(F.sum("cost_micro"), 4).alias("cost_micro")
    )


def hour_blocks(events: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """UTC-hour blocks of priced events; cost to 4 decimals."""
    return events.groupBy(*keys, F.date_trunc("hour", "ts").alias("start_time")).agg(
        F.sum(total_tokens()).alias("total_tokens"), round_half_up_micro(F.sum("cost_micro"), 4).alias("cost_micro")
    )


def split_cost(df: DataFrame, day_keys: list[str]) -> DataFrame:
    """Adds ``cost_micro``: the row's part of ``day_micro`` by its tokens among the day's; 0 on empty days.

    The day total is aggregated and joined back, so a day with very many rows needs no single-task window.
    """
    totals = df.groupBy(*day_keys).agg(F.sum(total_tokens()).alias("day_tokens"))
    exact = (
        F.col("day_micro").cast("decimal(18,0)") * total_tokens().cast("decimal(18,0)")
        / F.col("day_tokens").cast("decimal(18,0)")
    )
    cost = F.when(F.col("day_tokens") > 0, F.round(exact, 0)).otherwise(F.lit(0)).cast("long")
    return df.join(totals, day_keys).withColumn("cost_micro", cost).drop("day_tokens", "day_micro")


def union_sources(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def select_source(native: DataFrame, fallback: DataFrame, replay_source: str = "codex") -> DataFrame:
    """Native rows where the native reader found any for (account, source), else the fallback rows.

    The replay-aware source always takes the fallback rows. Both frames have ``handle`` and ``tool``.
    """
    usable = native.filter(F.col("tool") != replay_source)
    won = usable.select("handle", "tool").distinct()
    return usable.unionByName(fallback.join(won, ["handle", "tool"], "left_anti"), allowMissingColumns=True)


def merge_tiers(fast: DataFrame, slow: DataFrame, run_status: DataFrame) -> DataFrame:
    """Rows of the newest successful run per (account, tool), even when that run was empty.

    ``run_status(handle, tool, tier, finished_at, succeeded)`` tells an empty success from a failure.
    """
    newest = run_status.filter("succeeded").groupBy("handle", "tool").agg(
        F.max_by("tier", F.struct("finished_at", "tier")).alias("tier")
    )
    rows = fast.withColumn("tier", F.lit("fast")).unionByName(slow.withColumn("tier", F.lit("slow")), allowMissingColumns=True)
    return rows.join(newest, ["handle", "tool", "tier"], "left_semi").drop("tier")


def distinct_tools(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.union(b), [f.select("tool") for f in frames]).distinct()
