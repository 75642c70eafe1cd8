"""The four duplicate rules: largest wins, last wins, sum, newest wins.

All are grouped aggregates with map-side combine, so a key copied over a third of the rows
is folded before the shuffle instead of being sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import TOKEN_COLUMNS, total_tokens


def pick_one(df: DataFrame, keys: Sequence[str], best: Column) -> DataFrame:
    """The row with the smallest ``best`` per key, all columns kept."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), best).alias("__row")).select(*keys, "__row.*").select(*df.columns)


def _rank(first: Sequence[str], alias: str | None = None) -> Column:
    prefix = f"{alias}." if alias else ""
    return F.struct((-total_tokens(alias)).alias("less"), *[F.col(prefix + c) for c in first])


def dedupe_requests(df: DataFrame, keys: Sequence[str] = ("key",), first: Sequence[str] = ("file", "chunk", "ord")) -> DataFrame:
    """One row per request: most total tokens, on a tie the first seen."""
    return pick_one(df, keys, _rank(first))


def merge_deduped(old: DataFrame, new: DataFrame, name: str, key: str = "key", first: Sequence[str] = ("file", "chunk", "ord")) -> DataFrame:
    """``dedupe_requests`` of two tables that hold each request once; the flag ``name`` tells the requests of ``new``.

    One merge join: nothing is folded before the shuffle, for nothing can be, and no group is built.
    """
    a, b = old.alias("old"), new.alias("new")
    met = a.join(b.hint("merge"), F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer")
    fresh = F.col(f"new.{key}").isNotNull()
    wins = fresh & (F.col(f"old.{key}").isNull() | (_rank(first, "new") < _rank(first, "old")))
    return met.select(*[F.when(wins, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in new.columns], fresh.alias(name))


def dedupe_sessions(df: DataFrame, keys: Sequence[str] = ("session_id",), order: str = "ord") -> DataFrame:
    """One row per session: most total tokens, on a tie the last seen."""
    return pick_one(df, keys, F.struct((-total_tokens()).alias("less"), (-F.col(order)).alias("later")))


def merge_daily(df: DataFrame, keys: Sequence[str] = ("date", "tool", "model", "origin")) -> DataFrame:
    """Rows with the same key summed. ``verified`` holds only if all do; a request count is NULL only if all are."""
    return df.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in TOKEN_COLUMNS],
        F.sum("cost_micro").alias("cost_micro"),
        F.bool_and("verified").alias("verified"),
        F.sum("request_count").alias("request_count"),
    )


def merge_blocks(df: DataFrame, keys: Sequence[str] = ("start_time",)) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum("total_tokens").alias("total_tokens"), F.sum("cost_micro").alias("cost_micro"))
