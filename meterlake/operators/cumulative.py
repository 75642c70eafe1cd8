"""Rollouts: replayed prefixes, and cumulative counters to per-day usage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import materialize
from .ordered import carry_last

COUNTERS = ("input", "cached", "output")


def carry_day(events: DataFrame) -> DataFrame:
    """Adds ``day``: the event's own day, or the last known one of its file; events before any day are dropped."""
    carried = carry_last(events, ["file"], "chunk", ["ord"], F.col("event_day"), "day")
    return carried.filter("day IS NOT NULL")


def orphan_forks(meta: DataFrame) -> DataFrame:
    """Forked rollouts whose parent is unknown or not among the files: they publish nothing."""
    forks = meta.filter("is_fork")
    known = meta.select(F.col("session_id").alias("parent_id")).distinct()
    return forks.filter("parent_id IS NULL").unionByName(
        forks.filter("parent_id IS NOT NULL").join(known, "parent_id", "left_anti")
    )


def mark_replay(tokens: DataFrame, meta: DataFrame) -> DataFrame:
    """Adds ``replayed``: the event repeats the parent's event at the same position, up to the first difference.

    ``tokens(file, k, input, cached, output, …)``, ``meta(file, session_id, parent_id, is_fork)``.
    A fork of a fork is compared with its parent's raw stream. The join key holds the position, so a
    popular parent spreads over tasks; the prefix end is a plain ``min``.
    """
    forks = meta.filter("is_fork AND parent_id IS NOT NULL").select("file", "parent_id")
    # several files may carry one session id; the first name stands for it
    owners = meta.groupBy(F.col("session_id").alias("parent_id")).agg(F.min("file").alias("parent_file"))
    # forks per parent are few columns wide: resolve the parent's file first, then meet its events
    links = forks.join(owners, "parent_id").select("file", "parent_file")
    child = tokens.join(links, "file").select("file", "parent_file", "k", F.struct(*COUNTERS).alias("c"))
    parent = tokens.select(F.col("file").alias("parent_file"), "k", F.struct(*COUNTERS).alias("p"))
    compared = child.join(parent, ["parent_file", "k"], "left")
    ends = compared.groupBy("file").agg(
        F.min(F.when(~F.col("c").eqNullSafe(F.col("p")), F.col("k"))).alias("first_own"), F.lit(True).alias("linked"),
    )
    return (
        tokens.join(ends, "file", "left")
        .withColumn(
            "replayed",
            F.coalesce(F.col("linked"), F.lit(False)) & (F.col("first_own").isNull() | (F.col("k") < F.col("first_own"))),
        )
        .drop("first_own", "linked")
    )


def strip_replay(tokens: DataFrame, meta: DataFrame) -> DataFrame:
    """Marked events of every rollout that may publish: orphan forks are left out."""
    orphans = orphan_forks(meta).select("file")
    return mark_replay(tokens, meta).join(orphans, "file", "left_anti")


def cumulative_to_daily(events: DataFrame, keys: Sequence[str] = ("file",), order: Sequence[str] = ("chunk", "ord")) -> DataFrame:
    """Per-day usage of cumulative counters ``(keys, day, input, cached, output[, replayed])``.

    A day's value is its last counters minus those of the previous active day, never below 0, also
    after a reset. Replayed events only give the base of the first own day. Days without usage are
    dropped after they served as a base. The raw rows are folded by aggregates; the window runs over days.
    """
    if "replayed" not in events.columns:
        events = events.withColumn("replayed", F.lit(False))
    last = F.struct(*[F.col(c).alias(f"at_{c}") for c in order])
    counters = F.struct(*COUNTERS)
    own = events.filter("NOT replayed").groupBy(*keys, "day").agg(
        F.max_by(counters, last).alias("now"), F.count(F.lit(1)).alias("turns")
    )
    base = events.filter("replayed").groupBy(*keys).agg(F.max_by(counters, last).alias("base"))
    by_day = W.partitionBy(*keys).orderBy("day")
    days = own.join(base, list(keys), "left").withColumn("before", F.coalesce(F.lag("now").over(by_day), F.col("base")))

    def grown(field: str):
        return F.greatest(F.col(f"now.{field}") - F.coalesce(F.col(f"before.{field}"), F.lit(0)), F.lit(0))

    read = F.least(grown("cached"), grown("input"))
    return days.select(
        *keys, F.col("day").alias("date"),
        (grown("input") - read).cast("long").alias("input_tokens"),
        grown("output").cast("long").alias("output_tokens"),
        F.lit(0).cast("long").alias("cache_creation_tokens"),
        read.cast("long").alias("cache_read_tokens"),
        "turns",
    ).filter("input_tokens + output_tokens + cache_read_tokens > 0")


def session_days(tokens: DataFrame, meta: DataFrame) -> DataFrame:
    """Per-day records of all rollouts, replay removed, each with its file's last model.

    ``tokens(file, chunk, ord, k, day, input, cached, output)``, ``meta(file, session_id, parent_id, is_fork, model)``.
    """
    usable = strip_replay(tokens, meta).filter("day IS NOT NULL")
    return cumulative_to_daily(usable).join(meta.select("file", "session_id", "model"), "file", "left")


def rollout_days(events: DataFrame) -> DataFrame:
    """``session_days`` of parsed rollout records.

    The raw text is read and parsed once: the few columns and rows needed later (token events and
    context lines) are written to the shared checkpoint folder, and every later pass reads those.
    """
    from ..sources.rollouts import rollout_meta, token_events

    narrow = materialize(
        events.filter("has_total OR is_meta OR model IS NOT NULL").select(
            "file", "chunk", "ord", "event_day", "has_total", "input", "cached", "output", "is_meta", "session_id",
            "parent_id", "is_fork", "model"))
    numbered = materialize(token_events(narrow))
    return session_days(numbered, rollout_meta(narrow))


def replay_candidate_dates(tokens: DataFrame, meta: DataFrame) -> DataFrame:
    """Days seen in forked rollouts."""
    forks = meta.filter("is_fork").select("file")
    return tokens.filter("day IS NOT NULL").join(forks, "file", "left_semi").select(F.col("day").alias("date")).distinct()
