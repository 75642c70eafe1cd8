"""State between runs: upserts, no-shrink rollups, last-good counts and scope corrections.

``runs(handle, complete)`` tells full from partial runs, for every account at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import TOKEN_COLUMNS, total_tokens
from ..session import materialize

DAILY_KEY = ("handle", "date", "tool", "model", "origin")


def upsert_daily(current: DataFrame, incoming: DataFrame, keys: Sequence[str] = DAILY_KEY) -> DataFrame:
    """Current rows with the incoming ones in place of those with the same key."""
    return current.join(incoming.select(*keys), list(keys), "left_anti").unionByName(incoming, allowMissingColumns=True)


def merge_rollup(current: DataFrame, incoming: DataFrame, keys: Sequence[str], measures: Sequence[str],
                 complete: Column | bool) -> DataFrame:
    """A full snapshot replaces the stored rollup; a partial one may raise a measure but never lower it.

    ``complete`` may be a column of ``incoming``. Rows only stored go when the snapshot is a full one
    given as ``True``; with a column they stay, for the account sent nothing about them.
    """
    whole = complete if isinstance(complete, Column) else F.lit(complete)
    inc = incoming.withColumn("__whole", whole).select(
        *keys, F.struct("__whole", *measures).alias("i"))
    cur = current.select(*keys, F.struct(*measures).alias("c"))
    how = "right_outer" if complete is True else "full_outer"
    both = cur.join(inc, list(keys), how)
    return both.select(*keys, *[
        F.when(F.col("i").isNull(), F.col(f"c.{m}"))
        .when(F.col("i.__whole"), F.col(f"i.{m}"))
        .otherwise(F.greatest(F.col(f"c.{m}"), F.col(f"i.{m}"))).alias(m)
        for m in measures])


def _fingerprints(daily: DataFrame) -> DataFrame:
    """Per (handle, date, tool): counted requests (NULL if no row carries one) and the heaviest model."""
    return daily.groupBy("handle", "date", "tool").agg(
        F.sum("request_count").alias("current"),
        F.min_by("model", F.struct((-total_tokens()).alias("less"), F.col("model"))).alias("heaviest"),
    )


def reconcile_requests(daily: DataFrame, provenance: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(daily rows to emit, next provenance).

    On a partial run a day and tool whose requests fall below the stored best get the deficit on their
    heaviest row; no row is invented. A full run may lower the stored value, a partial one may only raise it.
    ``provenance(handle, date, tool, best)``.
    """
    prints = _fingerprints(daily)
    deficits = (
        prints.join(provenance, ["handle", "date", "tool"])
        .join(runs.filter("NOT complete"), "handle", "left_semi")
        .withColumn("deficit", F.col("best") - F.coalesce("current", F.lit(0)))
        .filter("deficit > 0")
        .select("handle", "date", "tool", F.col("heaviest").alias("model"), "deficit")
    )
    emitted = daily.join(deficits, ["handle", "date", "tool", "model"], "left").withColumn(
        "request_count",
        F.when(F.col("deficit").isNotNull(), F.coalesce("request_count", F.lit(0)) + F.col("deficit")).otherwise(
            F.col("request_count")),
    ).drop("deficit")
    counted = prints.filter("current IS NOT NULL").join(runs, "handle").select("handle", "date", "tool", "current", "complete")
    following = provenance.join(counted, ["handle", "date", "tool"], "full_outer").select(
        "handle", "date", "tool",
        F.when(F.col("current").isNull(), F.col("best"))
        .when(F.col("complete"), F.col("current"))
        .otherwise(F.greatest("best", "current")).alias("best"),
    )
    return emitted.select(*daily.columns), following


def reconcile_agent(current: DataFrame, stored: DataFrame, runs: DataFrame, measures: Sequence[str]) -> DataFrame:
    """On a partial run the stored agent rollup stays when it has more tokens. One row per account."""
    joined = (
        current.select("handle", F.struct(*measures).alias("c"))
        .join(stored.select("handle", F.struct(*measures).alias("s")), "handle", "left")
        .join(runs, "handle", "left")
    )
    keep = ~F.coalesce("complete", F.lit(True)) & (F.col("s.total_tokens") > F.col("c.total_tokens"))
    return joined.select("handle", F.when(F.coalesce(keep, F.lit(False)), F.col("s")).otherwise(F.col("c")).alias("r")).select(
        "handle", "r.*")


def _scope_rows(df: DataFrame) -> DataFrame:
    return df.groupBy("handle", "date", "model").agg(*[F.sum(c).alias(c) for c in TOKEN_COLUMNS])


def correctable(rows: DataFrame, tool: str | None) -> Column:
    """Whether a row may be corrected: of ``tool`` (None: any), from the tool's own logs and not verified.

    A table without the column ``tool``, ``origin`` or ``verified`` holds such rows only.
    """
    rules = {"origin": F.col("origin") == "cli", "verified": ~F.coalesce("verified", F.lit(False))}
    if tool is not None:
        rules["tool"] = F.col("tool") == tool
    holds = F.lit(True)
    for column, rule in rules.items():
        if column in rows.columns:
            holds = holds & F.coalesce(rule, F.lit(False))
    return holds


def compared_scopes(left: DataFrame, right: DataFrame) -> DataFrame:
    """(handle, date, in_left, in_right, equal) of all scopes of both sides, by digests of their model rows.

    A digest is the xor of two independent 64-bit hashes of each row, so in any order; what both sides have falls out. One
    pass over the rows of both, and no day is gathered into one array.
    """
    columns = ["handle", "date", "model", *TOKEN_COLUMNS]
    both = left.select(*columns, F.lit(1).alias("side")).unionByName(right.select(*columns, F.lit(-1).alias("side")))
    rows = both.groupBy("handle", "date", "model", "side").agg(*[F.sum(c).alias(c) for c in TOKEN_COLUMNS])
    content = ["model", *TOKEN_COLUMNS]
    return rows.groupBy("handle", "date").agg(
        (F.max("side") == 1).alias("in_left"), (F.min("side") == -1).alias("in_right"),
        ((F.bit_xor(F.xxhash64(*content)) == 0) & (F.bit_xor(F.xxhash64(F.lit(1), *content)) == 0) & (F.sum("side") == 0)).alias("equal"))


def differing_scopes(left: DataFrame, right: DataFrame) -> DataFrame:
    """(handle, date) of ``left`` whose model rows differ from ``right``."""
    return compared_scopes(left, right).filter("in_left AND NOT equal").select("handle", "date")


def tombstones(candidates: DataFrame, corrected: DataFrame, run_status: DataFrame, max_dates: int | None = None) -> DataFrame:
    """Replay dates the corrected read does not have, for accounts whose reads both succeeded.

    ``max_dates`` limits an account's dates to its first ones; by default none is left out.
    """
    open_dates = candidates.select("handle", "date").join(
        run_status.filter("native_ok AND replay_ok"), "handle", "left_semi"
    ).distinct().join(corrected.select("handle", "date").distinct(), ["handle", "date"], "left_anti")
    return _first_dates(open_dates, max_dates).select("handle", "date")


def _first_dates(scopes: DataFrame, most: int | None) -> DataFrame:
    if most is None:
        return scopes
    ranked = scopes.withColumn("n", F.row_number().over(W.partitionBy("handle").orderBy("date")))
    return ranked.filter(F.col("n") <= most).drop("n")


def changed_scopes(legacy: DataFrame, corrected: DataFrame, dead: DataFrame) -> DataFrame:
    """Tombstones together with the dates whose legacy and corrected rows differ."""
    return dead.select("handle", "date").union(differing_scopes(legacy, corrected)).distinct()


def correction_proof(legacy: DataFrame, changed: DataFrame, dead: DataFrame, whole_payload: DataFrame | None = None,
                     max_models: int | None = None, max_dates: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(prior scopes as arrays, proved tombstones).

    With ``max_models`` a scope of more models gives no proof, with ``max_dates`` an account's later scopes give none;
    both are off by default. An account whose payload was capped or lost a row gives none
    either (``whole_payload`` lists the accounts that may prove).
    """
    rows = _scope_rows(legacy).join(changed, ["handle", "date"], "left_semi")
    if whole_payload is not None:
        rows = rows.join(whole_payload.select("handle"), "handle", "left_semi")
    if max_models is not None:
        small = rows.groupBy("handle", "date").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= max_models)
        rows = rows.join(small.select("handle", "date"), ["handle", "date"], "left_semi")
    scopes = (
        rows.groupBy("handle", "date")
        .agg(F.sort_array(F.collect_list(F.struct("model", *TOKEN_COLUMNS))).alias("rows"))
    )
    scopes = _first_dates(scopes, max_dates)
    proved = dead.join(scopes.select("handle", "date"), ["handle", "date"], "left_semi")
    return scopes, proved


def apply_correction(stored: DataFrame, prior: DataFrame, corrected: DataFrame, devices: DataFrame, tool: str | None = None) -> DataFrame:
    """Replaces a stored scope by the corrected rows, only where the stored rows equal the prior ones
    and the account has exactly one confirmed device.

    ``stored``, ``prior`` and ``corrected`` hold (handle, date, model, counters…), ``devices(handle, device_id, confirmed)``.
    A scope is what is ``correctable`` of an account's day; its other rows always stay.
    """
    own = "correctable_row"
    stored = stored.withColumn(own, correctable(stored, tool))
    prior, corrected = (df.filter(correctable(df, tool)) for df in (prior, corrected))
    single = devices.filter("confirmed").groupBy("handle").agg(F.count_distinct("device_id").alias("n")).filter("n = 1")
    proved = compared_scopes(prior, stored.filter(own)).filter("in_left AND equal").select("handle", "date")
    accepted = materialize(proved.join(single, "handle", "left_semi"), "accepted")
    kept = stored.join(accepted.withColumn(own, F.lit(True)), ["handle", "date", own], "left_anti").drop(own).select(*[c for c in stored.columns if c != own])
    fresh = corrected.join(accepted, ["handle", "date"], "left_semi")
    return kept.unionByName(fresh, allowMissingColumns=True)


def restate_days(table: DataFrame, batch: DataFrame, runs: DataFrame, keys: Sequence[str] = DAILY_KEY) -> DataFrame:
    """Late or restated days: a full run's rows replace the stored ones also when lower, a partial run's
    rows only where their total is at least the stored total."""
    incoming = batch.join(runs, "handle", "left").withColumn("complete", F.coalesce("complete", F.lit(False)))
    rest = [c for c in batch.columns if c not in keys]
    tokens = sum((F.col(c) for c in TOKEN_COLUMNS[1:]), F.col(TOKEN_COLUMNS[0]))
    cur = table.withColumn("__t", tokens).select(*keys, F.struct("__t", *rest).alias("c"))
    inc = incoming.withColumn("__t", tokens).select(*keys, "complete", F.struct("__t", *rest).alias("i"))
    both = cur.join(inc, list(keys), "full_outer")
    keep = F.col("i").isNull() | (F.col("c").isNotNull() & ~F.col("complete") & (F.col("c.__t") > F.col("i.__t")))
    return both.select(*keys, F.when(keep, F.col("c")).otherwise(F.col("i")).alias("r")).select(
        *keys, *[F.col(f"r.{c}").alias(c) for c in rest])
