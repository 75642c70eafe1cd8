"""Report tables over daily usage: totals, windows, day series, top lists, insights, organisations."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import TOKEN_COLUMNS, instant, local_day, round_half_up_micro, share_of, total_tokens
from ..functions.labels import dateless_key, machine_label, model_key, request_hash, session_name, strip
from ..session import materialize
from .ordered import _band

# row_number() <= n is cut before the shuffle by Spark itself up to this n
PUSHED_LIMIT = 1000
# rows of a cut band that one task ranks, and such tasks whose best rows the next one ranks
CUT_ROWS = 50_000
CUT_FAN = 8


def as_day(value: Column | date | str) -> Column:
    if isinstance(value, Column):
        return value
    return F.lit(str(value)).cast("date")


def tokens_sum() -> Column:
    return F.sum(total_tokens())


def top_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows per group in ``order``, for ``n`` up to ``PUSHED_LIMIT``: Spark limits each map task before the shuffle."""
    if not groups:
        return df.orderBy(*order).limit(n)
    place = F.row_number().over(W.partitionBy(*groups).orderBy(*order))
    return df.withColumn("__n", place).filter(F.col("__n") <= n).drop("__n")


def above_cut(df: DataFrame, groups: Sequence[str], value: str, ties: Sequence[Column], n: int, rows: int = CUT_ROWS, fan: int = CUT_FAN) -> DataFrame:
    """The ``n`` rows of each group with the largest whole number ``value``, equal ones in the order of ``ties``. Exact.

    A histogram of each group over bands of values tells where its ``n``-th row lies. Rows of higher bands are taken without
    a sort; only those of the cut band are ranked, a band of many rows in parts of about ``rows`` whose best rows meet
    ``fan`` parts at a time. So no task grows with a group, also where many rows have the same value.
    """
    keys = [f"__g{i}" for i in range(len(groups))]
    banded = df.withColumn("__band", _band(F.coalesce(value, F.lit(-(2**62))), 256))
    down = (W.partitionBy(*groups) if groups else W).orderBy(F.desc("__band")).rowsBetween(W.unboundedPreceding, -1)
    counts = banded.groupBy(*groups, "__band").agg(F.count(F.lit(1)).alias("__rows"))
    # bands follow the range of the values, so a group has few
    reached = counts.withColumn("__above", F.coalesce(F.sum("__rows").over(down), F.lit(0))).filter(F.col("__above") < n)
    reached = materialize(reached.select(*[F.col(g).alias(k) for g, k in zip(groups, keys)], F.col("__band").alias("__b"), "__rows", "__above"), "bands")
    same = F.col("__band") == F.col("__b")
    for g, k in zip(groups, keys):
        same = same & F.col(g).eqNullSafe(F.col(k))
    placed = banded.join(reached, same)
    whole = placed.filter(F.col("__above") + F.col("__rows") <= n)
    cut = placed.filter(F.col("__above") + F.col("__rows") > n)
    parts = F.ceil(F.col("__rows") / F.lit(rows))
    cut = cut.withColumn("__part", F.pmod(F.xxhash64(*ties), parts))
    most = reached.filter(F.col("__above") + F.col("__rows") > n).agg(F.max(parts)).first()[0] or 1
    order = [F.desc(value), *ties]
    while True:
        best = F.row_number().over(W.partitionBy(*groups, "__part").orderBy(*order))
        cut = cut.withColumn("__n", best).filter(F.col("__n") <= n - F.col("__above"))
        if most <= 1:
            return whole.select(*df.columns).unionByName(cut.select(*df.columns))
        most = -(-most // fan)
        cut = cut.withColumn("__part", F.floor(F.col("__part") / fan) if most > 1 else F.lit(0).cast("long"))


def cap_by_tokens(df: DataFrame, n: int, by: Sequence[str], ties: Sequence[str], tokens: Column | None = None) -> DataFrame:
    """The ``n`` rows with most tokens per submission; ``ties`` order equal rows."""
    ranked = df.withColumn("__tokens", total_tokens() if tokens is None else tokens)
    order = [F.asc(c) for c in ties]
    if n <= PUSHED_LIMIT:
        return top_per_group(ranked, by, [F.desc("__tokens"), *order], n).drop("__tokens")
    return above_cut(ranked, by, "__tokens", [F.col(c) for c in ties], n).drop("__tokens")


def totals_by(df: DataFrame, dims: Sequence[str] = ("tool", "model", "date")) -> DataFrame:
    """Totals by each dimension and overall in one pass: (dimension, name, tokens, cost_micro, active_days)."""
    cast = df.select(*[F.col(d).cast("string").alias(d) for d in dims], F.col("date").alias("__day"),
                     total_tokens().alias("tokens"), "cost_micro")
    sets = [[F.col(d)] for d in dims] + [[]]
    grouped = cast.groupingSets(sets, *[F.col(d) for d in dims]).agg(
        F.grouping_id().alias("gid"), F.sum("tokens").alias("tokens"), F.sum("cost_micro").alias("cost_micro"),
        F.count_distinct("__day").alias("active_days"),
    )
    full = 2 ** len(dims) - 1
    dimension, name = F.lit("all"), F.lit("")
    for i, d in enumerate(dims):
        here = F.col("gid") == full - 2 ** (len(dims) - 1 - i)
        dimension = F.when(here, F.lit(d)).otherwise(dimension)
        name = F.when(here, F.col(d)).otherwise(name)
    return grouped.select(
        dimension.alias("dimension"), name.alias("name"), "tokens", "cost_micro", "active_days",
        F.try_divide(F.col("tokens").cast("double"), F.col("active_days").cast("double")).alias("tokens_per_active_day"),
    )


def token_mix(df: DataFrame) -> DataFrame:
    """Sum and share of the four token kinds, one row each; shares are 0 without tokens."""
    sums = df.agg(*[F.sum(c).alias(c) for c in TOKEN_COLUMNS]).withColumn("whole", total_tokens())
    pairs = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("tokens")) for c in TOKEN_COLUMNS])
    return sums.select("whole", F.inline(pairs)).select("kind", "tokens", share_of(F.col("tokens"), F.col("whole")).alias("share"))


def _in_last(days: int, today: Column) -> Column:
    return F.col("date").between(F.date_sub(today, days - 1), today)


def summary(df: DataFrame, today: Column | date | str, keys: Sequence[str] = ("handle",)) -> DataFrame:
    """Tokens and cost of today, the last 7 and the last 14 days per account, in one pass. Costs to cents."""
    day = as_day(today)
    windows = {"today": F.col("date") == day, "week": _in_last(7, day), "fortnight": _in_last(14, day)}
    recent = df.filter(_in_last(14, day))
    aggs = []
    for name, test in windows.items():
        aggs.append(F.sum(F.when(test, total_tokens()).otherwise(0)).alias(f"{name}_tokens"))
        aggs.append(round_half_up_micro(F.sum(F.when(test, F.col("cost_micro")).otherwise(0)), 2).alias(f"{name}_cost_micro"))
    return recent.groupBy(*keys).agg(*aggs)


def summary_by_tool(df: DataFrame, today: Column | date | str, keys: Sequence[str] = ("handle",)) -> DataFrame:
    return summary(df.withColumn("tool", machine_label("tool", "agent", 64)), today, [*keys, "tool"])


def day_series(df: DataFrame, n: int, today: Column | date | str, keys: Sequence[str] = ()) -> DataFrame:
    """The last ``n`` days per account, zero-filled, ascending by date."""
    day = as_day(today)
    window = df.filter(F.col("date").between(F.date_sub(day, n - 1), day))
    sums = window.groupBy(*keys, "date").agg(
        tokens_sum().alias("tokens"), F.sum("cost_micro").alias("cost_micro")
    )
    spine = F.explode(F.sequence(F.date_sub(day, n - 1), day, F.expr("interval 1 day"))).alias("date")
    if keys:
        days = df.select(*keys).distinct().select(*keys, spine)
    else:
        days = df.sparkSession.range(1).select(spine)
    zero = F.lit(0).cast("long")
    return days.join(sums, [*keys, "date"], "left").select(
        *keys, "date", F.coalesce("tokens", zero).alias("tokens"), F.coalesce("cost_micro", zero).alias("cost_micro")
    )


def tools_found(df: DataFrame, n: int = 32) -> DataFrame:
    return df.select(machine_label("tool", "agent", 64).alias("tool")).distinct().orderBy("tool").limit(n)


def top_models_today(df: DataFrame, today: Column | date | str, n: int = 5, keys: Sequence[str] = ("handle",)) -> DataFrame:
    sums = df.filter(F.col("date") == as_day(today)).groupBy(*keys, machine_label("model", "model", 128).alias("model")).agg(
        tokens_sum().alias("tokens"))
    return top_per_group(sums, keys, [F.desc("tokens"), F.asc("model")], n)


def top_models(df: DataFrame, n: int = 12) -> DataFrame:
    sums = df.groupBy("model").agg(tokens_sum().alias("tokens"), F.sum("cost_micro").alias("cost_micro"))
    return sums.orderBy(F.desc("tokens"), "model").limit(n)


def top_sessions_today(sessions: DataFrame, today: Column | date | str, n: int = 5, keys: Sequence[str] = ("handle",),
                       label: str | None = None) -> DataFrame:
    """The sessions active today with most tokens, per account. ``sessions(…, session_id, last_day, tool)``."""
    live = sessions.filter(F.col("last_day") == as_day(today)).withColumn("tokens", total_tokens())
    top = top_per_group(live, keys, [F.desc("tokens"), F.asc("session_id")], n)
    return top.select(*keys, "session_id", session_name("session_id", label).alias("name"),
                      machine_label("tool", "agent", 64).alias("tool"), "tokens")


def top_cost_sessions(sessions: DataFrame, n: int, keys: Sequence[str] = ()) -> DataFrame:
    return top_per_group(sessions, list(keys), [F.desc("cost_micro"), F.asc("session_id")], n)


def attach_labels(sessions: DataFrame, labels: DataFrame) -> DataFrame:
    named = labels.groupBy("session_id").agg(F.min("label").alias("label"))
    return sessions.join(named, "session_id", "left").withColumn("name", session_name("session_id", "label"))


def _combos(df: DataFrame) -> DataFrame:
    """Usage folded to (normalised model, raw model, tool, developer): one shuffle that every insight reuses."""
    return df.withColumn("norm_model", dateless_key(model_key("model"))).groupBy("norm_model", "model", "tool", "handle").agg(
        *[F.sum(c).alias(c) for c in TOKEN_COLUMNS], F.sum("cost_micro").alias("cost_micro")
    )


def _developers(approx: bool) -> Column:
    return F.approx_count_distinct("handle") if approx else F.count_distinct("handle")


def insights_models(df: DataFrame, approx: bool = False) -> DataFrame:
    """Per normalised model: tokens, share, cost, developers, raw variants and tools, heaviest first."""
    combos = _combos(df)
    sums = combos.groupBy("norm_model").agg(
        *[F.sum(c).alias(c) for c in TOKEN_COLUMNS], F.sum("cost_micro").alias("cost_micro"), _developers(approx).alias("devs")
    ).withColumn("tokens", total_tokens())
    variants = combos.groupBy("norm_model", "model").agg(F.lit(1).alias("x")).groupBy("norm_model").agg(
        F.sort_array(F.collect_list("model")).alias("variants"))
    tools = combos.groupBy("norm_model", "tool").agg(tokens_sum().alias("t")).groupBy("norm_model").agg(
        F.transform(F.sort_array(F.collect_list(F.struct((-F.col("t")).alias("less"), "tool"))), lambda s: s["tool"]).alias("tools"))
    whole = combos.agg(tokens_sum()).scalar()
    return (
        sums.join(variants, "norm_model").join(tools, "norm_model")
        .withColumn("share", share_of(F.col("tokens"), whole))
    )


def insights_tools(df: DataFrame, approx: bool = False) -> DataFrame:
    """Per tool: tokens, share, cost, developers and its heaviest normalised model."""
    combos = _combos(df)
    sums = combos.groupBy("tool").agg(
        tokens_sum().alias("tokens"), F.sum("cost_micro").alias("cost_micro"), _developers(approx).alias("devs"))
    top = combos.groupBy("tool", "norm_model").agg(tokens_sum().alias("t")).groupBy("tool").agg(
        F.min_by("norm_model", F.struct((-F.col("t")).alias("less"), "norm_model")).alias("top_model"))
    whole = combos.agg(tokens_sum()).scalar()
    return sums.join(top, "tool").withColumn("share", share_of(F.col("tokens"), whole))


def with_share(df: DataFrame, column: str, name: str = "share") -> DataFrame:
    """Adds each row's share of the table's total of ``column``."""
    return df.withColumn(name, share_of(F.col(column), df.agg(F.sum(column)).scalar()))


def trend(df: DataFrame, top_k: int, today: Column | date | str, days: int = 30) -> DataFrame:
    """The last ``days`` days, zero-filled: total tokens, and tokens by model for the window's top models."""
    day = as_day(today)
    window = df.filter(_in_last(days, day)).withColumn("norm_model", dateless_key(model_key("model")))
    cells = window.groupBy("date", "norm_model").agg(tokens_sum().alias("tokens"))
    top = cells.groupBy("norm_model").agg(F.sum("tokens").alias("t")).orderBy(F.desc("t"), "norm_model").limit(top_k)
    totals = cells.groupBy("date").agg(F.sum("tokens").alias("total_tokens"))
    by_model = cells.join(top, "norm_model", "left_semi").groupBy("date").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("norm_model", "tokens")))).alias("by_model"))
    spine = df.sparkSession.range(1).select(
        F.explode(F.sequence(F.date_sub(day, days - 1), day, F.expr("interval 1 day"))).alias("date"))
    return spine.join(totals, "date", "left").join(by_model, "date", "left").select(
        "date", F.coalesce("total_tokens", F.lit(0).cast("long")).alias("total_tokens"),
        F.coalesce("by_model", F.create_map().cast("map<string,bigint>")).alias("by_model"))


def trend_cells(df: DataFrame, top_k: int, today: Column | date | str, days: int = 30) -> DataFrame:
    """``trend`` as one row per day and top model."""
    return trend(df, top_k, today, days).select("date", F.explode("by_model").alias("model", "tokens"))


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    newest = snapshots.groupBy("handle").agg(F.max("snapshot_at").alias("snapshot_at"))
    return snapshots.join(newest, ["handle", "snapshot_at"], "left_semi")


def stat_popularity(snapshots: DataFrame) -> DataFrame:
    """Per tool call or skill name: calls, tokens, errors, developers, from each account's latest snapshot."""
    return latest_snapshots(snapshots).groupBy("name").agg(
        F.sum("calls").alias("calls"), F.sum("tokens").alias("tokens"), F.sum("errors").alias("errors"),
        F.count_distinct("handle").alias("devs"))


def pace(df: DataFrame, now: Column | datetime, offset_minutes: Column | int = 0, days: int = 30,
         keys: Sequence[str] = ("handle",)) -> DataFrame:
    """Today so far, projected day end, and averages per active day of the ``days`` days before today.

    Our formula: projection = today ÷ elapsed fraction of the local day.
    """
    at = instant(now)
    today = local_day(at, offset_minutes)
    shift = offset_minutes if isinstance(offset_minutes, Column) else F.lit(offset_minutes)
    seconds = F.pmod(F.unix_seconds(at) + shift * 60, F.lit(86_400))
    window = df.filter(F.col("date").between(F.date_sub(today, days), today))
    is_today = F.col("date") == today
    per_day = window.groupBy(*keys, "date").agg(tokens_sum().alias("tokens"), F.sum("cost_micro").alias("cost"))
    grouped = per_day.groupBy(*keys).agg(
        F.sum(F.when(is_today, F.col("tokens")).otherwise(0)).alias("today_tokens"),
        F.sum(F.when(is_today, F.col("cost")).otherwise(0)).alias("today_cost_micro"),
        F.sum(F.when(~is_today, F.col("tokens")).otherwise(0)).alias("past_tokens"),
        F.sum(F.when(~is_today, F.col("cost")).otherwise(0)).alias("past_cost"),
        F.sum(F.when(~is_today, 1).otherwise(0)).alias("past_days"),
    )
    average = lambda c: F.coalesce(F.floor(F.try_divide(F.col(c), F.col("past_days"))), F.lit(0)).cast("long")
    return grouped.select(
        *keys, "today_tokens", "today_cost_micro",
        F.floor(F.col("today_cost_micro") * 86_400 / F.greatest(seconds, F.lit(1))).cast("long").alias("projected_cost_micro"),
        average("past_tokens").alias("avg_daily_tokens"), average("past_cost").alias("avg_daily_cost_micro"))


def subagent_share(agents: DataFrame) -> DataFrame:
    return agents.withColumn("subagent_share", share_of(F.col("subagent_tokens"), F.col("total_tokens")))


def cost_per_message(daily: DataFrame, agents: DataFrame) -> DataFrame:
    """Average micro-USD per human message per account; NULL without messages."""
    cost = daily.groupBy("handle").agg(F.sum("cost_micro").alias("cost_micro"))
    people = agents.groupBy("handle").agg(F.sum("user_messages").alias("user_messages"))
    return cost.join(people, "handle", "left").withColumn(
        "micro_per_message", F.floor(F.col("cost_micro") / F.nullif("user_messages", F.lit(0))).cast("long"))


def hourly_24(blocks: DataFrame, day: Column | date | str, keys: Sequence[str] = ()) -> DataFrame:
    """Tokens and cost by UTC hour of ``day``, always 24 rows per account. ``blocks(…, start_time, total_tokens, cost_micro)``."""
    of_day = blocks.filter(F.to_date("start_time") == as_day(day))
    sums = of_day.groupBy(*keys, F.hour("start_time").alias("hour")).agg(
        F.sum("total_tokens").alias("tokens"), F.sum("cost_micro").alias("cost_micro"))
    hours = F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour")
    spine = blocks.select(*keys).distinct().select(*keys, hours) if keys else blocks.sparkSession.range(1).select(hours)
    zero = F.lit(0).cast("long")
    return spine.join(sums, [*keys, "hour"], "left").select(
        *keys, "hour", F.coalesce("tokens", zero).alias("tokens"), F.coalesce("cost_micro", zero).alias("cost_micro"))


def org_analytics(df: DataFrame, membership: DataFrame) -> DataFrame:
    """Per organisation: members, active members, adoption, tokens and cost. ``membership(org, handle)``."""
    per_user = df.groupBy("handle").agg(tokens_sum().alias("tokens"), F.sum("cost_micro").alias("cost_micro"))
    members = membership.select("org", "handle").distinct()
    zero = F.lit(0).cast("long")
    return members.join(per_user, "handle", "left").groupBy("org").agg(
        F.count(F.lit(1)).alias("members"),
        F.count("tokens").alias("active_members"),
        F.coalesce(F.sum("tokens"), zero).alias("tokens"),
        F.coalesce(F.sum("cost_micro"), zero).alias("cost_micro"),
    ).withColumn("adoption", share_of(F.col("active_members"), F.col("members")))


def org_trend(df: DataFrame, membership: DataFrame, today: Column | date | str, days: int = 30) -> DataFrame:
    """Daily tokens and cost of each organisation, zero-filled."""
    per_day = df.groupBy("handle", "date").agg(*[F.sum(c).alias(c) for c in TOKEN_COLUMNS], F.sum("cost_micro").alias("cost_micro"))
    owned = membership.select("org", "handle").distinct().join(per_day, "handle", "left")
    return day_series(owned, days, today, ["org"])


def org_top(df: DataFrame, membership: DataFrame, dimension: str, n: int = 5) -> DataFrame:
    """The organisation's top tools, models or members (``dimension`` is tool, model or handle) by tokens."""
    keys = list(dict.fromkeys(["handle", dimension]))
    per = df.groupBy(*keys).agg(tokens_sum().alias("tokens"))
    joined = membership.select("org", "handle").distinct().join(per, "handle")
    sums = joined.groupBy("org", F.col(dimension).alias("name")).agg(F.sum("tokens").alias("tokens"))
    return top_per_group(sums, ["org"], [F.desc("tokens"), F.asc("name")], n)


def suppress_small(df: DataFrame, k: int, private: Column | None = None) -> DataFrame:
    """Hides totals of private groups with fewer than ``k`` members: zeroed and flagged."""
    hidden = (F.col("members") < k) & (F.lit(True) if private is None else private)
    return df.withColumn("aggregates_hidden", hidden).withColumn(
        "tokens", F.when(hidden, 0).otherwise(F.col("tokens")).cast("long")
    ).withColumn("cost_micro", F.when(hidden, 0).otherwise(F.col("cost_micro")).cast("long"))


def verify_export(requests: DataFrame, cap: int = 50_000, keys: Sequence[str] = (), tool: str = "claude") -> DataFrame:
    """The newest ``cap`` requests per upload (``keys``), content-free, with hashed ids, and whether any were cut."""
    if keys and cap > PUSHED_LIMIT:
        newest = above_cut(requests.withColumn("__ts", F.unix_micros("ts")), list(keys), "__ts", [F.col("key")], cap).drop("__ts")
    else:
        newest = top_per_group(requests, list(keys), [F.desc("ts"), F.asc("key")], cap)
    counts = requests.groupBy(*keys).agg((F.count(F.lit(1)) > cap).alias("truncated"))
    flagged = newest.join(counts, list(keys)) if keys else newest.withColumn("truncated", counts.scalar())
    model = F.substring(strip("model"), 1, 128)
    return flagged.select(
        *keys, "date", F.unix_millis("ts").alias("ts_ms"), F.lit(tool).alias("tool"),
        F.coalesce(F.nullif(model, F.lit("")), F.lit("unknown")).alias("model"),
        *TOKEN_COLUMNS, request_hash("key").alias("req_hash"), "truncated")


def stale_devices(syncs: DataFrame, now: Column | datetime, interval_minutes: int = 15) -> DataFrame:
    """Last sync per device; stale after two missed intervals or when none was recorded."""
    at = instant(now)
    last = syncs.groupBy("device_id").agg(F.max("synced_at").alias("last_sync"))
    late = F.unix_seconds(at) - F.unix_seconds("last_sync") > interval_minutes * 120
    return last.withColumn("stale", F.coalesce(late, F.lit(True)))


def digest(today_summary: DataFrame, ranks: DataFrame, digest_hour: Column | int, now: Column | datetime,
           sent: DataFrame, offset_minutes: Column | int = 0) -> DataFrame:
    """Daily digest rows due now: local hour reached, and not sent today. ``sent(handle, day)``."""
    at = instant(now)
    day = local_day(at, offset_minutes)
    shift = offset_minutes if isinstance(offset_minutes, Column) else F.lit(offset_minutes)
    hour = F.floor(F.pmod(F.unix_seconds(at) + shift * 60, F.lit(86_400)) / 3600)
    due_hour = digest_hour if isinstance(digest_hour, Column) else F.lit(digest_hour)
    due = today_summary.withColumn("day", day).filter(hour >= due_hour)
    return due.join(sent, ["handle", "day"], "left_anti").join(ranks.select("handle", "daily_rank"), "handle", "left").select(
        "handle", "day", F.col("today_tokens").alias("tokens"), F.col("today_cost_micro").alias("cost_micro"), "daily_rank")
