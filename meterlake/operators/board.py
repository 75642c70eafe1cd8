"""Leaderboards, ranks, streaks and board neighbourhoods."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import TOKEN_COLUMNS, total_tokens
from ..session import materialize
from .ordered import previous, rank_desc
from .reports import as_day, day_series, tokens_sum

# Days covered by each period, None for all of them.
PERIOD_DAYS = {"today": 1, "7d": 7, "30d": 30, "all": None}
METRICS = {"tokens": "tokens", "cost": "cost_micro"}


def in_period(df: DataFrame, period: str, today: Column | date | str, start: str | None = None, end: str | None = None,
              tool: str | None = None) -> DataFrame:
    """Rows of a period ending today, or of an inclusive from–to range, which wins over the period.

    Plain comparisons on ``date``, so a table partitioned by date is pruned.
    """
    if start or end:
        if start:
            df = df.filter(F.col("date") >= as_day(start))
        if end:
            df = df.filter(F.col("date") <= as_day(end))
    elif PERIOD_DAYS[period] is not None:
        day = as_day(today)
        df = df.filter(F.col("date").between(F.date_sub(day, PERIOD_DAYS[period] - 1), day))
    return df.filter(F.col("tool") == tool) if tool else df


def eligible(df: DataFrame, accounts: DataFrame, held_days: DataFrame) -> DataFrame:
    """Usage of listed accounts that are neither suppressed nor quarantined, without days held for approval.

    ``accounts(handle, listed, suppressed, quarantined)``, ``held_days(handle, date)``.
    """
    shown = accounts.filter("listed AND NOT suppressed AND NOT quarantined").select("handle")
    return df.join(shown, "handle", "left_semi").join(held_days.select("handle", "date"), ["handle", "date"], "left_anti")


def in_window(df: DataFrame, org: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usage inside each organisation's inclusive event window, organisations with a reversed window).

    ``df(org, date, …)``, ``org(org, start_date, end_date)`` with NULL for an open end.
    """
    fine = F.col("start_date").isNull() | F.col("end_date").isNull() | (F.col("end_date") >= F.col("start_date"))
    valid = org.filter(fine).select("org", "start_date", "end_date")
    inside = (F.col("start_date").isNull() | (F.col("date") >= F.col("start_date"))) & (
        F.col("end_date").isNull() | (F.col("date") <= F.col("end_date")))
    return df.join(valid, "org").filter(inside).drop("start_date", "end_date"), org.filter(~fine)


def members_only(df: DataFrame, membership: DataFrame, scope: str) -> DataFrame:
    return df.join(membership.filter(F.col("org") == scope).select("handle"), "handle", "left_semi")


def domain_members(users: DataFrame, orgs: DataFrame) -> DataFrame:
    """(org, handle) joined by verified mail domain. ``users(handle, email)``, ``orgs(org, allow_domain_join, email_domains)``."""
    domains = orgs.filter("allow_domain_join").select("org", F.explode("email_domains").alias("domain")).select(
        "org", F.lower("domain").alias("domain"))
    found = users.select("handle", F.lower(F.split_part("email", F.lit("@"), F.lit(-1))).alias("domain"))
    return found.join(domains, "domain").select("org", "handle").distinct()


def per_account(df: DataFrame) -> DataFrame:
    return df.groupBy("handle").agg(tokens_sum().alias("tokens"), F.sum("cost_micro").alias("cost_micro"))


def leaderboard(df: DataFrame, period: str = "7d", metric: str = "tokens", today: Column | date | str = None,
                start: str | None = None, end: str | None = None, tool: str | None = None) -> DataFrame:
    """Accounts with usage in the period, ranked by tokens or cost; equal values share a rank."""
    totals = per_account(in_period(df, period, today, start, end, tool)).filter(F.col(METRICS[metric]) > 0)
    return rank_desc(totals, METRICS[metric]).select("rank", "handle", "tokens", "cost_micro")


def board_rows(df: DataFrame, period: str, metric: str, today: Column | date | str) -> DataFrame:
    """Leaderboard rows with today's tokens, streak, top tool, top model and the seven-day series.

    Usage is folded once to (account, day, tool, model); every column is built from that.
    """
    folded = df.groupBy("handle", "date", "tool", "model").agg(
        *[F.sum(c).alias(c) for c in TOKEN_COLUMNS], F.sum("cost_micro").alias("cost_micro"))
    board = leaderboard(folded, period, metric, today)
    window = in_period(folded, period, today)

    def heaviest(column: str, name: str) -> DataFrame:
        sums = window.groupBy("handle", column).agg(tokens_sum().alias("t"))
        return sums.groupBy("handle").agg(F.min_by(column, F.struct((-F.col("t")).alias("less"), column)).alias(name))

    zero = F.lit(0).cast("long")
    day = folded.filter(F.col("date") == as_day(today)).groupBy("handle").agg(tokens_sum().alias("today_tokens"))
    return (
        board.join(day, "handle", "left")
        .join(current_streak(folded, today), "handle", "left")
        .join(heaviest("tool", "top_tool"), "handle", "left")
        .join(heaviest("model", "top_model"), "handle", "left")
        .join(spark7d(folded, today), "handle", "left")
        .withColumn("today_tokens", F.coalesce("today_tokens", zero))
        .withColumn("streak_days", F.coalesce("streak_days", zero))
    )


def rank_all(df: DataFrame, today: Column | date | str, metric: str = "tokens") -> DataFrame:
    """All-time, weekly and daily rank per account; NULL where the account has no usage in the window."""
    value = METRICS[metric]
    source = total_tokens() if metric == "tokens" else F.col("cost_micro")
    day = as_day(today)
    windows = {"all_time": F.lit(True), "weekly": F.col("date").between(F.date_sub(day, 6), day), "daily": F.col("date") == day}
    totals = materialize(df.groupBy("handle").agg(*[F.sum(F.when(test, source).otherwise(0)).alias(f"{n}_{value}") for n, test in windows.items()]), "totals")
    out = totals
    for name in windows:
        used = totals.filter(F.col(f"{name}_{value}") > 0).select("handle", F.col(f"{name}_{value}").alias("v"))
        out = out.join(rank_desc(used, "v", f"{name}_rank").select("handle", f"{name}_rank"), "handle", "left")
    return out


def rank_movement(now_ranks: DataFrame, snapshots: DataFrame, hours: int, now: Column) -> DataFrame:
    """Movement against the newest snapshot bucket at least ``hours`` old. ``snapshots(bucket, handle, rank)``."""
    old = snapshots.filter(F.col("bucket") <= now - F.make_dt_interval(F.lit(0), F.lit(hours)))
    compared = old.join(old.agg(F.max("bucket").alias("bucket")), "bucket", "left_semi")
    before = compared.select("handle", F.col("rank").alias("previous_rank"), F.col("bucket").alias("compared_at"))
    gap = F.col("previous_rank") - F.col("rank")
    return now_ranks.select("handle", "rank").join(before, "handle", "left").select(
        "handle", "rank", "previous_rank", "compared_at",
        F.when(gap.isNull(), "new").when(gap > 0, "up").when(gap < 0, "down").otherwise("same").alias("direction"),
        F.coalesce(F.abs(gap), F.lit(0)).cast("long").alias("places"))


def context_rows(board: DataFrame, handle: str, n: int = 5) -> DataFrame:
    """Top two rows, the account, then its nearest rows (better side first) up to ``n``; unknown: the top ``n``.

    Handles are told apart without case. Only bounded top lists are taken, so no window spans the board.
    """
    if n <= 0:
        return board.limit(0)
    # one row per handle, the best placed
    rest = [c for c in board.columns]
    ranked = board.groupBy(F.lower("handle").alias("__id")).agg(
        F.min_by(F.struct(*rest), F.struct("rank", "handle")).alias("r")).select("__id", "r.*")
    ranked = materialize(ranked, "board")  # five looks at it follow
    own = ranked.filter(F.col("__id") == handle.lower()).select(F.struct("rank", "handle").alias("__at"))
    place = F.struct("rank", "handle")
    at = own.select("__at").scalar()
    head = ranked.orderBy("rank", "handle").limit(n)
    above = ranked.filter(place < at).orderBy(F.desc("rank"), F.desc("handle")).limit(n)
    below = ranked.filter(place > at).orderBy("rank", "handle").limit(n)
    # at most 3n + 1 rows are left: priorities can be numbered in one small window each
    down, up = W.orderBy(F.desc("rank"), F.desc("handle")), W.orderBy("rank", "handle")
    known = at.isNotNull()
    first = head.withColumn("__p", F.row_number().over(up)).withColumn(
        "__p", F.when(~known, F.col("__p")).when(F.col("__p") <= 2, F.col("__p")).otherwise(F.lit(10_000_000)))
    me = ranked.filter(F.col("__id") == handle.lower()).withColumn("__p", F.lit(3))
    better = above.withColumn("__p", F.row_number().over(down) * 2 + 2)
    worse = below.withColumn("__p", F.row_number().over(up) * 2 + 3)
    few = first.unionByName(me).unionByName(better).unionByName(worse).groupBy("__id").agg(
        F.min("__p").alias("__p"), F.min_by(F.struct(*rest), "__p").alias("r"))
    return few.orderBy("__p").limit(n).select("r.*").orderBy("rank", "handle")


def daily_leader(board: DataFrame) -> DataFrame:
    """The row with most tokens today, above zero; ties go to the better rank."""
    return board.filter("today_tokens > 0").orderBy(F.desc("today_tokens"), "rank", "handle").limit(1)


def _islands(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs of consecutive active days. The window sorts days of an account, never its raw rows."""
    days = df.filter(total_tokens() > 0).select(*keys, "date").distinct()
    numbered = days.withColumn("n", F.row_number().over(W.partitionBy(*keys).orderBy("date")))
    return numbered.groupBy(*keys, F.date_sub("date", F.col("n")).alias("island")).agg(
        F.count(F.lit(1)).alias("days"), F.max("date").alias("last_day"))


def current_streak(df: DataFrame, today: Column | date | str, keys: Sequence[str] = ("handle",)) -> DataFrame:
    """Consecutive active days ending today; accounts without one are absent."""
    runs = _islands(df, keys)
    return runs.filter(F.col("last_day") == as_day(today)).select(*keys, F.col("days").alias("streak_days"))


def longest_streak(df: DataFrame, keys: Sequence[str] = ("handle",)) -> DataFrame:
    return _islands(df, keys).groupBy(*keys).agg(F.max("days").alias("longest_streak_days"))


def spark7d(df: DataFrame, today: Column | date | str, days: int = 7) -> DataFrame:
    """The last seven day totals per account, oldest first."""
    series = day_series(df, days, today, ["handle"])
    return series.groupBy("handle").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("date", "tokens"))), lambda s: s["tokens"]).alias("spark7d"))


def overtaken(ranks: DataFrame, chunk: Column) -> DataFrame:
    """Observations whose daily rank is worse than the one before. ``ranks(handle, observed_at, daily_rank)``."""
    placed = previous(ranks.withColumn("__chunk", chunk), ["handle"], "__chunk", ["observed_at"], F.col("daily_rank"), "previous_rank")
    return placed.filter(F.col("daily_rank") > F.col("previous_rank")).select("handle", "observed_at", "previous_rank", "daily_rank")


def last_grew(totals: DataFrame, chunk: Column) -> DataFrame:
    """When the token total of an account last rose. ``totals(handle, observed_at, total)``."""
    placed = previous(totals.withColumn("__chunk", chunk), ["handle"], "__chunk", ["observed_at"], F.col("total"), "before")
    return placed.groupBy("handle").agg(F.max(F.when(F.col("total") > F.col("before"), F.col("observed_at"))).alias("last_grew"))
