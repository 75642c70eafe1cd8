"""Plausibility checks: request density, rollup ratios, request forensics, moderation reasons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import TOKEN_COLUMNS, total_tokens
from .ordered import previous, time_chunk

# Moderation categories with the phrases that name them, first match wins.
REASON_PHRASES = (
    ("rollup_mismatch", ("cross-tool session rollup", "its own rollups", "possible inflation")),
    ("no_provenance", ("no rollups", "no request fingerprints", "carries no provenance", "no provenance",
                       "must emit provenance")),
    ("near_ceiling", ("sustained near-ceiling", "fabricated drip")),
    ("volume_spike", ("extreme high-volume", "anomalous spike", "prior peak", "typical day")),
    ("cost_floor", ("cost floor", "fabricated cost", "below any real model")),
    ("round_number", ("round-number", "suspiciously round")),
    ("history_rewrite", ("history rewrite", "retroactively inflated", "back-dated")),
    ("manual", ("admin", "manual")),
)


def request_density(daily: DataFrame, min_tokens: int, max_tokens_per_request: int) -> DataFrame:
    """Large token days per (account, day, tool) with far too few requests. NULL counts are never flagged."""
    per_day = daily.groupBy("handle", "date", "tool").agg(
        F.sum(total_tokens()).alias("tokens"), F.sum("request_count").alias("requests"))
    sparse = F.col("requests").isNotNull() & (F.col("tokens") >= min_tokens) & (
        F.col("tokens") > F.col("requests") * max_tokens_per_request)
    return per_day.withColumn("flagged", F.coalesce(sparse, F.lit(False)))


def rollup_ratio(daily: DataFrame, sessions: DataFrame, max_ratio: float) -> DataFrame:
    """Daily tokens ÷ session tokens per account, and whether the ratio is over the limit."""
    d = daily.groupBy("handle").agg(F.sum(total_tokens()).alias("daily_tokens"))
    s = sessions.groupBy("handle").agg(F.sum(total_tokens()).alias("session_tokens"))
    ratio = F.try_divide(F.col("daily_tokens").cast("double"), F.col("session_tokens").cast("double"))
    return d.join(s, "handle", "left").withColumn("ratio", ratio).withColumn(
        "flagged", F.coalesce(F.col("ratio") > max_ratio, F.lit(False)))


def request_checks(requests: DataFrame, limits: dict[str, float], keys: Sequence[str] = ("handle",)) -> DataFrame:
    """Named checks per account with the number of offending rows: (check, bad, ok).

    ``limits``: ``tokens_per_second`` between consecutive requests, ``requests_per_day``,
    ``same_instant`` (share-free count of requests at the instant of the one before), ``total_tokens`` per request.
    """
    ordered = previous(requests.withColumn("__chunk", time_chunk("ts")), list(keys), "__chunk", ["ts", "key"],
                       F.unix_millis("ts"), "before_ms")
    gap = (F.unix_millis("ts") - F.col("before_ms")).cast("double") / 1000
    negative = F.lit(False)
    for c in TOKEN_COLUMNS:
        negative = negative | (F.col(c) < 0)
    too_fast = (gap > 0) & (total_tokens() / gap > limits["tokens_per_second"])

    def bad(test):
        return F.sum(F.when(test, 1).otherwise(0))

    per_request = ordered.groupBy(*keys).agg(
        bad(negative | (total_tokens() > limits["total_tokens"])).alias("token_fields"),
        bad(F.coalesce(too_fast, F.lit(False))).alias("throughput"),
        bad(F.coalesce(gap == 0, F.lit(False))).alias("timing"),
    )
    per_day = requests.groupBy(*keys, "date").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(
        bad(F.col("n") > limits["requests_per_day"]).alias("density"))
    checks = F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("bad")) for n in ("token_fields", "throughput", "timing", "density")])
    allowed = F.when(F.col("check") == "timing", F.lit(limits["same_instant"])).otherwise(F.lit(0))
    return per_request.join(per_day, list(keys)).select(*keys, F.inline(checks)).withColumn("ok", F.col("bad") <= allowed)


def reason_category(reason: str = "reason"):
    """The category of a raw moderation reason; ``other`` when nothing matches or there is none."""
    text = F.lower(F.coalesce(F.col(reason), F.lit("")))
    category = F.lit("other")
    for name, phrases in reversed(REASON_PHRASES):
        found = F.lit(False)
        for phrase in phrases:
            found = found | text.contains(phrase)
        category = F.when(found, F.lit(name)).otherwise(category)
    return category


def moderation_rollup(df: DataFrame) -> DataFrame:
    """Counts per category and state. ``df(reason, state)``."""
    return df.groupBy(reason_category().alias("category"), "state").agg(F.count(F.lit(1)).alias("cases"))
