"""Rate-limit samples: latest and last-known values, forecasts, alerts and the window meter.

Samples are ``(keys…, at, id, percent)``: ``id`` orders samples of one instant. Every step runs on
time chunks of a key (see ``ordered``), so a very busy account is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import instant
from ..functions.limits import effective_percent, future_reset
from .ordered import CHUNK_SECONDS, Scan, carry_last, earliest_within, previous, running_sum, scan, time_chunk

# Alert levels and the drop that counts as a reset.
ALERT_LEVELS = (80, 95)
RESET_DROP = 30
REARM_BELOW = 50
LOOKBACK_MINUTES = 60
LEAD_MINUTES = 30
ROLLOVER_SECONDS = 60


def finite_samples(samples: DataFrame) -> DataFrame:
    p = F.col("percent")
    return samples.filter(p.isNotNull() & ~F.isnan(p) & (F.abs(p) < float("inf")))


def latest_limit(samples: DataFrame, keys: Sequence[str] = ("handle",), captured: str = "captured_at",
                 tie: Sequence[str] = ("file", "chunk", "ord")) -> DataFrame:
    """The newest sample per account across files by capture time; a sample without one is the last resort."""
    rest = [c for c in samples.columns if c not in keys]
    order = F.struct(F.coalesce(F.unix_micros(captured), F.lit(-(2**62))).alias("t"), *tie)
    return samples.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def last_known_good(samples: DataFrame, keys: Sequence[str] = ("handle",), present: Column | None = None) -> DataFrame:
    """Each observation with the last present value: a missing read keeps what was known.

    ``samples(keys…, at, id, percent, …)``; adds ``known_percent``.
    """
    seen = F.col("percent").isNotNull() if present is None else present
    chunked = samples.withColumn("__chunk", time_chunk("at"))
    return carry_last(chunked, list(keys), "__chunk", ["at", "id"], F.when(seen, F.col("percent")), "known_percent").drop("__chunk")


def forecast_hit(samples: DataFrame, keys: Sequence[str] = ("handle",), lookback_minutes: int = LOOKBACK_MINUTES) -> DataFrame:
    """Per sample, when the line from the oldest sample of the last hour to it reaches 100 (``hit_ms``).

    NULL with one sample, or when flat or falling; the sample's own instant at 100 or more.
    """
    clean = finite_samples(samples).withColumn("at_ms", F.unix_millis("at"))
    framed = earliest_within(clean, list(keys), "at_ms", lookback_minutes * 60_000, ["at_ms", "id", "percent"], ["at_ms", "id"], "oldest")
    dt = (F.col("at_ms") - F.col("oldest.at_ms")).cast("double")
    dp = F.col("percent") - F.col("oldest.percent")
    hit = F.when(F.col("percent") >= 100, F.col("at_ms")).when(
        (dt > 0) & (dp > 0), F.floor(F.col("at_ms") + (F.lit(100.0) - F.col("percent")) / (dp / dt) + F.lit(0.5)).cast("long"))
    # a lone sample has no line, also at 100
    alone = F.col("oldest.id") == F.col("id")
    return framed.withColumn("hit_ms", F.when(~alone, hit)).drop("oldest")


def threshold_alerts(samples: DataFrame, keys: Sequence[str] = ("handle",), levels: Sequence[float] = ALERT_LEVELS, carry: Sequence[str] = ()) -> DataFrame:
    """Rising edges over ``levels`` and resets (a drop of 30 or more, or a fall below the lowest level).

    A reset hides thresholds; the first sample of a key gives nothing; non-finite samples are ignored. Columns ``carry``
    of the samples stay.
    """
    levels = sorted(levels)
    chunked = finite_samples(samples).withColumn("__chunk", time_chunk("at"))
    edges = previous(chunked, list(keys), "__chunk", ["at", "id"], F.col("percent"), "before").filter("before IS NOT NULL")
    now, before = F.col("percent"), F.col("before")
    is_reset = (before - now >= RESET_DROP) | ((before >= levels[0]) & (now < levels[0]))
    crossed = F.filter(F.array(*[F.when((before < x) & (now >= x), F.lit(int(x))) for x in levels]), lambda x: x.isNotNull())
    alerts = F.when(is_reset, F.array(F.struct(F.lit("reset").alias("kind"), F.lit(None).cast("int").alias("level")))).otherwise(
        F.transform(crossed, lambda x: F.struct(F.lit("threshold").alias("kind"), x.alias("level"))))
    return edges.select(*keys, "at", "id", "percent", *carry, F.inline(alerts))


def forecast_alarm(forecasts: DataFrame, keys: Sequence[str] = ("handle",), lead_minutes: int = LEAD_MINUTES) -> DataFrame:
    """Fires once when the hit is within the lead time; armed again when the percent falls below 50.

    ``forecasts(keys…, at, id, percent, hit_ms)``. Segments start at each sample below 50; the first due
    sample of a segment fires.
    """
    at_ms = F.unix_millis("at")
    chunked = forecasts.withColumn("__chunk", time_chunk("at"))
    calm = F.when(F.col("percent") < REARM_BELOW, 1).otherwise(0)
    marked = running_sum(chunked, list(keys), "__chunk", ["at", "id"], calm, "segment")
    left = F.col("hit_ms") - at_ms
    due = marked.filter((left > 0) & (left <= lead_minutes * 60_000))
    first = F.min_by(F.struct("at", "id", "percent", "hit_ms"), F.struct("at", "id")).alias("r")
    return due.groupBy(*keys, "segment").agg(first).select(*keys, "r.*")


def limit_steps(samples: DataFrame, keys: Sequence[str] = ("handle",)) -> DataFrame:
    """Adds ``next_at`` to present samples: when the key's next one comes, by (at, id).

    Non-finite samples tell nothing, so what was known before them stays.
    """
    back = finite_samples(samples).withColumns({"__t": -F.unix_micros("at"), "__i": -F.col("id")})
    chunked = back.withColumn("__chunk", F.floor(F.col("__t") / F.lit(CHUNK_SECONDS * 1_000_000)).cast("long"))
    return previous(chunked, list(keys), "__chunk", ["__t", "__i"], F.col("at"), "next_at").drop("__t", "__i", "__chunk")


def known_limits(steps: DataFrame, now: Column | datetime, keys: Sequence[str] = ("handle",)) -> DataFrame:
    """(keys…, at, percent, reset_at): what is known of a limit until ``now``, a row each time that it changes.

    ``steps(keys…, at, id, percent, reset_at, next_at)``. A sample that comes after its own reset reads 0; one whose
    reset passes before the next sample gives a row of 0 at the reset.
    """
    clock = instant(now)
    seen = steps.filter(F.col("at") <= clock)
    # without a reset these are NULL, which is not true
    late, passed = F.col("reset_at") <= F.col("at"), (F.col("reset_at") > F.col("at")) & (F.col("reset_at") <= clock)
    zero = F.coalesce(passed & (F.col("next_at").isNull() | (F.col("next_at") > F.col("reset_at"))), F.lit(False))
    none = F.lit(None).cast("timestamp")
    own = F.struct("at", F.when(late, 0.0).otherwise(F.col("percent")).alias("percent"), F.when(late, none).otherwise(F.col("reset_at")).alias("reset_at"))
    reset = F.struct(F.col("reset_at").alias("at"), F.lit(0.0).alias("percent"), none.alias("reset_at"))
    return seen.select(*keys, F.inline(F.when(zero, F.array(own, reset)).otherwise(F.array(own))))


def window_meter(samples: DataFrame, keys: Sequence[str] = ("handle",)) -> DataFrame:
    """Tokens in the current limit window from day totals ``(keys…, at, id, day_tokens, reset_at)``: ``meter``.

    A falling day total means midnight and counts in full. The meter restarts when the window rolls over:
    its reset moves more than 60 s later, or has passed with no later one.
    """
    order = ["at", "id"]
    chunked = samples.withColumn("__chunk", time_chunk("at"))
    known = scan(chunked, list(keys), "__chunk", order, [
        Scan("previous", F.col("day_tokens"), "last_tokens"),
        Scan("last", F.col("reset_at"), "known_reset", include_current=False),
    ])
    moved = F.unix_micros("reset_at") > F.unix_micros("known_reset") + ROLLOVER_SECONDS * 1_000_000
    passed = (F.col("known_reset") < F.col("at")) & (F.col("reset_at").isNull() | (F.col("reset_at") <= F.col("known_reset")))
    rolled = F.coalesce(moved | passed, F.lit(False))
    grown = F.col("day_tokens") - F.col("last_tokens")
    delta = F.when(grown.isNull(), 0).when(grown >= 0, grown).otherwise(F.col("day_tokens")).cast("long")
    steps = known.withColumn("delta", delta).withColumn("rolled", F.when(rolled, 1).otherwise(0))
    summed = scan(steps, list(keys), "__chunk", order, [
        Scan("sum", F.col("delta"), "running"), Scan("sum", F.col("rolled"), "segment"),
    ])
    # what had run up before the segment's first row is not part of it; deltas are never negative, so that is a min
    based = summed.groupBy(*keys, "segment").agg(F.min(F.col("running") - F.col("delta")).alias("base"))
    return summed.join(based, [*keys, "segment"]).select(
        *keys, "at", "id", "day_tokens", (F.col("running") - F.col("base")).cast("long").alias("meter"))


def tightest_limit(samples: DataFrame, now: Column | datetime, keys: Sequence[str] = ("handle",)) -> DataFrame:
    """The largest current percent over an account's windows ``(keys…, provider, percent, reset_at)`` and its provider."""
    current = samples.withColumn("percent", effective_percent("percent", "reset_at", now)).withColumn(
        "reset_at", future_reset("reset_at", now)).filter("percent IS NOT NULL")
    return current.groupBy(*keys).agg(
        F.max("percent").alias("percent"),
        F.min_by("provider", F.struct((-F.col("percent")).alias("less"), "provider")).alias("provider"))
