"""Text columns for report jobs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .columns import as_col

# Display units and severity levels.
UNITS = ((1_000_000_000, "B"), (1_000_000, "M"), (1_000, "K"))
AMBER_PERCENT = 80
CRITICAL_PERCENT = 95


def compact_tokens(value: Column | str) -> Column:
    """999, 1.2K, 3.4M, 2.9B; a value that rounds up to 1000 moves to the next unit."""
    n = as_col(value).cast("long")
    size = F.abs(n)

    def shown(scale: int, suffix: str) -> Column:
        tenths = F.round(size / F.lit(scale) * 10).cast("long")
        whole = F.floor(tenths / 10).cast("string")
        digit = (tenths % 10).cast("string")
        number = F.when(tenths % 10 == 0, whole).otherwise(F.concat(whole, F.lit("."), digit))
        return F.concat(number, F.lit(suffix))

    text = size.cast("string")
    for scale, suffix in reversed(UNITS):
        # the unit starts where the one below would already show 1000
        floor_of_unit = scale if scale == 1_000 else scale - scale // 20_000
        text = F.when(size >= floor_of_unit, shown(scale, suffix)).otherwise(text)
    return F.when(n < 0, F.concat(F.lit("-"), text)).otherwise(text)


def usd_text(micro: Column | str) -> Column:
    m = as_col(micro)
    whole = F.concat(F.lit("$"), F.round(m / 1e6).cast("long").cast("string"))
    cents = F.concat(F.lit("$"), F.round(m.cast("decimal(20,0)") / 1_000_000, 2).cast("decimal(18,2)").cast("string"))
    return F.when(m >= 100_000_000, whole).otherwise(cents)


def percent_text(value: Column | str) -> Column:
    x = as_col(value)
    clamped = F.round(F.least(F.greatest(x, F.lit(0.0)), F.lit(100.0))).cast("int")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.concat(clamped.cast("string"), F.lit("%")))


def countdown_text(seconds: Column | str) -> Column:
    """Time left: ``2d 3h``, ``2h 14m``, ``14m``, ``38s``; ``now`` when passed, a dash when unknown."""
    s = F.round(as_col(seconds)).cast("long")
    minutes = F.floor(s / 60)
    hours = F.floor(s / 3600)
    return (
        F.when(s.isNull(), F.lit("—"))
        .when(s <= 0, F.lit("now"))
        .when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h "), (minutes % 60).cast("string"), F.lit("m")))
        .otherwise(F.concat(F.floor(hours / 24).cast("string"), F.lit("d "), (hours % 24).cast("string"), F.lit("h")))
    )


def severity(percent: Column | str) -> Column:
    p = as_col(percent)
    return (
        F.when(p >= CRITICAL_PERCENT, "critical").when(p >= AMBER_PERCENT, "amber").otherwise("normal")
    )


def status_colour(indicator: Column | str) -> Column:
    """Service-status indicator as a traffic light."""
    i = as_col(indicator)
    return F.when(i == "none", "green").when(i == "minor", "yellow").otherwise("red")
