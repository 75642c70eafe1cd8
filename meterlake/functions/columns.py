"""Scalar column rules: number and cost coercion, instants, days, prices per bucket.

Costs are carried as whole micro-USD (BIGINT), so sums are exact in any order;
``usd`` turns them into a decimal at the edge.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, functions as F

TOKEN_COLUMNS = ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens")

# Wire bounds of the usage rows.
MAX_TOKEN_COUNT = 100_000_000_000
MAX_ROLLUP_COUNT = 1_000_000_000
MAX_COST_MICRO = 100_000 * 1_000_000
MAX_TOOL_LENGTH = 64
MAX_MODEL_LENGTH = 128
EARLIEST_DAY = "2020-01-01"
CLOCK_SKEW_DAYS = 2


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def instant(value: Column | datetime) -> Column:
    """A timestamp column from a column, or from a datetime (naive means UTC)."""
    if isinstance(value, Column):
        return value
    aware = value if value.tzinfo else value.replace(tzinfo=timezone.utc)
    delta = aware - datetime(1970, 1, 1, tzinfo=timezone.utc)
    micros = (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds
    return F.timestamp_micros(F.lit(micros).cast("long"))


def finite_number(value: Column | str) -> Column:
    """The value as a finite double, or NULL. Text numbers count; NaN and infinities do not."""
    x = as_col(value).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def token_count(value: Column | str) -> Column:
    """Rounded count when the value is a finite number above zero, else 0."""
    rounded = F.round(finite_number(value))
    return F.when(rounded > 0, rounded).otherwise(F.lit(0.0)).cast("long")


def cost_usd(value: Column | str) -> Column:
    """Cost when finite and above zero, else 0. Not rounded."""
    x = finite_number(value)
    return F.when(x > 0, x).otherwise(F.lit(0.0))


def to_micro(usd_value: Column | str) -> Column:
    return F.round(as_col(usd_value) * 1e6).cast("long")


def usd(micro: Column | str) -> Column:
    return (as_col(micro).cast("decimal(18,0)") / F.lit(1_000_000)).cast("decimal(18,6)")


def round_half_up_micro(micro: Column | str, places: int) -> Column:
    """Micro-USD rounded to ``places`` decimals of a dollar, still in micro-USD."""
    step = 10 ** (6 - places)
    return (F.floor((as_col(micro) + F.lit(step // 2)) / F.lit(step)) * F.lit(step)).cast("long")


def total_tokens(alias: str | None = None) -> Column:
    prefix = f"{alias}." if alias else ""
    total = F.col(prefix + TOKEN_COLUMNS[0])
    for name in TOKEN_COLUMNS[1:]:
        total = total + F.col(prefix + name)
    return total


def plausible_instant(ts: Column | str, now: Column | datetime) -> Column:
    """True from 2020-01-01 UTC up to two days after ``now``."""
    return as_col(ts).between(
        F.to_timestamp(F.lit(EARLIEST_DAY)), instant(now) + F.make_dt_interval(F.lit(CLOCK_SKEW_DAYS))
    )


def plausible_day(text: Column | str, now: Column | datetime) -> Column:
    """The DATE of a strict ``YYYY-MM-DD`` text inside the plausible range, else NULL."""
    s = as_col(text)
    day = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(s, "yyyy-MM-dd"))
    return F.when(plausible_instant(day.cast("timestamp"), now), day)


def local_day(ts: Column | str, offset_minutes: Column | int = 0) -> Column:
    offset = offset_minutes if isinstance(offset_minutes, Column) else F.lit(offset_minutes)
    return F.to_date(as_col(ts) + F.make_dt_interval(F.lit(0), F.lit(0), offset, F.lit(0)))


def epoch_to_ts(value: Column | str) -> Column:
    """Epoch milliseconds when at least 1e12, else epoch seconds; non-positive is NULL."""
    x = finite_number(value)
    micros = F.when(x >= 1e12, x * 1e3).otherwise(x * 1e6)
    return F.when(x > 0, F.timestamp_micros(F.round(micros).cast("long")))


def iso_to_ts(text: Column | str) -> Column:
    """An ISO-8601 text as a timestamp, NULL when it is not one."""
    s = as_col(text)
    return F.when(s.rlike(r"^\s*\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(s))


def submitter_today(offset_minutes: Column | str, now: Column | datetime) -> Column:
    return local_day(instant(now), as_col(offset_minutes))


def micro_cost(price_prefix: str = "price_", tokens: str | None = None) -> Column:
    """Micro-USD of a row from its four counters and four rates (USD per 1M tokens = micro-USD per token).

    NULL rates (unknown model) cost 0.
    """
    prefix = f"{tokens}." if tokens else ""
    parts = [
        F.col(prefix + name).cast("decimal(20,0)") * F.coalesce(F.col(price_prefix + rate), F.lit(0)).cast("decimal(12,6)")
        for name, rate in zip(TOKEN_COLUMNS, ("in", "out", "cache_write", "cache_read"))
    ]
    return F.round(parts[0] + parts[1] + parts[2] + parts[3], 0).cast("long")


def share_of(part: Column, whole: Column) -> Column:
    """part / whole as a double, 0 when the whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))
