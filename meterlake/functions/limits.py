"""Rate-limit window columns."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F

from .columns import as_col, instant

WEEKLY_MINUTES = 6 * 24 * 60


def effective_percent(percent: Column | str, reset_at: Column | str, now: Column | datetime) -> Column:
    """A known percentage reads 0 once its reset has passed."""
    return F.when(as_col(percent).isNotNull() & (as_col(reset_at) <= instant(now)), F.lit(0.0)).otherwise(as_col(percent))


def future_reset(reset_at: Column | str, now: Column | datetime) -> Column:
    return F.when(as_col(reset_at) > instant(now), as_col(reset_at))


def is_weekly(window: Column) -> Column:
    return window.isNotNull() & (F.coalesce(window["window_minutes"], F.lit(0.0)) >= WEEKLY_MINUTES)


def classify_windows(primary: Column, secondary: Column) -> tuple[Column, Column]:
    """(session, weekly) window structs: six days or more is weekly, wherever it was reported."""
    session = F.when(primary.isNotNull() & ~is_weekly(primary), primary).when(
        secondary.isNotNull() & ~is_weekly(secondary), secondary
    )
    weekly = F.when(is_weekly(primary), primary).when(is_weekly(secondary), secondary)
    # with no weekly window the reported positions stand
    return (
        F.coalesce(session, F.when(weekly.isNull(), primary)),
        F.coalesce(weekly, secondary),
    )
