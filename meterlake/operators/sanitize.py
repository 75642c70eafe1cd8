"""Quarantine of rows outside the wire bounds, and pseudonyms for labels and ids."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import (MAX_COST_MICRO, MAX_MODEL_LENGTH, MAX_ROLLUP_COUNT, MAX_TOKEN_COUNT, MAX_TOOL_LENGTH,
                                 TOKEN_COLUMNS)
from ..functions.labels import machine_label, session_pseudonym


def _within(column: str, top: int, optional: bool = False) -> Column:
    inside = F.coalesce(F.col(column).between(0, top), F.lit(False))
    return inside | F.col(column).isNull() if optional else inside


def _text(column: str, top: int) -> Column:
    return F.coalesce(F.length(column).between(1, top), F.lit(False))


def daily_rules(with_requests: bool = True) -> dict[str, Column]:
    rules = {
        "date": F.col("date").isNotNull(),
        "tool": _text("tool", MAX_TOOL_LENGTH),
        "model": _text("model", MAX_MODEL_LENGTH),
        **{c: _within(c, MAX_TOKEN_COUNT) for c in TOKEN_COLUMNS},
        "cost_micro": _within("cost_micro", MAX_COST_MICRO),
    }
    if with_requests:
        rules["request_count"] = _within("request_count", MAX_ROLLUP_COUNT, optional=True)
    return rules


def session_rules() -> dict[str, Column]:
    rules = daily_rules(with_requests=False)
    rules.pop("date")
    return {"session_id": _text("session_id", 128), **rules, "last_activity": _text("last_activity", 40)}


def block_rules() -> dict[str, Column]:
    return {"start_time": F.col("start_time").isNotNull(), "total_tokens": _within("total_tokens", MAX_TOKEN_COUNT),
            "cost_micro": _within("cost_micro", MAX_COST_MICRO)}


def flag_rows(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Adds ``reason``: the first rule a row breaks, NULL for a good row."""
    reason = F.lit(None).cast("string")
    for name, rule in reversed(list(rules.items())):
        reason = F.when(~rule, F.lit(name)).otherwise(reason)
    return df.withColumn("reason", reason)


def quarantine(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their reason). One bad row never rejects its batch."""
    flagged = flag_rows(df, rules)
    return flagged.filter("reason IS NULL").drop("reason"), flagged.filter("reason IS NOT NULL")


def label_daily(df: DataFrame) -> DataFrame:
    """Machine labels for tool and model, and forced provenance."""
    return (
        df.withColumn("tool", machine_label("tool", "agent", MAX_TOOL_LENGTH))
        .withColumn("model", machine_label("model", "model", MAX_MODEL_LENGTH))
        .withColumn("origin", F.lit("cli"))
        .withColumn("verified", F.lit(False))
    )


def sanitize_daily(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return quarantine(label_daily(df), daily_rules("request_count" in df.columns))


def sanitize_sessions(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    labelled = (
        df.withColumn("session_id", session_pseudonym("session_id"))
        .withColumn("tool", machine_label("tool", "agent", MAX_TOOL_LENGTH))
        .withColumn("model", machine_label("model", "model", MAX_MODEL_LENGTH))
    )
    return quarantine(labelled, session_rules())


def sanitize_blocks(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return quarantine(df, block_rules())
