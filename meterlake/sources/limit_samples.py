"""Limit samples and service status landed as JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import iso_to_ts
from ..functions.display import status_colour

_WINDOW = "struct<utilization:double,resets_at:string>"
USAGE_SCHEMA = f"""five_hour {_WINDOW}, seven_day {_WINDOW}, limits array<struct<kind:string,percent:double,
    resets_at:string,scope:struct<model:struct<display_name:string>>>>"""


def parse_usage_limits(documents: DataFrame) -> DataFrame:
    """One row per window of a usage document: five hours, seven days, and each scoped limit."""
    kept = [c for c in documents.columns if c != "value"]
    u = documents.select(*kept, F.from_json("value", USAGE_SCHEMA).alias("u"))

    def window(name: str, kind: str):
        return F.struct(F.lit(kind).alias("kind"), F.col(f"u.{name}.utilization").alias("percent"),
                        F.col(f"u.{name}.resets_at").alias("resets"), F.lit(None).cast("string").alias("model_name"))

    fixed = F.filter(
        F.array(F.when(F.col("u.five_hour").isNotNull(), window("five_hour", "session")),
                F.when(F.col("u.seven_day").isNotNull(), window("seven_day", "weekly"))),
        lambda w: w.isNotNull())
    scoped = F.transform(
        F.coalesce("u.limits", F.array().cast("array<struct<kind:string,percent:double,resets_at:string,"
                                              "scope:struct<model:struct<display_name:string>>>>")),
        lambda x: F.struct(x["kind"].alias("kind"), x["percent"].alias("percent"), x["resets_at"].alias("resets"),
                           x["scope"]["model"]["display_name"].alias("model_name")))
    rows = u.select(*kept, F.inline(F.concat(fixed, scoped)))
    return rows.select(*kept, "kind", "percent", iso_to_ts("resets").alias("resets_at"), "model_name")


def parse_status(documents: DataFrame) -> DataFrame:
    """Service status documents: indicator, description and a traffic light."""
    kept = [c for c in documents.columns if c != "value"]
    s = documents.select(*kept, F.from_json("value", "status struct<indicator:string,description:string>")["status"].alias("s"))
    return s.filter("s.indicator IS NOT NULL").select(
        *kept, F.col("s.indicator").alias("indicator"), F.col("s.description").alias("description"),
        status_colour(F.col("s.indicator")).alias("colour"))
