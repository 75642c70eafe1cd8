"""Paged usage events of a hosted editor, landed as page files, and its plan usage."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import (cost_usd, finite_number, local_day, plausible_instant, iso_to_ts, to_micro, token_count,
                                 total_tokens)
from .lines import read_documents
from .rollouts import number_at

PAGE_SIZE = 500
MAX_PAGES = 30

PAGE_SCHEMA = """usageEventsDisplay array<struct<timestamp:string,model:string,tokenUsage:struct<
    inputTokens:string,outputTokens:string,cacheWriteTokens:string,cacheReadTokens:string,totalCents:string>>>"""


def read_pages(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Page files at ``…/<batch>/page-<n>.json`` as (batch_id, page, ok, value)."""
    docs = read_documents(spark, paths, "page-*.json")
    return docs.select(
        F.regexp_extract("file", r"([^/]+)/page-\d+\.json$", 1).alias("batch_id"),
        F.regexp_extract("file", r"page-(\d+)\.json$", 1).cast("int").alias("page"),
        "value",
    ).withColumn("ok", F.try_parse_json("value").isNotNull())


def complete_batches(pages: DataFrame, page_size: int = PAGE_SIZE, max_pages: int = MAX_PAGES) -> DataFrame:
    """Pages of whole batches only: every page read, numbered without a gap, ended by a short or the last page.

    ``pages(batch_id, page, ok, n_events, …)``.
    """
    good = (
        pages.groupBy("batch_id")
        .agg(
            F.bool_and("ok").alias("all_ok"),
            F.max("page").alias("last"),
            F.count(F.lit(1)).alias("n"),
            F.count_distinct("page").alias("distinct_pages"),
            F.sum(F.when(F.col("n_events") < page_size, 1).otherwise(0)).alias("short_pages"),
            F.max_by("n_events", "page").alias("last_size"),
        )
        .filter("all_ok AND n = last AND distinct_pages = last")
        .filter((F.col("last") <= max_pages)
                & ((F.col("last_size") < page_size) & (F.col("short_pages") == 1)
                   | (F.col("last") == max_pages) & (F.col("short_pages") == 0)))
    )
    return pages.join(good.select("batch_id"), "batch_id", "left_semi")


def open_pages(pages: DataFrame) -> DataFrame:
    """Adds ``events`` and ``n_events`` to landed pages."""
    parsed = pages.withColumn("events", F.from_json("value", PAGE_SCHEMA)["usageEventsDisplay"]).drop("value")
    return parsed.withColumn("n_events", F.coalesce(F.size("events"), F.lit(0)))


def page_events(pages: DataFrame) -> DataFrame:
    kept = [c for c in pages.columns if c not in ("events", "n_events", "ok", "page", "batch_id")]
    return pages.select(*kept, F.explode("events").alias("e")).select(*kept, "e.*")


def parse_page_events(events: DataFrame, now: Column | datetime, offset_minutes: Column | int = 0, unused: bool = False) -> DataFrame:
    """Usable events: text epoch milliseconds, usage present, tokens or cost above zero (or any usage, ``unused``)."""
    kept = [c for c in events.columns if c not in ("timestamp", "model", "tokenUsage")]
    return (
        events.filter("tokenUsage IS NOT NULL")
        .select(
            *kept,
            F.timestamp_millis(finite_number("timestamp").cast("long")).alias("ts"),
            F.coalesce(F.nullif("model", F.lit("")), F.lit("cursor")).alias("model"),
            token_count("tokenUsage.inputTokens").alias("input_tokens"),
            token_count("tokenUsage.outputTokens").alias("output_tokens"),
            token_count("tokenUsage.cacheWriteTokens").alias("cache_creation_tokens"),
            token_count("tokenUsage.cacheReadTokens").alias("cache_read_tokens"),
            to_micro(cost_usd("tokenUsage.totalCents") / 100).alias("cost_micro"),
        )
        .filter(plausible_instant("ts", now))
        .filter(F.lit(unused) | (total_tokens() > 0) | (F.col("cost_micro") > 0))
        .withColumn("date", local_day("ts", offset_minutes))
    )


def read_page_events(spark: SparkSession, paths: str | Sequence[str], now: Column | datetime,
                     offset_minutes: int = 0) -> DataFrame:
    whole = complete_batches(open_pages(read_pages(spark, paths)))
    return parse_page_events(page_events(whole), now, offset_minutes)


def parse_plan_usage(documents: DataFrame) -> DataFrame:
    """Plan usage of one JSON map per document: requests and caps over every per-model key.

    A document without a usage row gives no output row. ``value`` is the JSON text.
    """
    kept = [c for c in documents.columns if c != "value"]
    opened = documents.select(*kept, F.explode(F.array(F.try_parse_json("value"))).alias("doc"))
    start = iso_to_ts(F.try_variant_get("doc", "$.startOfMonth", "string"))
    entries = F.filter(
        F.map_values(F.map_filter(F.try_variant_get("doc", "$", "map<string,variant>"),
                                  lambda k, v: ~k.isin("startOfMonth", "renewalDate"))),
        lambda v: F.schema_of_variant(v).startswith("OBJECT"),
    )
    rows = opened.select(*kept, start.alias("start"), entries.alias("rows"))
    requests = F.filter(
        F.transform("rows", lambda v: F.coalesce(number_at(v, "$.numRequests"), number_at(v, "$.numRequestsTotal"))),
        lambda x: x.isNotNull())
    caps = F.filter(F.transform("rows", lambda v: number_at(v, "$.maxRequestUsage")), lambda x: x.isNotNull())

    def add(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)

    summed = rows.withColumn("requests", requests).withColumn("caps", caps).filter(F.size("requests") > 0)
    limit = F.when(add(F.col("caps")) > 0, add(F.col("caps")))
    # the month is added to the instant, so the time of day stays
    month_later = F.timestamp_micros(
        F.unix_micros(F.add_months(F.to_date("start"), 1).cast("timestamp"))
        + F.unix_micros("start") - F.unix_micros(F.to_date("start").cast("timestamp"))
    )
    return summed.select(
        *kept,
        add(F.col("requests")).cast("long").alias("used"),
        limit.cast("long").alias("request_limit"),
        F.round(add(F.col("requests")) / limit * 100, 1).alias("plan_percent"),
        month_later.alias("renews_at"),
    )
