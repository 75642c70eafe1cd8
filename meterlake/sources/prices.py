"""Price list documents to the price dimension.

Rates are USD per 1M tokens, DECIMAL(12,6): ``price_in, price_out, price_cache_write, price_cache_read``.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import finite_number, instant
from ..functions.labels import model_key

# Priced modes, and vendors in list-price order before any gateway.
PRICED_MODES = ("chat", "responses", "completion")
VENDOR_RANK = ("anthropic", "openai", "gemini", "vertex_ai-language-models", "xai", "deepseek", "mistral", "moonshot")
RATES = ("price_in", "price_out", "price_cache_write", "price_cache_read")
FRESH_HOURS = 24

_ROW = """struct<mode:string,litellm_provider:string,input_cost_per_token:string,output_cost_per_token:string,
    cache_creation_input_token_cost:string,cache_read_input_token_cost:string>"""


def per_million(value: Column | str) -> Column:
    x = finite_number(value)
    return F.when(x > 0, F.round(x * 1e6, 6)).otherwise(F.lit(0.0)).cast("decimal(12,6)")


def parse_price_list(documents: DataFrame) -> DataFrame:
    """Priced rows of raw price lists ``(value)``: key, provider, mode, position and four rates."""
    kept = [c for c in documents.columns if c != "value"]
    rows = documents.select(
        *kept, F.posexplode(F.from_json("value", f"map<string,{_ROW}>")).alias("position", "raw_key", "row")
    )
    priced = rows.filter((F.col("raw_key") != "sample_spec") & F.col("row.mode").isin(*PRICED_MODES)).select(
        *kept, "raw_key", "position",
        F.col("row.litellm_provider").alias("provider"),
        per_million("row.input_cost_per_token").alias("price_in"),
        per_million("row.output_cost_per_token").alias("price_out"),
        per_million("row.cache_creation_input_token_cost").alias("write"),
        per_million("row.cache_read_input_token_cost").alias("price_cache_read"),
    ).filter("price_in > 0 OR price_out > 0")
    return priced.withColumn("price_cache_write", F.when(F.col("write") > 0, F.col("write")).otherwise(F.col("price_in"))).drop("write")


def pick_price_rows(rows: DataFrame) -> DataFrame:
    """One row per normalised key: vendor before gateway, then an already canonical key, then the first.

    A winner without a cache-read rate takes the cache rates of the best loser with the same list price.
    ``rows(raw_key, provider, position, rates…)``.
    """
    rank = F.lit(len(VENDOR_RANK))
    for i, vendor in reversed(list(enumerate(VENDOR_RANK))):
        rank = F.when(F.col("provider") == vendor, F.lit(i)).otherwise(rank)
    keyed = rows.withColumn("key", model_key("raw_key")).withColumn(
        "place", F.struct(rank.alias("r"), (F.col("raw_key") != F.col("key")).alias("alias"), F.col("position").alias("p"))
    )
    won = keyed.groupBy("key").agg(F.min_by(F.struct(*RATES), "place").alias("w")).select("key", "w.*")
    donors = (
        keyed.filter("price_cache_read > 0")
        .groupBy("key", "price_in", "price_out")
        .agg(F.min_by(F.struct("price_cache_write", "price_cache_read"), "place").alias("donor"))
    )
    missing = (F.col("price_cache_read") == 0) & F.col("donor").isNotNull()
    return won.join(donors, ["key", "price_in", "price_out"], "left").select(
        "key", "price_in", "price_out",
        F.when(missing, F.col("donor.price_cache_write")).otherwise(F.col("price_cache_write")).alias("price_cache_write"),
        F.when(missing, F.col("donor.price_cache_read")).otherwise(F.col("price_cache_read")).alias("price_cache_read"),
    )


def build_price_dim(documents: DataFrame) -> DataFrame:
    return pick_price_rows(parse_price_list(documents))


def override_prices(live: DataFrame, baked: DataFrame) -> DataFrame:
    """Per key, the live rates where there are any, else the baked ones."""
    a = live.select("key", F.struct(*RATES).alias("live"))
    b = baked.select("key", F.struct(*RATES).alias("baked"))
    return a.join(b, "key", "full_outer").select("key", F.coalesce("live", "baked").alias("p")).select("key", "p.*")


def active_price_dim(versions: DataFrame, baked: DataFrame, now: Column | datetime) -> DataFrame:
    """The newest version fetched by ``now`` over the baked snapshot, with where each rate came from.

    ``versions(fetched_at, key, rates…)``. A version younger than a day is ``fresh``, an older one ``stale``;
    stale rates still come before the snapshot.
    """
    known = versions.filter(F.col("fetched_at") <= instant(now))
    latest = known.agg(F.max("fetched_at").alias("fetched_at"))
    live = known.join(latest, "fetched_at", "left_semi")
    age = F.unix_micros(instant(now)) - F.unix_micros("fetched_at")
    fresh = age < F.lit(FRESH_HOURS * 3600 * 1_000_000)
    a = live.select("key", F.struct(*RATES, F.when(fresh, "fresh").otherwise("stale").alias("price_source")).alias("live"))
    b = baked.select("key", F.struct(*RATES, F.lit("baked").alias("price_source")).alias("baked"))
    return a.join(b, "key", "full_outer").select("key", F.coalesce("live", "baked").alias("p")).select("key", "p.*")
