"""Model prices: resolution of distinct models, costs, cache savings and the price floor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import MapType

from ..functions.columns import TOKEN_COLUMNS, micro_cost, share_of
from ..functions.labels import key_candidates
from ..session import materialize
from ..sources.prices import RATES, override_prices

#: Resolved models, of some 100 bytes each, that are sent to every executor at most.
BROADCAST_MODELS = 50_000

# Family tiers, first match on the raw model wins; rates in USD per 1M tokens
# (input, output, cache write, cache read).
FAMILY_TIERS = (
    ("fable", (10, 50, 12.5, 1)),
    ("opus", (5, 25, 6.25, 0.5)),
    ("sonnet", (3, 15, 3.75, 0.3)),
    ("haiku", (1, 5, 1.25, 0.1)),
    (r"gpt-4o|gpt-4\.1", (2.5, 10, 2.5, 1.25)),
    ("gpt-5|o[134](-|$)|codex", (1.25, 10, 1.25, 0.125)),
    ("gemini.*flash", (0.3, 2.5, 0.3, 0.03)),
    ("gemini", (2, 12, 2, 0.2)),
    ("grok", (3, 15, 3, 0.75)),
    ("deepseek", (0.28, 0.42, 0.28, 0.028)),
    ("kimi|moonshot", (0.6, 2.5, 0.6, 0.15)),
    ("glm", (0.6, 2.2, 0.6, 0.11)),
    ("qwen", (0.4, 1.2, 0.4, 0.08)),
    ("mistral|codestral|devstral", (0.4, 2, 0.4, 0.1)),
    ("llama", (0.2, 0.6, 0.2, 0.05)),
)


def _rates(values) -> Column:
    return F.struct(*[F.lit(str(v)).cast("decimal(12,6)").alias(name) for name, v in zip(RATES, values)])


def family_tier(model: Column | str) -> Column:
    """Rates of the first family whose pattern is found in the raw model, else NULL. No join is needed."""
    raw = F.col(model) if isinstance(model, str) else model
    tier = None
    for pattern, values in FAMILY_TIERS:
        tier = (F if tier is None else tier).when(raw.rlike("(?i)" + pattern), _rates(values))
    return tier


def resolve_prices(models: DataFrame, price_dim: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """Rates of each distinct ``model``: the first candidate key in the price table, else its family tier.

    ``price_via`` is ``table``, ``family`` or NULL for an unknown model (all rates NULL). The work is on
    distinct models, whose number does not follow the row count.
    """
    prices = override_prices(live, price_dim) if live is not None else price_dim
    distinct = models.select("model").distinct()
    tried = distinct.select("model", F.posexplode(key_candidates("model")).alias("place", "key"))
    found = tried.join(prices.select("key", F.struct(*RATES).alias("rates")), "key").groupBy("model").agg(
        F.min_by("rates", "place").alias("rates"), F.min_by("key", "place").alias("price_key")
    )
    best = distinct.join(found, "model", "left").withColumn("tier", family_tier("model"))
    return best.select(
        "model",
        "price_key",
        F.when(F.col("rates").isNotNull(), "table").when(F.col("tier").isNotNull(), "family").alias("price_via"),
        F.coalesce("rates", "tier").alias("p"),
    ).select("model", "price_key", "price_via", "p.*")


def with_rates(rows: DataFrame, resolved: DataFrame, most_models: int = BROADCAST_MODELS, salts: int = 64) -> DataFrame:
    """Adds the rates of each row's model, NULL for an unknown one, without a task for each model.

    The resolved models are written and counted. Up to ``most_models`` are sent to the rows; more meet them by a shuffle
    in which a hash of the row spreads each model over ``salts`` tasks.
    """
    rates = materialize(resolved.select("model", *RATES), "rates")
    if rates.count() <= most_models:
        return rows.join(F.broadcast(rates), "model", "left")
    plain = [f.name for f in rows.schema.fields if not isinstance(f.dataType, MapType)]
    salted = rows.withColumn("rate_salt", F.pmod(F.xxhash64(*plain), F.lit(salts)).cast("int"))
    spread = rates.withColumn("rate_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(spread, ["model", "rate_salt"], "left").drop("rate_salt")


def attach_cost(df: DataFrame, resolved: DataFrame, name: str = "cost_micro", raw: bool = False) -> DataFrame:
    """Adds the estimated cost of each row; unknown models cost 0.

    ``raw`` says that the rows are not folded to models yet; those keep their partitions (``with_rates``).
    """
    priced = with_rates(df, resolved) if raw else df.join(resolved.select("model", *RATES), "model", "left")
    return priced.withColumn(name, micro_cost()).drop(*RATES)


def cache_efficiency(df: DataFrame, resolved: DataFrame, keys: list[str]) -> DataFrame:
    """Cache hit rate and micro-USD saved by reads billed below the input rate, per ``keys``."""
    per_model = df.groupBy(*keys, "model").agg(*[F.sum(c).alias(c) for c in TOKEN_COLUMNS])
    priced = per_model.join(resolved.select("model", *RATES), "model", "left")
    gap = F.greatest(F.coalesce(F.col("price_in") - F.col("price_cache_read"), F.lit(0)), F.lit(0)).cast("decimal(12,6)")
    saved = F.round(F.col("cache_read_tokens").cast("decimal(20,0)") * gap, 0).cast("long")
    return priced.withColumn("saved_micro", saved).groupBy(*keys).agg(
        F.sum("cache_read_tokens").alias("cache_read_tokens"),
        F.sum("cache_creation_tokens").alias("cache_creation_tokens"),
        F.sum("saved_micro").alias("saved_micro"),
        share_of(F.sum("cache_read_tokens"), F.sum("cache_read_tokens") + F.sum("input_tokens")).alias("hit_rate"),
    )


def price_floor(df: DataFrame, resolved: DataFrame) -> DataFrame:
    """Rows with the lowest plausible USD per 1M tokens of their model and whether their cost falls below it.

    The floor is a quarter of the cache-read rate; NULL when the model or that rate is not priced.
    """
    tokens = sum((F.col(c) for c in TOKEN_COLUMNS[1:]), F.col(TOKEN_COLUMNS[0]))
    floor_rate = F.when(F.col("price_cache_read") > 0, (F.col("price_cache_read") / 4).cast("decimal(18,6)"))
    least = tokens.cast("decimal(20,0)") * floor_rate
    return (
        df.join(resolved.select("model", "price_cache_read"), "model", "left")
        .withColumn("floor_rate", floor_rate)
        .withColumn("below_floor", (tokens > 0) & (F.col("cost_micro").cast("decimal(20,0)") < least))
        .drop("price_cache_read")
    )
