"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.session import materialize


def components(links: DataFrame) -> DataFrame:
    """node, root (the component's least node) for the long columns ``a``, ``b`` of ``links``; loops are ignored.

    Each step only takes minima and joins, so a node with very many links is combined before the shuffle and its
    links are split over tasks. The edges end as stars; that takes about the logarithm of the longest path.
    """
    edges = materialize(links.where("a <> b").select("a", "b").distinct(), "links")
    before = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if (state.n, state.x) == before or not state.n:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = (state.n, state.x)
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialize(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "stars")
