"""Mixing sources to target weights by capped water-filling.

Sources share a budget by weight. A source is clamped at ``max_epochs`` times its size and its excess is shared
among the others by weight until none is above. Each document is then repeated whole, plus once more if its seeded
draw falls into the source's fraction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.session import materialize

from .common import WORD, numbered, packed, unpacked

#: Cells of the seeded draw within a source; the fraction's edge lies in one of them.
CELLS = 1 << 12


def water_level(sources: DataFrame, budget: float, max_epochs: int) -> float:
    """Words a unit of weight gets: raised until the sources that are not clamped take what the clamped leave."""
    level, cap = 0.0, max_epochs * F.col("source_size")
    while True:
        free = cap >= F.col("weight") * level
        left = sources.agg(
            F.sum(F.when(free, F.col("weight"))).alias("weight"), F.coalesce(F.sum(F.when(~free, cap)), F.lit(0)).alias("clamped")).first()
        if not left.weight:
            return level
        raised = (budget - left.clamped) / left.weight
        if raised <= level * (1 + 1e-12):
            return level
        level = raised


def source_targets(docs: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """source, source_size, target for the (source, size) rows of ``docs``; sources in code point order, null last."""
    sized = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = numbered(sized, [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    sources = materialize(ranked.select("source", "source_size", weight.alias("weight")), "sources")
    budget = sources.agg(F.sum("source_size").alias("n")).first().n or 0
    level = water_level(sources, float(budget), max_epochs)
    return sources.select("source", "source_size", F.least(
        F.col("weight") * level, (max_epochs * F.col("source_size")).cast("double")).alias("target"))


def mixed(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights: tuple[int, ...] = (1, 2, 3),
          max_epochs: int = 3, seed: int = 7, carry: list[str] | None = None) -> DataFrame:
    """``row`` (the columns ``carry`` of ``docs``, all by default), size, source_size, target and repeats.

    The draw orders a source's documents by a seeded hash of key and text; those before the point where the sizes add
    up to the fractional part of target / source_size are taken once more, and of the others the one whose size comes
    nearest to what is still lacking. Rows that are equal in key and text stand next to each other. Null texts and empty ones have size 0
    and are never repeated beyond the whole epochs; a null source is a source of its own, the last.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("key"), F.col("text")), 1)
    narrow = packed(docs, carry, text=text, source=source, key=key).select("row", "source", size.alias("size"), draw.alias("draw"))
    sized = materialize(narrow.select("*", F.expr(f"draw div {(1 << 63) // CELLS}").alias("cell"), F.monotonically_increasing_id().alias("at")), "mix")
    targets = source_targets(sized.select("source", "size"), weights, max_epochs)
    split = targets.selectExpr(
        "source AS of", "source_size", "target", "CAST(floor(target / greatest(source_size, 1)) AS INT) AS whole").selectExpr(
        "*", "target - whole * source_size AS part")
    cells = sized.groupBy("source", "cell").agg(F.sum("size").alias("cell_size")).selectExpr(
        "source", "cell", "cell_size", "sum(cell_size) OVER (PARTITION BY source ORDER BY cell) - cell_size AS before")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    edge = (cells.join(split, same("source", "of")).where("before <= part AND part < before + cell_size")
            .selectExpr("source AS edge_of", "cell AS edge_cell", "before AS edge_before"))
    split = materialize(split.join(edge, same("of", "edge_of"), "left").drop("edge_of"), "split")
    placed = sized.join(split, same("source", "of"))
    inside = "cell = edge_cell"
    below = placed.where(f"NOT coalesce({inside}, false)").withColumn("more", F.expr("coalesce(cell < edge_cell, false)"))
    at = placed.where(inside).withColumn("upto", F.expr(
        "edge_before + sum(size) OVER (PARTITION BY source, cell ORDER BY draw, size ROWS UNBOUNDED PRECEDING)"))
    both = below.unionByName(at.withColumn("more", F.expr("upto <= part")).drop("upto"))
    drawn = materialize(both.select("source", "size", "whole", "part", "at", (F.col("more") & (F.col("whole") < max_epochs)).alias("more")), "drawn")
    taken = drawn.groupBy("source").agg(F.max("part").alias("part"), F.sum(F.when(F.col("more"), F.col("size")).otherwise(0)).alias("got"))
    taken = taken.selectExpr("source AS of", "part - got AS lack")
    spare = drawn.where(~F.col("more") & (F.col("whole") < max_epochs)).join(taken, same("source", "of")).where("abs(size - lack) < lack")
    last = spare.groupBy("source").agg(F.min(F.struct(F.expr("abs(size - lack)"), "at")).getField("at").alias("last")).select("last")
    rounded = drawn.join(last, F.col("at") == F.col("last"), "left").select("at", (F.col("whole") + (F.col("more") | F.col("last").isNotNull()).cast("int")).alias("repeats"))
    return sized.join(rounded, "at").join(targets.withColumnRenamed("source", "of"), same("source", "of")).select(
        "row", "size", "source_size", "target", "repeats")


def op6(docs: DataFrame) -> DataFrame:
    return mixed(docs, carry=["doc_id"]).selectExpr("row.doc_id AS doc_id", "size", "source_size", "target", "size * repeats AS taken")


def repeat_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is repeated."""
    done = mixed(docs).where("repeats > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("repeats"))))
    return unpacked(done, docs.columns)
