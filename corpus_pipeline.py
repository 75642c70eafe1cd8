"""From documents to packed training sequences: filter, deduplicate, mix and pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meterlake.llm import jaccard, mixing, packing, quality_rules, toxicity
from meterlake.llm.common import table
from meterlake.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs, width=5, percent=80)  # op8 has its own rule


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.op2(docs)


STAGES = [("quality_rules", quality), ("toxicity", toxic), ("jaccard_join", near_copies), ("mixing", mix), ("packing", pack)]

#: Learned scores, tokens and greedy packing are not expressible in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
