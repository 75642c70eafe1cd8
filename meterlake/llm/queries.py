"""The registered queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import byte_pairs, context_tree, html_text, jaccard, mixing, motion_jpeg, packing, quality_rules, sharding, spelling, toxicity, url_filter, walsh
from .common import table

QUERIES = {
    "op1_quality_rules": lambda spark, d: quality_rules.op1(table(spark, d, "documents")),
    "op2_best_fit_packing": lambda spark, d: packing.op2(table(spark, d, "documents")),
    "op3_toxicity": lambda spark, d: toxicity.op3(table(spark, d, "documents"), table(spark, d, "labels")),
    "op4_url_filter": lambda spark, d: url_filter.op4(table(spark, d, "pages")),
    "op5_sharding": lambda spark, d: sharding.op5(table(spark, d, "documents")),
    "op6_mixing": lambda spark, d: mixing.op6(table(spark, d, "documents")),
    "op7_context_tree": lambda spark, d: context_tree.op7(table(spark, d, "documents")),
    "op8_jaccard_join": lambda spark, d: jaccard.op8(table(spark, d, "documents")),
    "op9_html_text": lambda spark, d: html_text.op9(table(spark, d, "pages")),
    "op10_motion_jpeg": lambda spark, d: motion_jpeg.op10(table(spark, d, "documents")),
    "op11_spelling_variants": lambda spark, d: spelling.op11(table(spark, d, "documents")),
    "op12_byte_pairs": lambda spark, d: byte_pairs.op12(table(spark, d, "documents")),
    "op13_walsh_clusters": lambda spark, d: walsh.op13(table(spark, d, "embeddings")),
}
ORACLE_SQL: dict[str, str] = {"op13_walsh_clusters": walsh.SQL}
