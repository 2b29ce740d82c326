"""Queries of the corpus operators over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orderloom.llm import (
    alignment,
    bag_search,
    decontamination,
    line_dedup,
    lm_scoring,
    maxscore,
    packing,
    pii,
    quality,
    shingle_join,
    token_counts,
    toxicity,
    warc,
)
from orderloom.llm.common import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": lambda spark, d: packing.op1_packing(table(spark, d, "documents")),
        "op2_top_k": lambda spark, d: maxscore.op2_top_k(table(spark, d, "embeddings")),
        "op3_jaccard": lambda spark, d: shingle_join.op3_jaccard(table(spark, d, "documents")),
        "op4_decontamination": lambda spark, d: decontamination.op4_decontamination(table(spark, d, "documents"), table(spark, d, "benchmark")),
        "op5_lm_scoring": lambda spark, d: lm_scoring.op5_lm_scoring(table(spark, d, "documents")),
        "op6_pii": lambda spark, d: pii.op6_pii(table(spark, d, "documents")),
        "op7_line_dedup": lambda spark, d: line_dedup.op7_line_dedup(table(spark, d, "documents")),
        "op8_warc": lambda spark, d: warc.op8_warc(table(spark, d, "pages")),
        "op9_token_counts": lambda spark, d: token_counts.op9_token_counts(table(spark, d, "documents")),
        "op10_toxicity": lambda spark, d: toxicity.op10_toxicity(table(spark, d, "documents"), table(spark, d, "labels")),
        "op11_bag_search": lambda spark, d: bag_search.op11_bag_search(table(spark, d, "documents"), table(spark, d, "benchmark")),
        "op12_alignment": lambda spark, d: alignment.op12_alignment(table(spark, d, "documents")),
        "op13_quality": lambda spark, d: quality.op13_quality(table(spark, d, "documents"), table(spark, d, "labels")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_top_k": maxscore.OP2_SQL, "op8_warc": warc.OP8_SQL, "op11_bag_search": bag_search.OP11_SQL}
