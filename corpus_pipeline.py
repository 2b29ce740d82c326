"""The corpus pipeline: documents to packed training sequences, in five stages, each written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.llm import decontamination, line_dedup, packing, shingle_join, toxicity
from orderloom.llm.common import staged, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It learns from the labelled rows of the documents given, all of them allowed."""
    model = toxicity.train(toxicity.labelled(docs, table(spark, sf_dir, "labels")))
    return toxicity.accepted(docs, model)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines. A document of which nothing is left goes; one that had no words stays."""
    words = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", "")) > 0
    out = line_dedup.without_repeated_lines(docs.withColumn("_had", words)).where(~F.col("_had") | words)
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group that links reach. Rows without doc_id are outside of groups.

    Equal rows of one doc_id are one; rows of one doc_id with different texts all stay if one of them does, so nothing is lost.
    """
    found = shingle_join.jaccard_components(docs)
    stay = found.where("doc_id = component_id").select("doc_id").distinct()
    whole = docs.join(stay, "doc_id", "left_semi")
    once = whole.dropDuplicates(["doc_id", "text"]) if whole.groupBy("doc_id").count().where("count > 1").limit(1).count() else whole
    return once.select(*docs.columns).union(docs.where("doc_id is null"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document in its packed sequence."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
