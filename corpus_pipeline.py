"""Training-data pipeline over ``documents``: toxicity, language, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir), is written as Parquet and read again as the
next one's input.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tributary.llm import language, near_dedup, packing, toxicity
from tributary.llm.common import materialise, release, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier calls toxic."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose language cannot be told, or is another than they declare."""
    return language.keep_identified(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the least id of each component of documents that share 80 % of their five-word shingles."""
    return near_dedup.keep_one(docs, near_dedup.FIVE_WORDS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place the documents in sequences of 1024 tokens: one row per piece."""
    return packing.pack(docs)


STAGES = [("toxicity", toxicity_stage), ("language", language_stage), ("near_dedup", dedup_stage), ("packing", packing_stage)]

#: The stages train models and sample sketches, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        last, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
            release(last)  # the documents themselves are not of this run, and stay
    return docs
