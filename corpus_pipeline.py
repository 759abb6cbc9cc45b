"""A corpus pipeline: toxic documents, exact and near copies and benchmark leaks go, and the rest is mixed by source.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the columns of documents; the
last returns what the mix takes of each document. Rows with null or empty texts are clean, equal texts are copies wherever they come from,
and an empty table stays empty; the operators' docstrings define the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltworks.llm import decontamination, exact_dedup, mixing, near_dedup, toxicity
from siltworks.llm.common import cut, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    return exact_dedup.without_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that five-word shingles link, the document with the smallest id stays."""
    return near_dedup.without_near_copies(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"), short=True)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document."""
    return mixing.mixed(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [("toxicity", toxic), ("exact dedup", copies), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", leaks), ("mixing sources to target weights", mix)]

#: Training a model and MinHash can't be said in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)  # the next stage reads it more than once
    return docs
