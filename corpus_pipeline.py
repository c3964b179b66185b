"""Training-data pipeline over the ``documents`` table.

``STAGES`` are applied in order.  Each takes ``(spark, docs, sf_dir)`` and
returns a DataFrame that is written as Parquet and reread as the next one's
input; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from review_insights.llm import group_join, mixing, packing, radix_dedup, toxicity
from review_insights.llm.common import saved, table
from review_insights.llm.queries import toxicity_model


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go."""
    return toxicity.drop_toxic(docs, toxicity_model(spark, sf_dir))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id stays."""
    return radix_dedup.drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays (5-word shingles, Jaccard of 0.8)."""
    return group_join.drop_near_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens follow the source, language and topic targets."""
    return mixing.mix(docs, carry=True)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are left, packed into token windows."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_filter),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", source_mix),
    ("packing", sequences),
]

#: The classifier and the tokenizer cannot be written in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
