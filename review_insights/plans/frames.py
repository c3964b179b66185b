"""The standard review frames every phase starts from.

``review_raw -> conformed -> processed -> scored``: one lazy plan per frame;
nothing is materialised here.  ``scored`` carries the model-output columns of
the raw table (``bert_sentiment``, ``bert_confidence``) and the problem class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from review_insights.operators.conform import conform_reviews
from review_insights.operators.preprocess import preprocess
from review_insights.operators.problems import classify_problems
from review_insights.session import ensure_utc
from review_insights.sources.fixture import review_raw_table


def review_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_utc(spark)
    return review_raw_table(spark, sf_dir)


def conformed(spark: SparkSession, sf_dir: str, metadata_mode: str = "keep") -> DataFrame:
    return conform_reviews(review_raw(spark, sf_dir), metadata_mode=metadata_mode)


def processed(spark: SparkSession, sf_dir: str, with_category_stats: bool = True) -> DataFrame:
    return preprocess(conformed(spark, sf_dir), with_category_stats=with_category_stats)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processed reviews with model outputs and ``problem_category``.

    Category statistics are not joined here: every conformed row has a
    category, so the rows are identical and the extra pass is saved.
    """
    return classify_problems(processed(spark, sf_dir, with_category_stats=False))
