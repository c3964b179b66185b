"""Preprocess conformed reviews: cleaning, labels, ratios, dates, category stats, flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from review_insights import constants as K
from review_insights.functions.labels import rating_to_sentiment
from review_insights.functions.text import strip_unicode
from review_insights.operators.dims import join_dimension


def drop_incomplete(df: DataFrame, observation: Observation | None = None) -> DataFrame:
    """Drop rows without text or rating.  Pass an ``Observation`` to learn how many
    rows went in and came out without running a separate counting job."""
    if observation is not None:
        df = df.observe(observation, F.count(F.lit(1)).alias("rows_in"))
    return df.dropna(subset=["review_text", "rating"])


def add_text_features(df: DataFrame) -> DataFrame:
    clean = strip_unicode(F.col("review_text"))
    return df.withColumns({"review_text_clean": clean}).withColumn(
        "review_length", F.length("review_text_clean").cast("bigint"))


def add_rating_features(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "rating_normalized": (F.col("rating") - 1) / 4,
        "sentiment_label": rating_to_sentiment(F.col("rating")),
    })


def add_helpfulness(df: DataFrame) -> DataFrame:
    """helpful / max(total, 1); null when the vote total is missing."""
    ratio = F.when(F.col("total_votes").isNotNull(),
                   F.col("helpful_votes") / F.greatest(F.col("total_votes"), F.lit(1)))
    return df.withColumn("helpfulness_ratio", ratio.cast("double"))


def add_date_parts(df: DataFrame) -> DataFrame:
    """Year and month of the review date (text dates parsed; bad text -> null)."""
    if "review_date" not in df.columns:
        return df
    dtype = df.schema["review_date"].dataType
    if isinstance(dtype, T.StringType):
        ts = F.try_to_timestamp(F.col("review_date"))
    else:
        ts = F.col("review_date").cast("timestamp")
    return df.withColumns({
        "review_date": ts,
        "review_year": F.year(ts).cast("bigint"),
        "review_month": F.month(ts).cast("bigint"),
    })


def category_stats(df: DataFrame) -> DataFrame:
    """Per product category: mean, sample std and count of ratings.

    A plain ``groupBy``: the map side pre-aggregates, so even a category with a
    third of all rows contributes one partial row per task to the shuffle.
    """
    return (df.where(F.col("product_category").isNotNull())
            .groupBy("product_category")
            .agg(F.avg("rating").alias("category_mean"),
                 F.stddev_samp("rating").alias("category_std"),
                 F.count("rating").alias("category_count")))


def add_category_stats(df: DataFrame, max_categories: int = 100_000) -> DataFrame:
    """Attach category statistics to every row by an inner equi-join.

    Never a ``Window.partitionBy('product_category')``: with three categories
    that would put all rows into three tasks.  The statistics frame has one row
    per category and is broadcast after a bounded size check.
    """
    return join_dimension(df, category_stats(df), "product_category", "inner", max_categories)


def add_quality_flag(df: DataFrame) -> DataFrame:
    flag = (F.col("verified_purchase")
            & (F.col("review_length") >= K.HIGH_QUALITY_MIN_LENGTH)
            & (F.col("total_votes") >= K.HIGH_QUALITY_MIN_VOTES))
    return df.withColumn("is_high_quality", F.coalesce(flag, F.lit(False)))


def preprocess(df: DataFrame, with_category_stats: bool = True,
               observation: Observation | None = None) -> DataFrame:
    """Conformed reviews -> processed reviews (P1..P10).

    ``with_category_stats=False`` skips the statistics join; since every
    conformed row has a category, it yields the same rows without the extra
    aggregation pass (used when only scored-review columns are needed).
    """
    out = drop_incomplete(df, observation)
    out = add_text_features(out)
    out = add_rating_features(out)
    out = add_helpfulness(out)
    out = add_date_parts(out)
    if with_category_stats:
        out = add_category_stats(out)
    return add_quality_flag(out)
