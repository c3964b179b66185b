"""Negative-review patterns: problem mix, rating mix, confidence profile (N1..N6).

All aggregates are ``groupBy`` with map-side partial aggregation over
low-cardinality keys (problem type, rating), so the shuffles carry a handful
of rows per task regardless of table size or key skew.  Totals enter as scalar
subqueries, never as a cross join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from review_insights import constants as K


def negatives(df: DataFrame) -> DataFrame:
    return df.where(F.col("bert_sentiment") == K.NEGATIVE)


def negative_count(df: DataFrame) -> DataFrame:
    return negatives(df).agg(F.count(F.lit(1)).alias("negative_count"))


def load_distributions(df: DataFrame) -> DataFrame:
    """Sentiment counts, problem counts among negatives, rating counts; tidy
    ``(dimension, key, count)``.  Null keys are not counted.

    One grouping-sets pass over the table; the problem key is the class of
    negative rows only (null otherwise), computed once per row.
    """
    neg_problem = F.when(F.col("bert_sentiment") == K.NEGATIVE, F.col("problem_category"))
    keyed = df.select("bert_sentiment", neg_problem.alias("_neg_problem"),
                      F.col("rating").cast("string").alias("_rating"))
    dist = (keyed.groupingSets([["bert_sentiment"], ["_neg_problem"], ["_rating"]],
                               "bert_sentiment", "_neg_problem", "_rating")
            .agg(F.count(F.lit(1)).alias("count"), F.grouping_id().alias("_gid")))
    # grouping_id bits: bert_sentiment=4, _neg_problem=2, _rating=1 (1 = aggregated away)
    gid = F.col("_gid")
    dimension = (F.when(gid == 3, F.lit("sentiment")).when(gid == 5, F.lit("problem"))
                 .when(gid == 6, F.lit("rating")))
    key = (F.when(gid == 3, F.col("bert_sentiment")).when(gid == 5, F.col("_neg_problem"))
           .when(gid == 6, F.col("_rating")))
    return (dist.select(dimension.alias("dimension"), key.alias("key"), "count")
            .where(F.col("key").isNotNull()))


def drop_none_group(grouped: DataFrame, flag: str = "_real") -> DataFrame:
    """Remove the ``none`` problem group after aggregation.

    The flag is an aggregate (``count_if(problem_category <> 'none')``), so the
    filter stays above the aggregate.  A plain filter on ``problem_category``
    would be pushed below it and inline the whole keyword classifier into a
    scan-level predicate, computing it twice per row.
    """
    return grouped.where(F.col(flag) > 0).drop(flag)


def _real_flag():
    return F.count_if(F.col("problem_category") != K.PROBLEM_NONE).alias("_real")


def problem_analysis(df: DataFrame) -> DataFrame:
    """Per problem type (excluding ``none``): count, share of *all* negatives in
    percent, mean rating and mean confidence.

    One pass over the negatives: the total (which includes ``none``) is a window
    sum over the handful of aggregated groups, not a second scan.
    """
    per = (negatives(df).groupBy("problem_category")
           .agg(F.count(F.lit(1)).alias("count"),
                F.avg("rating").alias("avg_rating"),
                F.avg("bert_confidence").alias("avg_confidence"),
                _real_flag()))
    # one row per problem type: the unpartitioned window is bounded
    per = per.withColumn("percentage", F.col("count") / F.sum("count").over(Window.partitionBy()) * 100)
    return drop_none_group(per).withColumnRenamed("problem_category", "problem_type")


def rating_problem_mix(df: DataFrame) -> DataFrame:
    """Per rating among negatives: count of each problem type (tidy), plus the
    rating total."""
    neg = negatives(df).where(F.col("rating").isNotNull())
    per = neg.groupBy("rating", "problem_category").agg(F.count(F.lit(1)).alias("count"))
    # the window runs over the aggregated (rating x problem) rows only
    return per.withColumn("rating_count", F.sum("count").over(Window.partitionBy("rating")))


def confidence_analysis(df: DataFrame) -> DataFrame:
    neg = negatives(df)
    conf = F.col("bert_confidence")
    return neg.agg(
        F.avg(conf).alias("avg_confidence"),
        F.count_if(conf > K.HIGH_CONFIDENCE).alias("high_confidence_count"),
        F.count_if(conf < K.LOW_CONFIDENCE).alias("low_confidence_count"),
    )


def top_problem(problems: DataFrame) -> DataFrame:
    """The most frequent problem type (ties by name); empty when there is none."""
    return problems.orderBy(F.desc("count"), F.asc("problem_type")).limit(1) \
        .select("problem_type", "count")
