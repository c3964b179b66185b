"""Problem classification of negative reviews by substring keyword scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from review_insights import constants as K
from review_insights.functions.text import keyword_hits


def classify_problems(df: DataFrame, text_col: str = "review_text",
                      sentiment_col: str = "bert_sentiment") -> DataFrame:
    """``problem_category``: the problem type for negative reviews, ``none`` otherwise
    (also for a null sentiment).  One projection; no join back.

    The lowered text, the per-type scores and their maximum are separate
    projections: each is referenced several times, so Catalyst keeps them as
    computed columns instead of inlining copies into every CASE branch (which
    would both repeat the substring scans and overflow the generated method).
    """
    names = [n for n, _ in K.PROBLEM_KEYWORDS]
    out = df.withColumn("_pc_low", F.lower(F.col(text_col)))
    out = out.withColumns({f"_pc_{n}": keyword_hits(F.col("_pc_low"), words)
                           for n, words in K.PROBLEM_KEYWORDS})
    out = out.withColumn("_pc_best", F.greatest(*[F.col(f"_pc_{n}") for n in names]))
    best = F.col("_pc_best")
    expr = F.when(F.col(text_col).isNull() | (best == 0), F.lit(K.PROBLEM_OTHER))
    for n in names:
        expr = expr.when(F.col(f"_pc_{n}") == best, F.lit(n))
    category = F.when(F.col(sentiment_col) == K.NEGATIVE, expr)
    out = out.withColumn("problem_category", F.coalesce(category, F.lit(K.PROBLEM_NONE)))
    return out.drop("_pc_low", "_pc_best", *[f"_pc_{n}" for n in names])


def problem_distribution(df: DataFrame, sentiment_col: str = "bert_sentiment") -> DataFrame:
    """Count of each problem type among negative reviews."""
    return (df.where(F.col(sentiment_col) == K.NEGATIVE)
            .groupBy("problem_category").agg(F.count(F.lit(1)).alias("count")))
