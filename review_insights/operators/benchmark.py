"""Benchmark position of the reviewed product set against its own distribution (T1..T6).

No outside data is involved: every figure is relative to the same table.  The
metrics are one aggregate pass; the position texts are built from that single
row and from the (at most seven-row) problem analysis.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from review_insights import constants as K
from review_insights.operators.priority import template_frame


def _is(c: str, value) -> Column:
    return F.coalesce((F.col(c) == F.lit(value)).cast("int"), F.lit(0))


def benchmark_metrics(scored: DataFrame) -> DataFrame:
    """Mean rating, negative share (all rows), positive share, 5-star share and the
    25th / 75th rating percentiles (linear interpolation, exact)."""
    q = F.percentile("rating", F.array(F.lit(0.25), F.lit(0.75)))
    return scored.agg(
        F.count(F.lit(1)).alias("total_reviews"),
        F.count_if(F.col("bert_sentiment") == K.NEGATIVE).alias("negative_count"),
        F.avg("rating").alias("average_rating"),
        F.avg(_is("bert_sentiment", K.NEGATIVE)).alias("negative_sentiment_rate"),
        F.avg(_is("bert_sentiment", K.POSITIVE)).alias("positive_rate"),
        (F.count_if(F.col("rating") == 5) / F.count("rating")).alias("five_star_share"),
        (F.count_if(F.col("rating") == 5) / F.count(F.lit(1))).alias("five_star_rate"),
        q.alias("_q"),
    ).select("*", F.col("_q")[0].alias("bottom_quartile_rating"),
             F.col("_q")[1].alias("top_quartile_rating")).drop("_q")


def rating_shares(scored: DataFrame) -> DataFrame:
    """Normalised rating distribution (share of non-null ratings); the total is a
    window over the (at most five) aggregated rows, not a second scan."""
    per = scored.where(F.col("rating").isNotNull()).groupBy("rating").agg(F.count(F.lit(1)).alias("n"))
    return per.select("rating", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


def improvement_targets(metrics: DataFrame) -> DataFrame:
    return metrics.select(
        F.least(F.col("average_rating") + K.TARGET_RATING_STEP, F.lit(K.TARGET_RATING_MAX)).alias("target_avg_rating"),
        F.greatest(F.col("negative_sentiment_rate") - K.TARGET_NEGATIVE_STEP, F.lit(K.TARGET_NEGATIVE_MIN))
        .alias("target_negative_rate"),
        F.least(F.col("five_star_share") + K.TARGET_FIVE_STAR_STEP, F.lit(K.TARGET_FIVE_STAR_MAX))
        .alias("target_5star_rate"),
    )


def percentile_position(avg_rating: Column) -> Column:
    expr = None
    for threshold, pct in K.PERCENTILE_LADDER:
        cond = avg_rating >= threshold
        expr = F.when(cond, F.lit(pct)) if expr is None else expr.when(cond, F.lit(pct))
    return expr.otherwise(F.lit(K.PERCENTILE_FLOOR)).cast("bigint")


def _listing(kind: str, arr: Column, default: str) -> Column:
    filled = F.when(F.size(arr) == 0, F.array(F.lit(default))).otherwise(arr)
    return F.struct(F.lit(kind).alias("kind"), filled.alias("items"))


def competitive_position(scored: DataFrame, problems: DataFrame, priority: DataFrame,
                         metrics: DataFrame | None = None) -> DataFrame:
    """Strengths, weaknesses and opportunities as tidy rows ``(kind, ord, text)``.

    Weaknesses list every problem type (``other`` included) above 15% of
    negatives, by display name, most frequent first; opportunities name the
    rank-1 improvement and a high negative share.  Each list falls back to a
    fixed text when empty.
    """
    m = metrics if metrics is not None else benchmark_metrics(scored)
    strengths = F.array_compact(F.array(
        F.when(F.col("positive_rate") > K.STRENGTH_POSITIVE_SHARE, F.lit(K.STRENGTH_TEXTS[0])),
        F.when(F.col("average_rating") > K.STRENGTH_MEAN_RATING, F.lit(K.STRENGTH_TEXTS[1])),
        F.when(F.col("five_star_rate") > K.STRENGTH_FIVE_STAR_SHARE, F.lit(K.STRENGTH_TEXTS[2])),
    ))
    names = problems.join(F.broadcast(template_frame(problems.sparkSession).select("problem_type", "category")),
                          "problem_type", "left")
    # at most one row per problem type: sorted and reduced to texts inside the subquery
    weak = (names.where(F.col("percentage") > K.WEAKNESS_PERCENT)
            .agg(F.transform(F.array_sort(F.collect_list(F.struct(
                (-F.col("count")).alias("k"), F.col("problem_type").alias("p"),
                F.concat(F.coalesce("category", "problem_type"), F.lit(K.WEAKNESS_SUFFIX)).alias("t")))),
                lambda x: x["t"]))
            .scalar())
    top = priority.where(F.col("priority_rank") == 1).agg(F.first("category")).scalar()
    opportunities = F.array_compact(F.array(
        F.when(top.isNotNull(), F.concat(top, F.lit(K.OPPORTUNITY_TOP_SUFFIX))),
        F.when(F.col("negative_sentiment_rate") > K.OPPORTUNITY_NEGATIVE_SHARE, F.lit(K.OPPORTUNITY_NEGATIVE_TEXT)),
    ))
    weak_texts = F.coalesce(weak, F.array().cast("array<string>"))
    lists = m.select(F.explode(F.array(
        _listing("strength", strengths, K.STRENGTH_DEFAULT),
        _listing("weakness", weak_texts, K.WEAKNESS_DEFAULT),
        _listing("opportunity", opportunities, K.OPPORTUNITY_DEFAULT),
    )).alias("l"))
    return lists.select(F.col("l.kind").alias("kind"), F.posexplode("l.items").alias("pos", "text")) \
        .select("kind", (F.col("pos") + 1).cast("bigint").alias("ord"), "text")


def position_summary(scored: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    m = metrics if metrics is not None else benchmark_metrics(scored)
    return m.select(percentile_position(F.col("average_rating")).alias("current_percentile"),
                    "average_rating", "negative_sentiment_rate")
