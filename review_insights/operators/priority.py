"""Improvement priority and suggestion records (I1..I10).

The inputs are bounded by construction: ``problem_analysis`` has at most one
row per problem type and the template dimension has five rows, so the joins
broadcast a 5-row literal and the ranking window sees at most five rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from review_insights import constants as K

TEMPLATE_SCHEMA = T.StructType([
    T.StructField("problem_type", T.StringType(), False),
    T.StructField("category", T.StringType(), False),
    T.StructField("suggestions", T.ArrayType(T.StringType(), False), False),
    T.StructField("base_cost", T.LongType(), False),
    T.StructField("impact_multiplier", T.DoubleType(), False),
    T.StructField("timeline", T.StringType(), False),
    T.StructField("template_ord", T.LongType(), False),
])


def template_frame(spark: SparkSession) -> DataFrame:
    """The five improvement templates as a literal dimension (template order kept)."""
    rows = [(p, c, list(s), int(cost), float(m), tl, i + 1)
            for i, (p, c, s, cost, m, tl) in enumerate(K.IMPROVEMENT_TEMPLATES)]
    return spark.createDataFrame(rows, TEMPLATE_SCHEMA)


def priority_scores(problems: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """Score each problem type that has a template (``other`` has none and drops out).

    frequency = share of negatives / 100, intensity = 1 - mean confidence,
    impact = template multiplier, ease = 1 / (cost / 25000);
    score = .4 freq + .3 intensity + .2 impact + .1 ease; roi_estimate = count * 10 / cost.
    Rounded values (score, freq, intensity, ease to 3 dp, roi to 2 dp) are the
    ones that drive the ranking and the success probability.
    """
    templates = templates if templates is not None else template_frame(problems.sparkSession)
    j = problems.join(templates, "problem_type", "inner")
    freq = F.col("percentage") / 100
    intensity = F.lit(1.0) - F.col("avg_confidence")
    impact = F.col("impact_multiplier")
    ease = F.lit(1.0) / (F.col("base_cost") / K.EASE_COST_UNIT)
    score = (freq * K.WEIGHT_FREQUENCY + intensity * K.WEIGHT_INTENSITY
             + impact * K.WEIGHT_IMPACT + ease * K.WEIGHT_EASE)
    roi = F.col("count") * K.REVENUE_PER_REVIEW_PRIORITY / F.col("base_cost")
    scored = j.select(
        "problem_type", "category", "template_ord", "suggestions", "timeline",
        F.round(score, 3).alias("priority_score"),
        F.round(freq, 3).alias("problem_frequency"),
        F.round(intensity, 3).alias("sentiment_intensity"),
        impact.alias("business_impact"),
        F.round(ease, 3).alias("implementation_ease"),
        F.col("base_cost").alias("estimated_cost"),
        F.round(roi, 2).alias("roi_estimate"),
        F.col("count").alias("affected_reviews"),
    )
    # at most five rows: an unpartitioned window is safe here
    rank = F.row_number().over(Window.orderBy(F.desc("priority_score"), F.asc("template_ord")))
    return scored.withColumn("priority_rank", rank.cast("bigint"))


def risk_level(cost) -> F.Column:
    return (F.when(cost > K.RISK_HIGH_COST, F.lit(K.RISK_HIGH))
            .when(cost > K.RISK_MID_COST, F.lit(K.RISK_MID))
            .otherwise(F.lit(K.RISK_LOW)))


def success_probability(score, roi) -> F.Column:
    bonus = F.least(roi * K.SUCCESS_ROI_WEIGHT, F.lit(K.SUCCESS_ROI_CAP))
    return F.least(F.lit(K.SUCCESS_BASE) + score * K.SUCCESS_PRIORITY_WEIGHT + bonus, F.lit(K.SUCCESS_MAX))


def improvement_suggestions(priority: DataFrame) -> DataFrame:
    """Suggestion records in priority order: template texts, timeline, risk and
    success probability added to each scored problem type."""
    return priority.select(
        "category", "problem_type", "priority_score", "priority_rank", "affected_reviews",
        "estimated_cost", "roi_estimate", "suggestions",
        F.coalesce(F.col("timeline"), F.lit(K.DEFAULT_TIMELINE)).alias("implementation_timeline"),
        risk_level(F.col("estimated_cost")).alias("risk_level"),
        success_probability(F.col("priority_score"), F.col("roi_estimate")).alias("success_probability"),
        "template_ord",
    )


def suggestion_actions(suggestions: DataFrame, first_n: int | None = None) -> DataFrame:
    """One row per action of each suggestion (1-based ``action_no``); ``first_n``
    keeps only the first actions, as the text report does with three."""
    arr = F.col("suggestions") if first_n is None else F.slice("suggestions", 1, first_n)
    return suggestions.select("priority_rank", "problem_type", "category",
                              F.posexplode(arr).alias("pos", "action")) \
        .select("priority_rank", "problem_type", "category",
                (F.col("pos") + 1).cast("bigint").alias("action_no"), "action")
