"""ROI estimates (O1..O8).

Three different "ROI" figures exist and keep distinct names:
``roi_estimate`` (priority ratio: $10 per review / cost), ``roi_percentage``
(gross: $255 per review / cost x 100) and ``net_roi_percentage`` (dashboard
portfolio: (return - cost) / cost x 100).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from review_insights import constants as K


def roi_by_category(suggestions: DataFrame) -> DataFrame:
    """Per suggestion: investment, potential and expected recovery, gross ROI %,
    payback months and risk-adjusted ROI %."""
    cost = F.col("estimated_cost")
    potential = F.col("affected_reviews") * K.REVENUE_LOSS_PER_REVIEW
    expected = potential * K.IMPROVEMENT_RATE * K.ANNUAL_MULTIPLIER
    return suggestions.select(
        "problem_type", "category", "priority_rank",
        cost.alias("investment"),
        potential.alias("potential_revenue_recovery"),
        expected.alias("expected_revenue_recovery"),
        (F.try_divide(expected, cost) * 100).alias("roi_percentage"),
        F.try_divide(cost, expected / 12).alias("payback_period_months"),
        (F.try_divide(expected * F.col("success_probability"), cost) * 100).alias("risk_adjusted_roi"),
    )


def roi_overall(by_category: DataFrame) -> DataFrame:
    """Totals and overall gross ROI % (0 when nothing is invested)."""
    inv = F.coalesce(F.sum("investment"), F.lit(0)).cast("bigint")
    ret = F.coalesce(F.sum("expected_revenue_recovery"), F.lit(0.0))
    return by_category.agg(inv.alias("total_investment"), ret.alias("total_expected_return")).withColumn(
        "overall_roi_percentage",
        F.when(F.col("total_investment") > 0,
               F.col("total_expected_return") / F.col("total_investment") * 100).otherwise(F.lit(0.0)))


def override_frame(spark: SparkSession) -> DataFrame:
    schema = T.StructType([T.StructField("category", T.StringType(), False),
                           T.StructField("roi_override", T.DoubleType(), False)])
    return spark.createDataFrame([(c, float(v)) for c, v in K.ROI_OVERRIDES], schema)


def dashboard_roi(suggestions: DataFrame, apply_override: bool = False) -> DataFrame:
    """Dashboard ROI view of the suggestion export.

    ``roi_corrected`` is ``roi_estimate`` unless ``apply_override`` is set, in
    which case values under 0.05 are replaced by fixed per-category figures
    (unknown categories keep their value).  Off by default: it substitutes
    constants for computed data.  Rows whose corrected ROI is not numeric are
    dropped; expected return = cost x (1 + roi), null on the card when cost <= 0.
    """
    roi = F.col("roi_estimate").cast("double")
    df = suggestions
    if apply_override:
        df = df.join(F.broadcast(override_frame(df.sparkSession)), "category", "left")
        corrected = F.when(roi < K.ROI_OVERRIDE_THRESHOLD, F.coalesce(F.col("roi_override"), roi)).otherwise(roi)
    else:
        corrected = roi
    df = df.withColumn("roi_corrected", corrected)
    df = df.where(F.col("roi_corrected").isNotNull() & ~F.isnan("roi_corrected"))
    cost = F.col("estimated_cost")
    return df.select(
        "priority_rank", "category", "problem_type", "priority_score", "estimated_cost", "roi_estimate",
        "roi_corrected",
        (F.col("roi_corrected") * 100).alias("roi_percentage_calc"),
        (cost * (F.lit(1.0) + F.col("roi_corrected"))).alias("expected_return_calc"),
        F.when(cost > 0, cost * (F.lit(1.0) + F.col("roi_corrected"))).alias("expected_return_card"),
    )


def roi_ranking(dashboard: DataFrame) -> DataFrame:
    """ROI efficiency ranking: corrected ROI % descending, ties by priority rank.

    The window runs over the suggestions, at most one row per problem type.
    """
    w = Window.orderBy(F.desc("roi_percentage_calc"), F.asc("priority_rank"))
    return dashboard.withColumn("efficiency_rank", F.row_number().over(w).cast("bigint"))


def portfolio_totals(dashboard: DataFrame) -> DataFrame:
    """Total cost, total expected return and net ROI % = (return - cost) / cost x 100."""
    return dashboard.agg(
        F.sum("estimated_cost").cast("bigint").alias("total_investment"),
        F.sum("expected_return_calc").alias("total_return"),
    ).withColumn("net_roi_percentage",
                 F.try_divide(F.col("total_return") - F.col("total_investment"), F.col("total_investment")) * 100)
