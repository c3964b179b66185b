"""Chart-ready aggregates (G1..G7); rendering is left to the caller.

Each chart input is a small frame produced by a partial-aggregating
``groupBy`` over the review table, or arithmetic on the (at most five-row)
suggestion and ROI frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from review_insights import constants as K
from review_insights.operators.patterns import _real_flag, drop_none_group
from review_insights.operators.priority import template_frame


def label_comparison(df: DataFrame, rule_col: str = "sentiment_label", model_col: str = "bert_sentiment") -> DataFrame:
    """Label counts of the rule-based and the model labels side by side (the full
    outer join of the two count tables: a label seen on either side, missing -> 0).

    One pass: each row contributes its two labels as (side, label) entries to a
    partial aggregate; the side-by-side form is a pivot of the few result rows.
    """
    entries = F.array(F.struct(F.lit("rule_based").alias("side"), F.col(rule_col).alias("label")),
                      F.struct(F.lit("model").alias("side"), F.col(model_col).alias("label")))
    counts = (df.select(F.inline(entries)).where(F.col("label").isNotNull())
              .groupBy("label", "side").agg(F.count(F.lit(1)).alias("n")))
    return counts.groupBy("label").agg(
        F.sum(F.when(F.col("side") == "rule_based", F.col("n")).otherwise(0)).cast("bigint").alias("rule_based"),
        F.sum(F.when(F.col("side") == "model", F.col("n")).otherwise(0)).cast("bigint").alias("model"))


def confidence_histogram(df: DataFrame, bins: int = K.CONFIDENCE_BINS, col: str = "bert_confidence") -> DataFrame:
    """Equal-width histogram between the observed min and max (max falls in the
    last bin; a constant column puts everything in bin 1), empty bins included,
    plus the mean as a marker column."""
    x = F.col(col)
    # partial counts per distinct value; the range and the bins are both taken from
    # this grouped frame, so they share its exchange and the table is read once
    vals = df.where(x.isNotNull() & ~F.isnan(x)).groupBy(x.alias("x")).agg(F.count(F.lit(1)).alias("n"))
    stats = vals.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi"),
                              (F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("mean")).alias("s")).scalar()
    lo, hi = stats["lo"], stats["hi"]
    b = F.when(hi > lo, F.least(F.floor((F.col("x") - lo) / (hi - lo) * bins), F.lit(bins - 1)) + 1).otherwise(F.lit(1))
    counts = (vals.groupBy(b.cast("bigint").alias("bin")).agg(F.sum("n").alias("n"))
              .agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("counts")).where(F.size("counts") > 0))
    frame = counts.select(F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(bins).cast("bigint"))).alias("bin"), "counts")
    return frame.select("bin",
                        (lo + (F.col("bin") - 1) * ((hi - lo) / bins)).alias("bin_start"),
                        (lo + F.col("bin") * ((hi - lo) / bins)).alias("bin_end"),
                        F.coalesce(F.element_at("counts", F.col("bin")), F.lit(0)).cast("bigint").alias("count"),
                        stats["mean"].alias("mean_value"))


def problem_share(df: DataFrame) -> DataFrame:
    """Share (%) of each problem type among rows whose problem is not ``none``."""
    per = drop_none_group(df.groupBy("problem_category")
                          .agg(F.count(F.lit(1)).alias("count"), _real_flag()))
    # at most seven aggregated rows: a global window is cheap
    return per.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy()) * 100)


def rating_sentiment_crosstab(df: DataFrame) -> DataFrame:
    """Per rating, the percentage of each model sentiment (rows normalised to 100)."""
    labels = [K.NEGATIVE, K.NEUTRAL, K.POSITIVE]
    counts = (df.where(F.col("rating").isNotNull() & F.col("bert_sentiment").isNotNull())
              .groupBy("rating").pivot("bert_sentiment", labels).count().na.fill(0, labels))
    total = sum((F.col(c) for c in labels[1:]), F.col(labels[0]))
    return counts.select("rating", *[(F.col(c) / total * 100).alias(c) for c in labels])


def sentiment_counts(df: DataFrame) -> DataFrame:
    """Count and share (% of all rows) for each sentiment; missing classes give 0."""
    labels = [K.POSITIVE, K.NEGATIVE, K.NEUTRAL]
    one = df.agg(F.count(F.lit(1)).alias("n"),
                 *[F.count_if(F.col("bert_sentiment") == lab).alias(lab) for lab in labels])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(lab).alias("sentiment"), F.col(lab).alias("count"),
                 (F.try_divide(F.col(lab), F.col("n")) * 100).alias("share")) for lab in labels])).alias("s")) \
        .select("s.*")


def priority_roi_points(suggestions: DataFrame, roi_by_category: DataFrame) -> DataFrame:
    """Priority bars, ROI bars and investment-vs-return points: suggestions left
    joined to the ROI table (missing return -> 0)."""
    r = roi_by_category.select("problem_type", "roi_percentage", "expected_revenue_recovery")
    return suggestions.join(r, "problem_type", "left").select(
        "priority_rank", "category", "problem_type", "priority_score", "estimated_cost",
        F.coalesce("roi_percentage", F.lit(0.0)).alias("roi_percentage"),
        F.coalesce("expected_revenue_recovery", F.lit(0.0)).alias("expected_return"))


def problem_display_counts(problems: DataFrame) -> DataFrame:
    """Problem counts under the template display names (unknown types keep their name)."""
    names = template_frame(problems.sparkSession).select("problem_type", "category")
    return problems.join(F.broadcast(names), "problem_type", "left").select(
        F.coalesce("category", "problem_type").alias("display_name"), "problem_type", "count")
