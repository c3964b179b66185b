"""Descriptive aggregates and data-quality checks over processed reviews (A1..A16).

Scalars are computed in one global ``agg`` (one scan); the three distributions
(rating, label, category) share one scan through grouping sets.  Every
aggregate pre-aggregates map-side, so skewed keys cost nothing extra.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from review_insights import constants as K
from review_insights.operators.sampling import exact_sample


def _neg() -> Column:
    return (F.col("sentiment_label") == K.NEGATIVE).cast("int")


def _ts_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def basic_info(df: DataFrame, approx_products: bool = False) -> DataFrame:
    """Rows, distinct products (exact, or HLL++ with ``approx_products``),
    distinct categories, first and last review date."""
    products = (F.approx_count_distinct("product_id") if approx_products
                else F.count_distinct("product_id"))
    return df.agg(
        F.count(F.lit(1)).alias("total_reviews"),
        products.alias("unique_products"),
        F.count_distinct("product_category").alias("unique_categories"),
        _ts_text(F.min("review_date")).alias("date_start"),
        _ts_text(F.max("review_date")).alias("date_end"),
    )


def rating_analysis(df: DataFrame) -> DataFrame:
    return df.agg(F.round(F.avg("rating"), 2).alias("average_rating"),
                  F.round(F.stddev_samp("rating"), 2).alias("rating_std"))


def rating_distribution(df: DataFrame) -> DataFrame:
    return df.where(F.col("rating").isNotNull()).groupBy("rating").agg(F.count(F.lit(1)).alias("count"))


def sentiment_analysis(df: DataFrame) -> DataFrame:
    """Negative share in percent (1 dp); the denominator is every row."""
    return df.agg(F.round(F.avg(F.coalesce(_neg(), F.lit(0))) * 100, 1).alias("negative_ratio"))


def label_distribution(df: DataFrame) -> DataFrame:
    return (df.where(F.col("sentiment_label").isNotNull()).groupBy("sentiment_label")
            .agg(F.count(F.lit(1)).alias("count")))


def category_analysis(df: DataFrame) -> DataFrame:
    return (df.where(F.col("product_category").isNotNull()).groupBy("product_category")
            .agg(F.count(F.lit(1)).alias("count"), F.round(F.avg("rating"), 2).alias("avg_rating")))


def text_analysis(df: DataFrame, approx_median: bool = False) -> DataFrame:
    """Mean and median length (1 dp) and verified share in percent (1 dp).

    The exact median buffers one entry per distinct length per task, which stays
    small for review lengths; ``approx_median`` switches to a quantile sketch.
    """
    med = (F.percentile_approx("review_length", 0.5, 10000) if approx_median
           else F.median("review_length"))
    verified = F.coalesce((F.col("verified_purchase") == F.lit(True)).cast("int"), F.lit(0))
    return df.agg(F.round(F.avg("review_length"), 1).alias("average_review_length"),
                  F.round(med, 1).alias("median_review_length"),
                  F.round(F.avg(verified) * 100, 1).alias("verified_purchase_ratio"))


def quality_metrics(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(F.col("is_high_quality") == F.lit(True)).alias("high_quality_reviews"),
                  F.count_if(F.col("total_votes") > 0).alias("reviews_with_votes"),
                  F.round(F.avg("helpfulness_ratio"), 3).alias("average_helpfulness"))


def null_audit(df: DataFrame) -> DataFrame:
    """Null count per column, only columns that have nulls; one scan, then unpivot
    of the single result row."""
    cols = df.columns
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    tidy = counts.unpivot([], cols, "column_name", "null_count")
    return tidy.where(F.col("null_count") > 0)


def short_reviews(df: DataFrame) -> DataFrame:
    n = F.count_if(F.col("review_length") < K.SHORT_REVIEW_LENGTH)
    return df.agg(n.alias("short_reviews")).withColumn("has_short_reviews", F.col("short_reviews") > 0)


def label_imbalance(df: DataFrame) -> DataFrame:
    """Flag when the smallest *present* label class holds under 5% of all rows."""
    # one pass: per-label counts including the null label, reduced on the driver-free side
    per = df.groupBy("sentiment_label").agg(F.count(F.lit(1)).alias("count"))
    return per.agg(F.min(F.when(F.col("sentiment_label").isNotNull(), F.col("count"))).alias("smallest_class"),
                   F.sum("count").alias("_total")).select(
        "smallest_class", (F.col("smallest_class") < F.lit(K.IMBALANCE_SHARE) * F.col("_total")).alias("imbalanced"))


def negative_overview(df: DataFrame) -> DataFrame:
    """Negative count and share of all rows (1 dp)."""
    return df.agg(F.count_if(F.col("sentiment_label") == K.NEGATIVE).alias("negative_count"),
                  F.round(F.count_if(F.col("sentiment_label") == K.NEGATIVE) / F.count(F.lit(1)) * 100, 1)
                  .alias("negative_share"))


def negative_by_category(df: DataFrame) -> DataFrame:
    return (df.where(F.col("product_category").isNotNull()).groupBy("product_category")
            .agg(F.round(F.count_if(F.col("sentiment_label") == K.NEGATIVE) / F.count(F.lit(1)) * 100, 1)
                 .alias("negative_rate")))


def worst_negative_reviews(df: DataFrame, n: int = 3, key: str = "review_id") -> DataFrame:
    """The n lowest-rated negative reviews, ties by key: a top-k (no full sort)."""
    return (df.where(F.col("sentiment_label") == K.NEGATIVE)
            .orderBy(F.asc("rating"), F.asc(key)).limit(n)
            .select(key, "product_name", "rating", F.substring("review_text", 1, 50).alias("text_head")))


def category_detail(df: DataFrame) -> DataFrame:
    return (df.where(F.col("product_category").isNotNull()).groupBy("product_category")
            .agg(F.count("rating").alias("rating_count"),
                 F.round(F.avg("rating"), 2).alias("rating_mean"),
                 F.round(F.stddev_samp("rating"), 2).alias("rating_std"),
                 F.round(F.avg("review_length"), 2).alias("review_length_mean"),
                 F.round(F.avg("helpfulness_ratio"), 2).alias("helpfulness_mean")))


def high_quality_comparison(df: DataFrame) -> DataFrame:
    """Share and mean rating of high-quality reviews vs the rest."""
    per = (df.groupBy("is_high_quality")
           .agg(F.count(F.lit(1)).alias("count"), F.avg("rating").alias("avg_rating")))
    # at most three aggregated rows; the share uses every row as denominator
    per = per.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy()) * 100)
    return per.where(F.col("is_high_quality").isNotNull())


def sample_reviews(df: DataFrame, n: int = 5, seed: int = 42, key: str = "review_id") -> DataFrame:
    """n reviews in a seeded pseudo-random order, the md5 of key and seed: a top-k for a few rows,
    selection of the n-th hash for many (:mod:`sampling`); the same rows in any engine with md5."""
    return exact_sample(df, n, [key], seed)


def preview(df: DataFrame, n: int = 5, columns: Sequence[str] | None = None, key: str = "review_id") -> DataFrame:
    """The first n rows in key order (a top-k, no full sort), with the wanted columns that exist."""
    wanted = [c for c in (columns or df.columns) if c in df.columns]
    return df.orderBy(F.asc(key)).limit(n).select(*wanted)


def upload_kpis(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_reviews"), F.round(F.avg("rating"), 2).alias("average_rating"))


def data_summary(df: DataFrame) -> DataFrame:
    """The full summary as tidy rows ``(section, metric, key, value, text)``.

    All scalars come from one aggregate pass; the rating, label and category
    distributions from one grouping-sets pass.
    """
    verified = F.coalesce((F.col("verified_purchase") == F.lit(True)).cast("int"), F.lit(0))
    s = df.agg(
        F.count(F.lit(1)).alias("total_reviews"),
        F.count_distinct("product_id").alias("unique_products"),
        F.count_distinct("product_category").alias("unique_categories"),
        _ts_text(F.min("review_date")).alias("date_start"),
        _ts_text(F.max("review_date")).alias("date_end"),
        F.round(F.avg("rating"), 2).alias("average_rating"),
        F.round(F.stddev_samp("rating"), 2).alias("rating_std"),
        F.round(F.avg(F.coalesce(_neg(), F.lit(0))) * 100, 1).alias("negative_ratio"),
        F.round(F.avg("review_length"), 1).alias("average_review_length"),
        F.round(F.median("review_length"), 1).alias("median_review_length"),
        F.round(F.avg(verified) * 100, 1).alias("verified_purchase_ratio"),
        F.count_if(F.col("is_high_quality") == F.lit(True)).alias("high_quality_reviews"),
        F.count_if(F.col("total_votes") > 0).alias("reviews_with_votes"),
        F.round(F.avg("helpfulness_ratio"), 3).alias("average_helpfulness"),
    )
    scalar_rows = [
        ("basic_info", "total_reviews"), ("basic_info", "unique_products"),
        ("basic_info", "unique_categories"), ("rating_analysis", "average_rating"),
        ("rating_analysis", "rating_std"), ("sentiment_analysis", "negative_ratio"),
        ("text_analysis", "average_review_length"), ("text_analysis", "median_review_length"),
        ("text_analysis", "verified_purchase_ratio"), ("quality_metrics", "high_quality_reviews"),
        ("quality_metrics", "reviews_with_votes"), ("quality_metrics", "average_helpfulness"),
    ]
    entries = [F.struct(F.lit(sec).alias("section"), F.lit(m).alias("metric"),
                        F.lit(None).cast("string").alias("key"),
                        F.col(m).cast("double").alias("value"),
                        F.lit(None).cast("string").alias("text")) for sec, m in scalar_rows]
    entries += [F.struct(F.lit("basic_info").alias("section"), F.lit(m).alias("metric"),
                         F.lit(None).cast("string").alias("key"), F.lit(None).cast("double").alias("value"),
                         F.col(m).alias("text")) for m in ("date_start", "date_end")]
    scalars = s.select(F.explode(F.array(*entries)).alias("e")).select("e.*")

    dist = (df.groupingSets([["rating"], ["sentiment_label"], ["product_category"]],
                            "rating", "sentiment_label", "product_category")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("rating").alias("mean_rating"),
                 F.grouping_id().alias("gid")))
    # grouping_id bits: rating=4, sentiment_label=2, product_category=1 (1 = aggregated away).
    # Every output row of the one grouping-sets pass is mapped to its entries
    # by a generator, not by filtered copies of the aggregate (each copy would
    # be a separate pass over the table).
    def entry(cond, section, metric, key, value):
        return F.when(cond, F.struct(F.lit(section).alias("section"), F.lit(metric).alias("metric"),
                                     key.alias("key"), value.cast("double").alias("value"),
                                     F.lit(None).cast("string").alias("text")))

    gid = F.col("gid")
    is_cat = (gid == 6) & F.col("product_category").isNotNull()
    dist_entries = F.array(
        entry((gid == 3) & F.col("rating").isNotNull(), "rating_analysis", "rating_distribution",
              F.col("rating").cast("string"), F.col("n")),
        entry((gid == 5) & F.col("sentiment_label").isNotNull(), "sentiment_analysis", "sentiment_distribution",
              F.col("sentiment_label"), F.col("n")),
        entry(is_cat, "category_analysis", "category_distribution", F.col("product_category"), F.col("n")),
        entry(is_cat, "category_analysis", "category_ratings", F.col("product_category"),
              F.round("mean_rating", 2)),
    )
    distributions = (dist.select(F.explode(dist_entries).alias("e")).where(F.col("e").isNotNull())
                     .select("e.*"))
    return scalars.unionByName(distributions)
