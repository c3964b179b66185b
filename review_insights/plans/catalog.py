"""Registered queries: one per operator of the inventory, each with its SQL twin.

Every query reads the driver tables (the review rows derive from ``lineitem``)
and runs over whole tables.  Float outputs are rounded to 6 decimals and
integers are BIGINT in both engines so results compare exactly; dates are
rendered as ``yyyy-MM-dd HH:mm:ss`` text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from review_insights import constants as K
from review_insights import oracle as O
from review_insights import streaming
from review_insights.operators import (benchmark, charts, conform, gate, keywords, patterns, preprocess, priority, problems,
                                       reports, roi, scoring, summary, validation)
from review_insights.operators.dims import rows_once, spread
from review_insights.operators.row_index import with_file_position
from review_insights.plans import frames
from review_insights.session import ensure_utc, table_path
from review_insights.sources import fixture, sinks, versions
from review_insights.sources.readers import normalise_missing, read_reviews
from review_insights.streaming import keyword_state, state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str | Callable[[], str]] = {}


def register(name: str, oracle: str | Callable[[], str] | None = None):
    """Register a query and its SQL twin.  A twin may be a callable; SQL text is
    rendered by :func:`oracle_sql` only, so importing this module needs no session."""
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def oracle_sql() -> dict[str, str]:
    """The SQL twin of every query that has one."""
    return {name: O.sql(body() if callable(body) else body) for name, body in ORACLE.items()}


def r6(c) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def ts_text(c: str) -> Column:
    return F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss")


# ---------------------------------------------------------------- flagship --

@register("problem_analysis", """
SELECT problem_type, cnt AS count, round(percentage, 6) AS percentage,
       round(avg_rating, 6) AS avg_rating, round(avg_confidence, 6) AS avg_confidence
FROM problem_analysis
""")
def q_problem_analysis(spark, sf_dir):
    pa = patterns.problem_analysis(frames.scored(spark, sf_dir))
    return pa.select("problem_type", "count", r6("percentage").alias("percentage"),
                     r6("avg_rating").alias("avg_rating"), r6("avg_confidence").alias("avg_confidence"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_problem_analysis(spark, sf_dir)


# ----------------------------------------------------------------- conform --

@register("conform", """
SELECT review_id, product_id, user_id, rating, review_title, review_text,
       strftime(review_date, '%Y-%m-%d %H:%M:%S') AS review_date, product_name, product_category,
       helpful_votes, total_votes, verified_purchase, bert_sentiment, round(bert_confidence, 6) AS bert_confidence
FROM review
""")
def q_conform(spark, sf_dir):
    df = frames.conformed(spark, sf_dir)
    return df.select("review_id", "product_id", "user_id", "rating", "review_title", "review_text",
                     ts_text("review_date").alias("review_date"), "product_name", "product_category",
                     "helpful_votes", "total_votes", "verified_purchase", "bert_sentiment",
                     r6("bert_confidence").alias("bert_confidence"))


@register("csv_scan", """
SELECT review_id, product_id, user_id, rating, review_title, review_text,
       strftime(review_date, '%Y-%m-%d %H:%M:%S') AS review_date, product_name, product_category,
       helpful_votes, total_votes, verified_purchase, bert_sentiment, round(bert_confidence, 6) AS bert_confidence
FROM review
""")
def q_csv_scan(spark, sf_dir):
    """The conform query, but starting from the CSV export of the raw reviews."""
    ensure_utc(spark)
    df = conform.conform_reviews(fixture.review_raw_csv(spark, sf_dir))
    return df.select("review_id", "product_id", "user_id", "rating", "review_title", "review_text",
                     ts_text("review_date").alias("review_date"), "product_name", "product_category",
                     "helpful_votes", "total_votes", "verified_purchase", "bert_sentiment",
                     r6("bert_confidence").alias("bert_confidence"))


@register("preprocess", """
SELECT review_id, review_text_clean, review_length, round(rating_normalized, 6) AS rating_normalized,
       sentiment_label, round(helpfulness_ratio, 6) AS helpfulness_ratio, review_year, review_month,
       product_category, round(category_mean, 6) AS category_mean, round(category_std, 6) AS category_std,
       category_count, is_high_quality
FROM processed
""")
def q_preprocess(spark, sf_dir):
    df = frames.processed(spark, sf_dir)
    return df.select("review_id", "review_text_clean", "review_length", r6("rating_normalized").alias("rating_normalized"),
                     "sentiment_label", r6("helpfulness_ratio").alias("helpfulness_ratio"), "review_year",
                     "review_month", "product_category", r6("category_mean").alias("category_mean"),
                     r6("category_std").alias("category_std"), "category_count", "is_high_quality")


@register("classify_problems", """
SELECT review_id, bert_sentiment, problem_category FROM scored
""")
def q_classify(spark, sf_dir):
    return frames.scored(spark, sf_dir).select("review_id", "bert_sentiment", "problem_category")


# ----------------------------------------------------------------- summary --

def _lean(spark, sf_dir):
    """Processed reviews without the category-statistics join (same rows)."""
    return frames.processed(spark, sf_dir, with_category_stats=False)


@register("summary_basic_info", """
SELECT count(*) AS total_reviews, count(DISTINCT product_id) AS unique_products,
       count(DISTINCT product_category) AS unique_categories,
       strftime(min(review_date), '%Y-%m-%d %H:%M:%S') AS date_start,
       strftime(max(review_date), '%Y-%m-%d %H:%M:%S') AS date_end
FROM base
""")
def q_basic_info(spark, sf_dir):
    return summary.basic_info(_lean(spark, sf_dir))


@register("summary_rating", """
SELECT round(avg(rating), 2) AS average_rating, round(stddev_samp(rating), 2) AS rating_std FROM base
""")
def q_rating(spark, sf_dir):
    return summary.rating_analysis(_lean(spark, sf_dir))


@register("summary_rating_distribution", """
SELECT rating, count(*) AS count FROM base WHERE rating IS NOT NULL GROUP BY rating
""")
def q_rating_dist(spark, sf_dir):
    return summary.rating_distribution(_lean(spark, sf_dir))


@register("summary_sentiment", """
SELECT round(avg(CASE WHEN sentiment_label = 'negative' THEN 1 ELSE 0 END) * 100, 1) AS negative_ratio FROM base
""")
def q_sentiment(spark, sf_dir):
    return summary.sentiment_analysis(_lean(spark, sf_dir))


@register("summary_label_distribution", """
SELECT sentiment_label, count(*) AS count FROM base WHERE sentiment_label IS NOT NULL GROUP BY sentiment_label
""")
def q_label_dist(spark, sf_dir):
    return summary.label_distribution(_lean(spark, sf_dir))


@register("summary_category", """
SELECT product_category, count(*) AS count, round(avg(rating), 2) AS avg_rating
FROM base WHERE product_category IS NOT NULL GROUP BY product_category
""")
def q_category(spark, sf_dir):
    return summary.category_analysis(_lean(spark, sf_dir))


@register("summary_text", """
SELECT round(avg(review_length), 1) AS average_review_length,
       round(median(review_length), 1) AS median_review_length,
       round(avg(CASE WHEN verified_purchase THEN 1 ELSE 0 END) * 100, 1) AS verified_purchase_ratio
FROM base
""")
def q_text(spark, sf_dir):
    return summary.text_analysis(_lean(spark, sf_dir))


@register("summary_quality", """
SELECT count(*) FILTER (WHERE is_high_quality) AS high_quality_reviews,
       count(*) FILTER (WHERE total_votes > 0) AS reviews_with_votes,
       round(avg(helpfulness_ratio), 3) AS average_helpfulness
FROM base
""")
def q_quality(spark, sf_dir):
    return summary.quality_metrics(_lean(spark, sf_dir))


PROCESSED_COLUMNS = (
    "review_id", "product_id", "user_id", "rating", "review_title", "review_text", "review_date",
    "product_name", "product_category", "helpful_votes", "total_votes", "verified_purchase",
    "bert_sentiment", "bert_confidence", "review_text_clean", "review_length", "rating_normalized",
    "sentiment_label", "helpfulness_ratio", "review_year", "review_month", "category_mean",
    "category_std", "category_count", "is_high_quality",
)


@register("null_audit", "SELECT column_name, null_count FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_count FROM processed"
    for c in PROCESSED_COLUMNS) + ") WHERE null_count > 0")
def q_null_audit(spark, sf_dir):
    return summary.null_audit(frames.processed(spark, sf_dir).select(*PROCESSED_COLUMNS))


@register("short_reviews", """
SELECT count(*) FILTER (WHERE review_length < 10) AS short_reviews,
       count(*) FILTER (WHERE review_length < 10) > 0 AS has_short_reviews
FROM base
""")
def q_short(spark, sf_dir):
    return summary.short_reviews(_lean(spark, sf_dir))


@register("label_imbalance", """
SELECT min(cnt) AS smallest_class, min(cnt) < 0.05 * (SELECT count(*) FROM base) AS imbalanced
FROM (SELECT sentiment_label, count(*) AS cnt FROM base WHERE sentiment_label IS NOT NULL GROUP BY 1)
""")
def q_imbalance(spark, sf_dir):
    return summary.label_imbalance(_lean(spark, sf_dir))


@register("negative_overview", """
SELECT count(*) FILTER (WHERE sentiment_label = 'negative') AS negative_count,
       round(count(*) FILTER (WHERE sentiment_label = 'negative') / count(*) * 100, 1) AS negative_share
FROM base
""")
def q_negative_overview(spark, sf_dir):
    return summary.negative_overview(_lean(spark, sf_dir))


@register("negative_by_category", """
SELECT product_category,
       round(count(*) FILTER (WHERE sentiment_label = 'negative') / count(*) * 100, 1) AS negative_rate
FROM base WHERE product_category IS NOT NULL GROUP BY product_category
""")
def q_negative_by_category(spark, sf_dir):
    return summary.negative_by_category(_lean(spark, sf_dir))


@register("worst_negative_reviews", """
SELECT review_id, product_name, rating, substr(review_text, 1, 50) AS text_head
FROM base WHERE sentiment_label = 'negative' ORDER BY rating, review_id LIMIT 3
""")
def q_worst(spark, sf_dir):
    return summary.worst_negative_reviews(_lean(spark, sf_dir))


@register("category_detail", """
SELECT product_category, count(rating) AS rating_count, round(avg(rating), 2) AS rating_mean,
       round(stddev_samp(rating), 2) AS rating_std, round(avg(review_length), 2) AS review_length_mean,
       round(avg(helpfulness_ratio), 2) AS helpfulness_mean
FROM base WHERE product_category IS NOT NULL GROUP BY product_category
""")
def q_category_detail(spark, sf_dir):
    return summary.category_detail(_lean(spark, sf_dir))


@register("high_quality_comparison", """
SELECT is_high_quality, count(*) AS count, round(avg(rating), 6) AS avg_rating,
       round(count(*) / (SELECT count(*) FROM base) * 100, 6) AS share
FROM base WHERE is_high_quality IS NOT NULL GROUP BY is_high_quality
""")
def q_hq(spark, sf_dir):
    hq = summary.high_quality_comparison(_lean(spark, sf_dir))
    return hq.select("is_high_quality", "count", r6("avg_rating").alias("avg_rating"), r6("share").alias("share"))


SAMPLE_COLUMNS = ("review_id", "product_name", "product_category", "rating", "sentiment_label",
                  "review_text", "verified_purchase", "review_length")


@register("sample_reviews", f"""
SELECT {', '.join(SAMPLE_COLUMNS)} FROM base
ORDER BY md5(review_id || '|42'), review_id LIMIT 5
""")
def q_sample(spark, sf_dir):
    return summary.sample_reviews(_lean(spark, sf_dir), 5, 42).select(*SAMPLE_COLUMNS)


LARGE_SAMPLE = 20_000


@register("sample_reviews_large", f"""
SELECT {', '.join(SAMPLE_COLUMNS)} FROM base
ORDER BY md5(review_id || '|42'), review_id LIMIT {LARGE_SAMPLE}
""")
def q_sample_large(spark, sf_dir):
    """A14 for many rows: the n-th hash is found by selection, nothing is sorted in one place."""
    return summary.sample_reviews(_lean(spark, sf_dir).select(*SAMPLE_COLUMNS), LARGE_SAMPLE, 42)


@register("upload_kpis", """
SELECT count(*) AS total_reviews, round(avg(rating), 2) AS average_rating FROM review
""")
def q_upload_kpis(spark, sf_dir):
    return summary.upload_kpis(frames.conformed(spark, sf_dir))


@register("data_summary", """
WITH s AS (
  SELECT count(*) AS total_reviews, count(DISTINCT product_id) AS unique_products,
         count(DISTINCT product_category) AS unique_categories,
         strftime(min(review_date), '%Y-%m-%d %H:%M:%S') AS date_start,
         strftime(max(review_date), '%Y-%m-%d %H:%M:%S') AS date_end,
         round(avg(rating), 2) AS average_rating, round(stddev_samp(rating), 2) AS rating_std,
         round(avg(CASE WHEN sentiment_label = 'negative' THEN 1 ELSE 0 END) * 100, 1) AS negative_ratio,
         round(avg(review_length), 1) AS average_review_length,
         round(median(review_length), 1) AS median_review_length,
         round(avg(CASE WHEN verified_purchase THEN 1 ELSE 0 END) * 100, 1) AS verified_purchase_ratio,
         count(*) FILTER (WHERE is_high_quality) AS high_quality_reviews,
         count(*) FILTER (WHERE total_votes > 0) AS reviews_with_votes,
         round(avg(helpfulness_ratio), 3) AS average_helpfulness
  FROM base
)
SELECT 'basic_info' AS section, 'total_reviews' AS metric, NULL::VARCHAR AS key, total_reviews::DOUBLE AS value, NULL::VARCHAR AS text FROM s
UNION ALL SELECT 'basic_info', 'unique_products', NULL, unique_products::DOUBLE, NULL FROM s
UNION ALL SELECT 'basic_info', 'unique_categories', NULL, unique_categories::DOUBLE, NULL FROM s
UNION ALL SELECT 'rating_analysis', 'average_rating', NULL, average_rating, NULL FROM s
UNION ALL SELECT 'rating_analysis', 'rating_std', NULL, rating_std, NULL FROM s
UNION ALL SELECT 'sentiment_analysis', 'negative_ratio', NULL, negative_ratio, NULL FROM s
UNION ALL SELECT 'text_analysis', 'average_review_length', NULL, average_review_length, NULL FROM s
UNION ALL SELECT 'text_analysis', 'median_review_length', NULL, median_review_length, NULL FROM s
UNION ALL SELECT 'text_analysis', 'verified_purchase_ratio', NULL, verified_purchase_ratio, NULL FROM s
UNION ALL SELECT 'quality_metrics', 'high_quality_reviews', NULL, high_quality_reviews::DOUBLE, NULL FROM s
UNION ALL SELECT 'quality_metrics', 'reviews_with_votes', NULL, reviews_with_votes::DOUBLE, NULL FROM s
UNION ALL SELECT 'quality_metrics', 'average_helpfulness', NULL, average_helpfulness, NULL FROM s
UNION ALL SELECT 'basic_info', 'date_start', NULL, NULL, date_start FROM s
UNION ALL SELECT 'basic_info', 'date_end', NULL, NULL, date_end FROM s
UNION ALL SELECT 'rating_analysis', 'rating_distribution', CAST(rating AS VARCHAR), count(*)::DOUBLE, NULL
  FROM base WHERE rating IS NOT NULL GROUP BY rating
UNION ALL SELECT 'sentiment_analysis', 'sentiment_distribution', sentiment_label, count(*)::DOUBLE, NULL
  FROM base WHERE sentiment_label IS NOT NULL GROUP BY sentiment_label
UNION ALL SELECT 'category_analysis', 'category_distribution', product_category, count(*)::DOUBLE, NULL
  FROM base WHERE product_category IS NOT NULL GROUP BY product_category
UNION ALL SELECT 'category_analysis', 'category_ratings', product_category, round(avg(rating), 2), NULL
  FROM base WHERE product_category IS NOT NULL GROUP BY product_category
""")
def q_data_summary(spark, sf_dir):
    return summary.data_summary(_lean(spark, sf_dir))


# ------------------------------------------------------ patterns (phase 3) --

def _problems(spark, sf_dir):
    return patterns.problem_analysis(frames.scored(spark, sf_dir))


def _problems_once(spark, sf_dir):
    """One row per problem type (a closed set of six), computed once per query:
    several reports refer to it more than once."""
    return rows_once(_problems(spark, sf_dir))


def _suggestions(spark, sf_dir):
    return priority.improvement_suggestions(priority.priority_scores(_problems_once(spark, sf_dir)))


@register("negative_count", "SELECT count(*) AS negative_count FROM neg")
def q_negative_count(spark, sf_dir):
    return patterns.negative_count(frames.scored(spark, sf_dir))


@register("load_distributions", """
SELECT 'sentiment' AS dimension, bert_sentiment AS key, count(*) AS count FROM scored
  WHERE bert_sentiment IS NOT NULL GROUP BY bert_sentiment
UNION ALL SELECT 'problem', problem_category, count(*) FROM neg GROUP BY problem_category
UNION ALL SELECT 'rating', CAST(rating AS VARCHAR), count(*) FROM scored WHERE rating IS NOT NULL GROUP BY rating
""")
def q_load_distributions(spark, sf_dir):
    return patterns.load_distributions(frames.scored(spark, sf_dir))


@register("rating_problem_mix", """
SELECT rating, problem_category, count(*) AS count,
       sum(count(*)) OVER (PARTITION BY rating)::BIGINT AS rating_count
FROM neg WHERE rating IS NOT NULL GROUP BY rating, problem_category
""")
def q_rating_problem_mix(spark, sf_dir):
    return patterns.rating_problem_mix(frames.scored(spark, sf_dir))


@register("confidence_analysis", """
SELECT round(avg(bert_confidence), 6) AS avg_confidence,
       count(*) FILTER (WHERE bert_confidence > 0.8) AS high_confidence_count,
       count(*) FILTER (WHERE bert_confidence < 0.6) AS low_confidence_count
FROM neg
""")
def q_confidence(spark, sf_dir):
    c = patterns.confidence_analysis(frames.scored(spark, sf_dir))
    return c.select(r6("avg_confidence").alias("avg_confidence"), "high_confidence_count", "low_confidence_count")


@register("top_problem", """
SELECT problem_type, cnt AS count FROM problem_analysis ORDER BY cnt DESC, problem_type LIMIT 1
""")
def q_top_problem(spark, sf_dir):
    return patterns.top_problem(_problems(spark, sf_dir))


# --------------------------------------------------------------- priority --

@register("priority_scores", """
SELECT problem_type, category, priority_score, problem_frequency, sentiment_intensity, business_impact,
       implementation_ease, estimated_cost, roi_estimate, affected_reviews, priority_rank
FROM priority
""")
def q_priority(spark, sf_dir):
    p = priority.priority_scores(_problems(spark, sf_dir))
    return p.select("problem_type", "category", "priority_score", "problem_frequency", "sentiment_intensity",
                    "business_impact", "implementation_ease", "estimated_cost", "roi_estimate",
                    "affected_reviews", "priority_rank")


@register("improvement_suggestions", """
SELECT category, problem_type, priority_score, priority_rank, affected_reviews, estimated_cost, roi_estimate,
       implementation_timeline, risk_level, round(success_probability, 6) AS success_probability,
       suggestions[1] AS first_action, len(suggestions) AS action_count
FROM suggestions
""")
def q_suggestions(spark, sf_dir):
    s = _suggestions(spark, sf_dir)
    return s.select("category", "problem_type", "priority_score", "priority_rank", "affected_reviews",
                    "estimated_cost", "roi_estimate", "implementation_timeline", "risk_level",
                    r6("success_probability").alias("success_probability"),
                    F.element_at("suggestions", 1).alias("first_action"),
                    F.size("suggestions").cast("bigint").alias("action_count"))


@register("suggestion_actions", """
SELECT priority_rank, problem_type, category, CAST(generate_subscripts(suggestions, 1) AS BIGINT) AS action_no,
       unnest(suggestions) AS action
FROM suggestions
""")
def q_suggestion_actions(spark, sf_dir):
    return priority.suggestion_actions(_suggestions(spark, sf_dir))


@register("suggestion_export", """
SELECT priority_rank, category, problem_type, priority_score, affected_reviews, estimated_cost, roi_estimate,
       implementation_timeline, risk_level, round(success_probability, 6) AS success_probability,
       coalesce(suggestions[1], '') AS top_suggestion
FROM suggestions
""")
def q_suggestion_export(spark, sf_dir):
    e = sinks.suggestion_export(_suggestions(spark, sf_dir))
    return e.withColumn("success_probability", r6("success_probability"))


# -------------------------------------------------------------------- ROI --

@register("roi_by_category", """
SELECT problem_type, category, priority_rank, investment, potential_revenue_recovery,
       round(expected_revenue_recovery, 6) AS expected_revenue_recovery, round(roi_percentage, 6) AS roi_percentage,
       round(payback_period_months, 6) AS payback_period_months, round(risk_adjusted_roi, 6) AS risk_adjusted_roi
FROM roi
""")
def q_roi_by_category(spark, sf_dir):
    r = roi.roi_by_category(_suggestions(spark, sf_dir))
    return r.select("problem_type", "category", "priority_rank", "investment", "potential_revenue_recovery",
                    *[r6(c).alias(c) for c in ("expected_revenue_recovery", "roi_percentage",
                                               "payback_period_months", "risk_adjusted_roi")])


@register("roi_overall", """
SELECT CAST(coalesce(sum(investment), 0) AS BIGINT) AS total_investment,
       round(coalesce(sum(expected_revenue_recovery), 0), 6) AS total_expected_return,
       round(CASE WHEN coalesce(sum(investment), 0) > 0
                  THEN coalesce(sum(expected_revenue_recovery), 0) / sum(investment) * 100 ELSE 0 END, 6)
         AS overall_roi_percentage
FROM roi
""")
def q_roi_overall(spark, sf_dir):
    o = roi.roi_overall(roi.roi_by_category(_suggestions(spark, sf_dir)))
    return o.select("total_investment", r6("total_expected_return").alias("total_expected_return"),
                    r6("overall_roi_percentage").alias("overall_roi_percentage"))


_DASH_SQL = """
dash AS (
  SELECT s.*, CASE WHEN roi_estimate < 0.05 THEN coalesce(o.roi_override, roi_estimate) ELSE roi_estimate END
           AS roi_corrected
  FROM suggestions s LEFT JOIN (VALUES {overrides}) AS o(category, roi_override) USING (category)
),
dash2 AS (
  SELECT priority_rank, category, problem_type, priority_score, estimated_cost, roi_estimate, roi_corrected,
         roi_corrected * 100 AS roi_percentage_calc,
         estimated_cost * (CAST(1 AS DOUBLE) + roi_corrected) AS expected_return_calc,
         CASE WHEN estimated_cost > 0 THEN estimated_cost * (CAST(1 AS DOUBLE) + roi_corrected) END AS expected_return_card
  FROM dash WHERE roi_corrected IS NOT NULL AND NOT isnan(roi_corrected)
)""".format(overrides=", ".join(f"('{c}', CAST({v} AS DOUBLE))" for c, v in K.ROI_OVERRIDES))


@register("roi_dashboard", "WITH " + _DASH_SQL + """
SELECT priority_rank, category, problem_type, priority_score, estimated_cost, roi_estimate,
       round(roi_corrected, 6) AS roi_corrected, round(roi_percentage_calc, 6) AS roi_percentage_calc,
       round(expected_return_calc, 6) AS expected_return_calc, round(expected_return_card, 6) AS expected_return_card
FROM dash2
""")
def q_roi_dashboard(spark, sf_dir):
    d = roi.dashboard_roi(_suggestions(spark, sf_dir), apply_override=True)
    return d.select("priority_rank", "category", "problem_type", "priority_score", "estimated_cost", "roi_estimate",
                    *[r6(c).alias(c) for c in ("roi_corrected", "roi_percentage_calc", "expected_return_calc",
                                               "expected_return_card")])


@register("roi_ranking", "WITH " + _DASH_SQL + """
SELECT row_number() OVER (ORDER BY roi_percentage_calc DESC, priority_rank) AS efficiency_rank, category,
       round(roi_percentage_calc, 6) AS roi_percentage_calc, estimated_cost,
       round(expected_return_calc, 6) AS expected_return_calc
FROM dash2
""")
def q_roi_ranking(spark, sf_dir):
    d = roi.roi_ranking(roi.dashboard_roi(_suggestions(spark, sf_dir), apply_override=True))
    return d.select("efficiency_rank", "category", r6("roi_percentage_calc").alias("roi_percentage_calc"), "estimated_cost",
                    r6("expected_return_calc").alias("expected_return_calc"))


@register("roi_portfolio", "WITH " + _DASH_SQL + """
SELECT CAST(sum(estimated_cost) AS BIGINT) AS total_investment, round(sum(expected_return_calc), 6) AS total_return,
       round((sum(expected_return_calc) - sum(estimated_cost)) / sum(estimated_cost) * 100, 6) AS net_roi_percentage
FROM dash2
""")
def q_roi_portfolio(spark, sf_dir):
    p = roi.portfolio_totals(roi.dashboard_roi(_suggestions(spark, sf_dir), apply_override=True))
    return p.select("total_investment", r6("total_return").alias("total_return"),
                    r6("net_roi_percentage").alias("net_roi_percentage"))


@register("roi_detail", f"""
SELECT {', '.join(K.ROI_DETAIL_COLUMNS).replace('success_probability', 'round(success_probability, 6) AS success_probability')}
FROM suggestions
""")
def q_roi_detail(spark, sf_dir):
    d = sinks.select_available(_suggestions(spark, sf_dir), K.ROI_DETAIL_COLUMNS)
    return d.withColumn("success_probability", r6("success_probability"))


# -------------------------------------------------------------- benchmark --

@register("benchmark_metrics", """
SELECT round(average_rating, 6) AS average_rating, round(negative_sentiment_rate, 6) AS negative_sentiment_rate,
       round(top_quartile_rating, 6) AS top_quartile_rating, round(bottom_quartile_rating, 6) AS bottom_quartile_rating
FROM bench
""")
def q_benchmark_metrics(spark, sf_dir):
    m = benchmark.benchmark_metrics(frames.scored(spark, sf_dir))
    return m.select(*[r6(c).alias(c) for c in ("average_rating", "negative_sentiment_rate",
                                               "top_quartile_rating", "bottom_quartile_rating")])


@register("benchmark_rating_shares", """
SELECT rating, round(count(*) / (SELECT count(rating) FROM scored), 6) AS share
FROM scored WHERE rating IS NOT NULL GROUP BY rating
""")
def q_rating_shares(spark, sf_dir):
    r = benchmark.rating_shares(frames.scored(spark, sf_dir))
    return r.select("rating", r6("share").alias("share"))


@register("benchmark_targets", """
SELECT round(least(average_rating + 0.5, 5.0), 6) AS target_avg_rating,
       round(greatest(negative_sentiment_rate - 0.05, 0.05), 6) AS target_negative_rate,
       round(least(five_star_share + 0.1, 0.8), 6) AS target_5star_rate
FROM bench
""")
def q_targets(spark, sf_dir):
    t = benchmark.improvement_targets(benchmark.benchmark_metrics(frames.scored(spark, sf_dir)))
    return t.select(*[r6(c).alias(c) for c in t.columns])


@register("benchmark_position", """
SELECT CAST(CASE WHEN average_rating >= 4.5 THEN 90 WHEN average_rating >= 4.0 THEN 75
            WHEN average_rating >= 3.5 THEN 50 WHEN average_rating >= 3.0 THEN 25 ELSE 10 END AS BIGINT)
         AS current_percentile,
       round(average_rating, 6) AS average_rating, round(negative_sentiment_rate, 6) AS negative_sentiment_rate
FROM bench
""")
def q_position(spark, sf_dir):
    p = benchmark.position_summary(frames.scored(spark, sf_dir))
    return p.select("current_percentile", r6("average_rating").alias("average_rating"),
                    r6("negative_sentiment_rate").alias("negative_sentiment_rate"))


def _position_sql() -> str:
    s = K.STRENGTH_TEXTS
    return f"""
WITH strengths AS (
  SELECT t FROM (
    SELECT 1 AS o, CASE WHEN positive_rate > 0.7 THEN '{s[0]}' END AS t FROM bench
    UNION ALL SELECT 2, CASE WHEN average_rating > 4.0 THEN '{s[1]}' END FROM bench
    UNION ALL SELECT 3, CASE WHEN five_star_rate > 0.4 THEN '{s[2]}' END FROM bench) x
  WHERE t IS NOT NULL ORDER BY o
),
weak AS (
  SELECT coalesce(t.category, p.problem_type) || '{K.WEAKNESS_SUFFIX}' AS t, p.cnt, p.problem_type
  FROM problem_analysis p LEFT JOIN templates t USING (problem_type) WHERE p.percentage > 15
),
opp AS (
  SELECT 1 AS o, (SELECT category FROM suggestions WHERE priority_rank = 1) || '{K.OPPORTUNITY_TOP_SUFFIX}' AS t
  UNION ALL SELECT 2, CASE WHEN negative_sentiment_rate > 0.15 THEN '{K.OPPORTUNITY_NEGATIVE_TEXT}' END FROM bench
),
lists AS (
  SELECT 'strength' AS kind, row_number() OVER (ORDER BY o) AS ord, t AS text FROM (
    SELECT 1 AS o, CASE WHEN positive_rate > 0.7 THEN '{s[0]}' END AS t FROM bench
    UNION ALL SELECT 2, CASE WHEN average_rating > 4.0 THEN '{s[1]}' END FROM bench
    UNION ALL SELECT 3, CASE WHEN five_star_rate > 0.4 THEN '{s[2]}' END FROM bench) x WHERE t IS NOT NULL
  UNION ALL
  SELECT 'weakness', row_number() OVER (ORDER BY cnt DESC, problem_type), t FROM weak
  UNION ALL
  SELECT 'opportunity', row_number() OVER (ORDER BY o), t FROM opp WHERE t IS NOT NULL
)
SELECT kind, CAST(ord AS BIGINT) AS ord, text FROM lists
UNION ALL SELECT 'strength', 1, '{K.STRENGTH_DEFAULT}' WHERE NOT EXISTS (SELECT 1 FROM lists WHERE kind = 'strength')
UNION ALL SELECT 'weakness', 1, '{K.WEAKNESS_DEFAULT}' WHERE NOT EXISTS (SELECT 1 FROM lists WHERE kind = 'weakness')
UNION ALL SELECT 'opportunity', 1, '{K.OPPORTUNITY_DEFAULT}'
  WHERE NOT EXISTS (SELECT 1 FROM lists WHERE kind = 'opportunity')
"""


@register("competitive_position", _position_sql())
def q_competitive_position(spark, sf_dir):
    sc = frames.scored(spark, sf_dir)
    probs = _problems_once(spark, sf_dir)
    prio = priority.priority_scores(probs)
    return benchmark.competitive_position(sc, probs, prio)


# ------------------------------------------------------------- validation --

def _pairs(spark, sf_dir):
    return validation.valid_pairs(frames.scored(spark, sf_dir))


_PAIRS_SQL = """
WITH pairs AS (SELECT sentiment_label AS true_label, bert_sentiment AS pred_label FROM scored
               WHERE sentiment_label IS NOT NULL AND bert_sentiment IS NOT NULL),
labels AS (SELECT true_label AS label FROM pairs UNION SELECT pred_label FROM pairs),
cm AS (
  SELECT t.label AS true_label, p.label AS pred_label,
         CAST(coalesce(c.cnt, 0) AS BIGINT) AS count
  FROM labels t JOIN labels p ON true
  LEFT JOIN (SELECT true_label, pred_label, count(*) AS cnt FROM pairs GROUP BY 1, 2) c
    ON c.true_label = t.label AND c.pred_label = p.label
),
per AS (
  SELECT l.label,
    coalesce(sum(cm.count) FILTER (WHERE cm.true_label = l.label), 0) AS support,
    coalesce(sum(cm.count) FILTER (WHERE cm.true_label = l.label AND cm.pred_label = l.label), 0) AS tp,
    coalesce(sum(cm.count) FILTER (WHERE cm.pred_label = l.label), 0) AS predicted
  FROM labels l JOIN cm ON cm.true_label = l.label OR cm.pred_label = l.label GROUP BY l.label
),
per2 AS (
  SELECT label,
    coalesce(CAST(tp AS DOUBLE) / nullif(CAST(predicted AS DOUBLE), 0), 0) AS precision,
    coalesce(CAST(tp AS DOUBLE) / nullif(CAST(support AS DOUBLE), 0), 0) AS recall,
    coalesce(CAST(2 * tp AS DOUBLE) / nullif(CAST(support + predicted AS DOUBLE), 0), 0) AS f1_score,
    CAST(support AS BIGINT) AS support, tp
  FROM per
)
"""


@register("validation_accuracy", """
SELECT round(avg(CASE WHEN sentiment_label = bert_sentiment THEN 1 ELSE 0 END), 4) AS accuracy,
       count(*) AS total_samples
FROM scored WHERE sentiment_label IS NOT NULL AND bert_sentiment IS NOT NULL
""")
def q_accuracy(spark, sf_dir):
    return validation.accuracy(_pairs(spark, sf_dir))


@register("confusion_matrix", _PAIRS_SQL + "SELECT true_label, pred_label, count FROM cm")
def q_confusion(spark, sf_dir):
    return validation.confusion_matrix(_pairs(spark, sf_dir))


@register("classification_report", _PAIRS_SQL + """
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score, support
FROM per2
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM per2
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1_score), 6),
                 CAST(sum(support) AS BIGINT) FROM per2
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
                 round(sum(recall * support) / sum(support), 6), round(sum(f1_score * support) / sum(support), 6),
                 CAST(sum(support) AS BIGINT) FROM per2
""")
def q_class_report(spark, sf_dir):
    r = validation.classification_report(_pairs(spark, sf_dir))
    return r.select("label", *[r6(c).alias(c) for c in ("precision", "recall", "f1_score")], "support")


@register("label_distributions", """
SELECT 'true' AS side, sentiment_label AS label, count(*) AS count FROM scored
  WHERE sentiment_label IS NOT NULL AND bert_sentiment IS NOT NULL GROUP BY sentiment_label
UNION ALL SELECT 'pred', bert_sentiment, count(*) FROM scored
  WHERE sentiment_label IS NOT NULL AND bert_sentiment IS NOT NULL GROUP BY bert_sentiment
""")
def q_label_dists(spark, sf_dir):
    return validation.label_distributions(_pairs(spark, sf_dir))


# ----------------------------------------------------------------- charts --

@register("chart_label_comparison", """
SELECT coalesce(r.label, m.label) AS label, coalesce(r.c, 0) AS rule_based, coalesce(m.c, 0) AS model
FROM (SELECT sentiment_label AS label, count(*) AS c FROM scored WHERE sentiment_label IS NOT NULL GROUP BY 1) r
FULL OUTER JOIN (SELECT bert_sentiment AS label, count(*) AS c FROM scored WHERE bert_sentiment IS NOT NULL GROUP BY 1) m
  ON r.label = m.label
""")
def q_chart_labels(spark, sf_dir):
    return charts.label_comparison(frames.scored(spark, sf_dir))


def _hist_sql(bins: int) -> str:
    return f"""
WITH v AS (SELECT bert_confidence AS x FROM scored WHERE bert_confidence IS NOT NULL AND NOT isnan(bert_confidence)),
st AS (SELECT min(x) AS lo, max(x) AS hi, avg(x) AS mean_value FROM v),
b AS (
  SELECT CAST(CASE WHEN st.hi > st.lo THEN least(floor((v.x - st.lo) / (st.hi - st.lo) * {bins}), {bins - 1}) + 1
              ELSE 1 END AS BIGINT) AS bin, count(*) AS cnt
  FROM v, st GROUP BY 1
)
SELECT g.bin, round(st.lo + (g.bin - 1) * ((st.hi - st.lo) / {bins}), 6) AS bin_start,
       round(st.lo + g.bin * ((st.hi - st.lo) / {bins}), 6) AS bin_end,
       coalesce(b.cnt, 0) AS count, round(st.mean_value, 6) AS mean_value
FROM st, (SELECT CAST(range AS BIGINT) AS bin FROM range(1, {bins + 1})) g
LEFT JOIN b ON b.bin = g.bin
WHERE st.lo IS NOT NULL
"""


def _hist(spark, sf_dir, bins):
    h = charts.confidence_histogram(frames.scored(spark, sf_dir), bins)
    return h.select("bin", r6("bin_start").alias("bin_start"), r6("bin_end").alias("bin_end"), "count",
                    r6("mean_value").alias("mean_value"))


@register("chart_confidence_histogram", _hist_sql(K.CONFIDENCE_BINS))
def q_hist50(spark, sf_dir):
    return _hist(spark, sf_dir, K.CONFIDENCE_BINS)


@register("chart_confidence_histogram_dashboard", _hist_sql(K.DASHBOARD_CONFIDENCE_BINS))
def q_hist30(spark, sf_dir):
    return _hist(spark, sf_dir, K.DASHBOARD_CONFIDENCE_BINS)


@register("chart_problem_share", """
SELECT problem_category, count(*) AS count, round(count(*) / sum(count(*)) OVER () * 100, 6) AS share
FROM scored WHERE problem_category <> 'none' GROUP BY problem_category
""")
def q_chart_problem_share(spark, sf_dir):
    s = charts.problem_share(frames.scored(spark, sf_dir))
    return s.select("problem_category", "count", r6("share").alias("share"))


@register("chart_rating_sentiment", """
WITH c AS (
  SELECT rating, count(*) FILTER (WHERE bert_sentiment = 'negative') AS negative,
         count(*) FILTER (WHERE bert_sentiment = 'neutral') AS neutral,
         count(*) FILTER (WHERE bert_sentiment = 'positive') AS positive
  FROM scored WHERE rating IS NOT NULL AND bert_sentiment IS NOT NULL GROUP BY rating
)
SELECT rating, round(negative / (negative + neutral + positive) * 100, 6) AS negative,
       round(neutral / (negative + neutral + positive) * 100, 6) AS neutral,
       round(positive / (negative + neutral + positive) * 100, 6) AS positive
FROM c
""")
def q_chart_crosstab(spark, sf_dir):
    c = charts.rating_sentiment_crosstab(frames.scored(spark, sf_dir))
    return c.select("rating", *[r6(x).alias(x) for x in (K.NEGATIVE, K.NEUTRAL, K.POSITIVE)])


@register("chart_sentiment_counts", """
SELECT s.sentiment, count(sc.bert_sentiment) AS count,
       round(count(sc.bert_sentiment) / (SELECT count(*) FROM scored) * 100, 6) AS share
FROM (VALUES ('positive'), ('negative'), ('neutral')) s(sentiment)
LEFT JOIN scored sc ON sc.bert_sentiment = s.sentiment
GROUP BY s.sentiment
""")
def q_chart_sentiment_counts(spark, sf_dir):
    c = charts.sentiment_counts(frames.scored(spark, sf_dir))
    return c.select("sentiment", "count", r6("share").alias("share"))


@register("chart_priority_roi", """
SELECT s.priority_rank, s.category, s.problem_type, s.priority_score, s.estimated_cost,
       round(coalesce(r.roi_percentage, 0), 6) AS roi_percentage,
       round(coalesce(r.expected_revenue_recovery, 0), 6) AS expected_return
FROM suggestions s LEFT JOIN roi r USING (problem_type)
""")
def q_chart_priority_roi(spark, sf_dir):
    sug = _suggestions(spark, sf_dir)
    p = charts.priority_roi_points(sug, roi.roi_by_category(sug))
    return p.select("priority_rank", "category", "problem_type", "priority_score", "estimated_cost",
                    r6("roi_percentage").alias("roi_percentage"), r6("expected_return").alias("expected_return"))


@register("chart_problem_names", """
SELECT coalesce(t.category, p.problem_type) AS display_name, p.problem_type, p.cnt AS count
FROM problem_analysis p LEFT JOIN templates t USING (problem_type)
""")
def q_chart_problem_names(spark, sf_dir):
    return charts.problem_display_counts(_problems(spark, sf_dir))


# ---------------------------------------------------------------- reports --

_SCORING_REPORT_SQL = """
WITH one AS (SELECT count(*) AS n, count(bert_sentiment) AS scored_n, avg(bert_confidence) AS avg_conf,
                    count(*) FILTER (WHERE bert_sentiment = 'negative') AS neg FROM scored),
acc AS (SELECT round(avg(CASE WHEN sentiment_label = bert_sentiment THEN 1 ELSE 0 END), 4) AS accuracy
        FROM scored WHERE sentiment_label IS NOT NULL AND bert_sentiment IS NOT NULL),
top AS (SELECT problem_category, count(*) AS c FROM scored WHERE problem_category <> 'none'
        GROUP BY 1 ORDER BY c DESC, problem_category LIMIT 5),
sent AS (SELECT bert_sentiment, count(*) AS c FROM scored WHERE bert_sentiment IS NOT NULL GROUP BY 1)
SELECT section, metric, key, round(value, 6) AS value FROM (
  SELECT 'basic' AS section, 'total_reviews' AS metric, NULL::VARCHAR AS key, CAST(n AS DOUBLE) AS value FROM one
  UNION ALL SELECT 'basic', 'completion_pct', NULL, round(scored_n / n * 100, 1) FROM one
  UNION ALL SELECT 'sentiment', 'avg_confidence', NULL, round(avg_conf, 3) FROM one
  UNION ALL SELECT 'negative', 'negative_count', NULL, CAST(neg AS DOUBLE) FROM one
  UNION ALL SELECT 'negative', 'negative_pct', NULL, round(neg / n * 100, 1) FROM one
  UNION ALL SELECT 'sentiment', 'count', bert_sentiment, CAST(c AS DOUBLE) FROM sent
  UNION ALL SELECT 'sentiment', 'pct', bert_sentiment, round(c / (SELECT n FROM one) * 100, 1) FROM sent
  UNION ALL SELECT 'problems', 'count', problem_category, CAST(c AS DOUBLE) FROM top
  UNION ALL SELECT 'problems', 'pct_of_negative', problem_category, round(c / (SELECT neg FROM one) * 100, 1) FROM top
  UNION ALL SELECT 'accuracy', 'accuracy', NULL, accuracy FROM acc
)
"""


@register("scoring_report", _SCORING_REPORT_SQL)
def q_scoring_report(spark, sf_dir):
    sc = frames.scored(spark, sf_dir)
    r = reports.scoring_report(sc, with_accuracy=True)
    return r.select("section", "metric", "key", r6("value").alias("value"))


@register("roadmap", """
SELECT priority_rank AS phase, category, estimated_cost AS budget FROM suggestions WHERE priority_rank <= 2
""")
def q_roadmap(spark, sf_dir):
    return reports.roadmap(_suggestions(spark, sf_dir))


@register("kpi_targets", """
WITH m AS (SELECT avg(rating) AS a, count(*) FILTER (WHERE bert_sentiment = 'negative') / count(*) * 100 AS p
           FROM scored)
SELECT round(a, 6) AS current_avg_rating, round(least(a + 0.5, 5.0), 6) AS target_avg_rating,
       round(p, 6) AS current_negative_pct, round(greatest(p - 5, 5.0), 6) AS target_negative_pct
FROM m
""")
def q_kpi(spark, sf_dir):
    k = reports.kpi_targets(frames.scored(spark, sf_dir))
    return k.select(*[r6(c).alias(c) for c in k.columns])


@register("top3_summary", """
SELECT s.priority_rank, s.category, s.priority_score, s.estimated_cost,
       round(coalesce(r.roi_percentage, 0), 6) AS roi_percentage
FROM suggestions s LEFT JOIN roi r USING (problem_type) WHERE s.priority_rank <= 3
""")
def q_top3(spark, sf_dir):
    sug = _suggestions(spark, sf_dir)
    t = reports.top3_summary(sug, roi.roi_by_category(sug))
    return t.select("priority_rank", "category", "priority_score", "estimated_cost",
                    r6("roi_percentage").alias("roi_percentage"))


REPORT_TIME = "2024-01-31 12:00:00"


@register("dashboard_summary", f"""
SELECT CAST((SELECT count(*) FROM scored) AS BIGINT) AS total_reviews, '{REPORT_TIME[:16]}' AS generated_at,
       bert_sentiment AS sentiment, count(*) AS count, round(count(*) / (SELECT count(*) FROM scored) * 100, 6) AS share
FROM scored WHERE bert_sentiment IS NOT NULL GROUP BY bert_sentiment
""")
def q_dashboard_summary(spark, sf_dir):
    d = reports.dashboard_summary(frames.scored(spark, sf_dir), REPORT_TIME[:16])
    return d.withColumn("share", r6("share"))


def _money(col: str, digits: int = 0) -> str:
    return f"format('{{:,.{digits}f}}', CAST({col} AS DOUBLE))"


def _business_sql() -> str:
    """The lines as they stand in the source, written out here on their own."""
    return f"""WITH m AS (SELECT count(*) AS n, count(*) FILTER (WHERE bert_sentiment = 'negative') AS neg, avg(rating) AS a FROM scored),
pos AS ({_position_sql()})
SELECT section, ord, text FROM (
  SELECT 1 AS section, 0 AS ord, 'レビュー分析 - ビジネス改善提案レポート' AS text
  UNION ALL SELECT 1, 1, '生成日時: {REPORT_TIME}'
  UNION ALL SELECT 1, 2, 'エグゼクティブサマリー'
  UNION ALL SELECT 1, 3, printf('総レビュー数: %s件', {_money("n")}) FROM m
  UNION ALL SELECT 1, 4, printf('ネガティブレビュー: %s件 (%.1f%%)', {_money("neg")}, neg / n * 100) FROM m
  UNION ALL SELECT 1, 5, printf('平均評価: %.2f/5.0', a) FROM m
  UNION ALL SELECT 1, 6, '最優先改善項目: ' || category FROM suggestions WHERE priority_rank = 1
  UNION ALL SELECT 1, 7, printf('推定投資額: $%s | 期待リターン: $%s | 全体ROI: %.1f%%', {_money("coalesce(sum(investment), 0)")},
      {_money("coalesce(sum(expected_revenue_recovery), 0)", 1)},
      CASE WHEN coalesce(sum(investment), 0) > 0 THEN sum(expected_revenue_recovery) / sum(investment) * 100 ELSE 0 END) FROM roi
  UNION ALL SELECT 2, -1, '改善提案詳細（優先度順）'
  UNION ALL SELECT 2, CAST(priority_rank AS INTEGER), printf('%d. %s | 優先度スコア: %s | 影響レビュー数: %d件 | 推定コスト: $%s | ROI比: %.2f'
      || ' | 実装期間: %s | リスクレベル: %s | 成功確率: %.0f%% | 具体的施策: %s', priority_rank, category,
      CAST(priority_score AS VARCHAR), affected_reviews, {_money("estimated_cost")}, roi_estimate, implementation_timeline,
      risk_level, success_probability * 100, array_to_string(suggestions[1:3], ' / ')) FROM suggestions
  UNION ALL SELECT 3, -1, 'ROI・投資対効果分析'
  UNION ALL SELECT 3, CAST(priority_rank AS INTEGER), printf('%s: 投資額 $%s | 期待収益 $%s | ROI: %.1f%% | 回収期間: %.1fヶ月', category,
      {_money("investment")}, {_money("expected_revenue_recovery", 1)}, roi_percentage, payback_period_months) FROM roi
  UNION ALL SELECT 4, -2, '競合比較・市場ポジション'
  UNION ALL SELECT 4, -1, printf('現在のポジション: %d%%ile | 業界平均評価: %.2f | ネガティブ率: %.1f%%', CASE WHEN a >= 4.5 THEN 90
      WHEN a >= 4.0 THEN 75 WHEN a >= 3.5 THEN 50 WHEN a >= 3.0 THEN 25 ELSE 10 END, a, neg / n * 100) FROM m
  UNION ALL SELECT 4, 0, '強み:'
  UNION ALL SELECT 4, 100, '弱み:'
  UNION ALL SELECT 4, 200, '改善機会:'
  UNION ALL SELECT 4, CAST(ord + CASE kind WHEN 'strength' THEN 0 WHEN 'weakness' THEN 100 ELSE 200 END AS INTEGER), '• ' || text FROM pos
  UNION ALL SELECT 5, -1, '実装ロードマップ'
  UNION ALL SELECT 5, 1, printf('フェーズ1 (最初の3ヶ月): %sの改善開始 | 予算: $%s', category, {_money("estimated_cost")})
      FROM suggestions WHERE priority_rank = 1
  UNION ALL SELECT 5, 2, printf('フェーズ2 (4-6ヶ月): %sの改善実施 | 予算: $%s', category, {_money("estimated_cost")})
      FROM suggestions WHERE priority_rank = 2
  UNION ALL SELECT 6, -1, '成功指標・KPI'
  UNION ALL SELECT 6, 0, printf('平均評価: %.2f → %.2f', a, least(a + 0.5, 5.0)) FROM m
  UNION ALL SELECT 6, 1, printf('ネガティブ率: %.1f%% → %.1f%%', neg / n * 100, greatest(neg / n * 100 - 5, 5.0)) FROM m
  UNION ALL SELECT 6, 2, '5星評価率: +10%向上'
  UNION ALL SELECT 6, 3, '顧客満足度: +15%向上'
)"""


@register("business_report", _business_sql)
def q_business_report(spark, sf_dir):
    sc = frames.scored(spark, sf_dir)
    probs = _problems_once(spark, sf_dir)
    metrics = rows_once(benchmark.benchmark_metrics(sc))
    prio = priority.priority_scores(probs)
    sug = priority.improvement_suggestions(prio)
    rc = roi.roi_by_category(sug)
    return reports.business_report_lines(metrics, sug, rc, roi.roi_overall(rc),
                                         benchmark.competitive_position(sc, probs, prio, metrics), REPORT_TIME)


# --------------------------------------------------------------- keywords --

def _keywords_sql() -> str:
    from review_insights.functions.stopwords import english_stop_words
    stop = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in english_stop_words()) + "]"
    return f"""
WITH kdocs AS (
  SELECT row_number() OVER () AS doc_id, bert_sentiment AS sentiment,
         lower(regexp_replace(coalesce(review_text, ''), '[^a-zA-Z\\s]', '', 'g')) AS t
  FROM scored WHERE bert_sentiment IN ('positive', 'negative', 'neutral')
),
ktok AS (
  SELECT doc_id, sentiment, list_filter(regexp_extract_all(t, '[a-z]{{2,}}'), lambda x: NOT list_contains({stop}, x)) AS toks
  FROM kdocs
),
kterms AS (
  SELECT doc_id, sentiment,
         CASE WHEN len(toks) >= 2
              THEN list_concat(toks, list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1]))
              ELSE toks END AS terms
  FROM ktok
),
kn AS (SELECT sentiment, count(*) AS n FROM kdocs GROUP BY sentiment),
ktf AS (
  SELECT sentiment, doc_id, term, count(*) AS tf
  FROM (SELECT sentiment, doc_id, unnest(terms) AS term FROM kterms) GROUP BY sentiment, doc_id, term
),
kvocab AS (
  SELECT v.sentiment, v.term, v.df, v.total, kn.n
  FROM (SELECT sentiment, term, count(*) AS df, sum(tf) AS total FROM ktf GROUP BY sentiment, term) v
  JOIN kn USING (sentiment)
  WHERE v.df >= {K.TFIDF_MIN_DF} AND v.df <= CAST({K.TFIDF_MAX_DF} AS DOUBLE) * kn.n
    AND CAST({K.TFIDF_MAX_DF} AS DOUBLE) * kn.n >= {K.TFIDF_MIN_DF}
),
kkeep AS (
  SELECT sentiment, term, ln((n + 1) / (df + 1)) + 1 AS idf
  FROM (SELECT *, row_number() OVER (PARTITION BY sentiment ORDER BY total DESC, term) AS rk FROM kvocab)
  WHERE rk <= {K.TFIDF_MAX_FEATURES}
),
kw AS (SELECT f.sentiment, f.doc_id, f.term, f.tf * k.idf AS w FROM ktf f JOIN kkeep k USING (sentiment, term)),
knorm AS (SELECT sentiment, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS wn FROM kw),
kimp AS (
  SELECT i.sentiment, i.term, i.s / kn.n AS importance
  FROM (SELECT sentiment, term, sum(wn) AS s FROM knorm GROUP BY sentiment, term) i JOIN kn USING (sentiment)
)
SELECT sentiment, rank, term, round(round(importance, 10), 6) AS importance FROM (
  SELECT sentiment, term, importance,
         CAST(row_number() OVER (PARTITION BY sentiment ORDER BY round(importance, 10) DESC, term) AS BIGINT) AS rank
  FROM kimp)
WHERE rank <= {K.TFIDF_TOP_K}
"""


@register("keywords_tfidf", _keywords_sql)
def q_keywords(spark, sf_dir):
    kw = keywords.extract_keywords(frames.scored(spark, sf_dir))
    # 10 decimals first absorb summation-order noise, so exact ties round alike
    return kw.select("sentiment", "rank", "term", r6(F.round("importance", 10)).alias("importance"))


# ---------------------------------------------------------------- scoring --

def _unscored(spark, sf_dir):
    """Processed reviews without the stand-in model columns, ready to be scored."""
    return _lean(spark, sf_dir).drop("bert_sentiment", "bert_confidence")


def _lexicon_sql(with_error: bool) -> str:
    pos, neg = O._hits("low", scoring.POSITIVE_WORDS), O._hits("low", scoring.NEGATIVE_WORDS)
    err = ", false AS score_error" if with_error else ""
    return f"""
WITH lx AS (SELECT review_id, lower(coalesce(review_text, '')) AS low FROM base),
lx2 AS (SELECT review_id, {pos} AS p, {neg} AS n FROM lx)
SELECT review_id,
       CASE WHEN p > n THEN 'positive' WHEN n > p THEN 'negative' ELSE 'neutral' END AS bert_sentiment,
       round(CASE WHEN p + n = 0 THEN 0.5 ELSE 0.5 + 0.5 * abs(p - n) / (p + n) END, 6) AS bert_confidence{err}
FROM lx2
"""


@register("score_lexicon", _lexicon_sql(False))
def q_score_lexicon(spark, sf_dir):
    s = scoring.score_lexicon(_unscored(spark, sf_dir))
    return s.select("review_id", "bert_sentiment", r6("bert_confidence").alias("bert_confidence"))


@register("score_batch_model", _lexicon_sql(True))
def q_score_batch(spark, sf_dir):
    s = scoring.score_sentiment(_unscored(spark, sf_dir).select("review_id", "review_text"))
    return s.select("review_id", "bert_sentiment", r6("bert_confidence").alias("bert_confidence"), "score_error")


class _FailsOnStale(scoring.PandasLexiconScorer):
    """The lexicon scorer with texts that it cannot score."""

    def __call__(self, texts):
        if any("stale" in t.lower() for t in texts):
            raise ValueError("stale")
        return super().__call__(texts)


def _bad_rows_sql() -> str:
    pos, neg = O._hits("low", scoring.POSITIVE_WORDS), O._hits("low", scoring.NEGATIVE_WORDS)
    return f"""
WITH lx AS (SELECT review_id, lower(coalesce(review_text, '')) AS low FROM base),
lx2 AS (SELECT review_id, contains(low, 'stale') AS bad, {pos} AS p, {neg} AS n FROM lx)
SELECT review_id, CASE WHEN bad OR p = n THEN 'neutral' WHEN p > n THEN 'positive' ELSE 'negative' END AS bert_sentiment,
       round(CASE WHEN bad OR p + n = 0 THEN 0.5 ELSE 0.5 + 0.5 * abs(p - n) / (p + n) END, 6) AS bert_confidence, bad AS score_error
FROM lx2
"""


@register("score_bad_rows", _bad_rows_sql)
def q_score_bad_rows(spark, sf_dir):
    """M1, M3: batches by work; of a batch that fails only the rows that fail alone get the fallback."""
    s = scoring.score_sentiment(_unscored(spark, sf_dir).select("review_id", "review_text"), _FailsOnStale, batch_tokens=512)
    return s.select("review_id", "bert_sentiment", r6("bert_confidence").alias("bert_confidence"), "score_error")


@register("score_saved_model", "SELECT review_id, true AS same_label, true AS same_confidence, 1 AS version FROM base")
def q_score_saved_model(spark, sf_dir):
    """A fitted pipeline, published and loaded again, scores as before."""
    base = _unscored(spark, sf_dir).select("review_id", "review_text", "sentiment_label")
    model, path = scoring.train_sentiment_model(base, max_iter=5, num_features=1 << 12), _scratch(spark, "model")
    number = scoring.publish_model(model, path).number
    before = scoring.score_with_model(model, base).withColumnsRenamed({"bert_sentiment": "label", "bert_confidence": "confidence"})
    after = scoring.score_with_model(scoring.load_model(spark, path), before)
    return after.select("review_id", (F.col("label") == F.col("bert_sentiment")).alias("same_label"),
                        (F.abs(F.col("confidence") - F.col("bert_confidence")) < 1e-12).alias("same_confidence"), F.lit(number).alias("version"))


@register("sentiment_stats", """
SELECT bert_sentiment, count(*) AS count, (SELECT round(avg(bert_confidence), 3) FROM scored) AS mean_confidence
FROM scored WHERE bert_sentiment IS NOT NULL GROUP BY bert_sentiment
""")
def q_sentiment_stats(spark, sf_dir):
    return scoring.sentiment_stats(frames.scored(spark, sf_dir))


@register("score_mllib")
def q_score_mllib(spark, sf_dir):
    base = _unscored(spark, sf_dir).select("review_id", "review_text", "sentiment_label")
    model = scoring.train_sentiment_model(base)
    return scoring.score_with_model(model, base).select("review_id", "bert_sentiment", "bert_confidence")


# -------------------------------------------- conform without id/date/text --

_MISSING = ("ProductId", "Score", "Text", "Time")


@register("conform_missing_columns", f"""
WITH mc AS (
  SELECT Id AS review_id, Summary AS review_title,
         row_number() OVER () - 1 AS ri, (SELECT count(*) FROM review_raw) AS n
  FROM review_raw
),
mc2 AS (
  SELECT review_id, review_title, printf('B%06d', ri) AS product_id,
         '{K.DEFAULT_REVIEW_TEXT}' AS review_text, ri, n FROM mc
)
SELECT review_id, product_id, CAST({K.DEFAULT_RATING} AS BIGINT) AS rating, review_text,
  strftime(CASE WHEN n <= 1 THEN TIMESTAMP '{K.SPREAD_START}'
    ELSE make_timestamp(epoch_us(TIMESTAMP '{K.SPREAD_START}') + CAST(trunc(ri * (
      CAST(epoch_us(TIMESTAMP '{K.SPREAD_END}') - epoch_us(TIMESTAMP '{K.SPREAD_START}') AS DOUBLE) / (n - 1))) AS BIGINT))
    END, '%Y-%m-%d %H:%M:%S') AS review_date,
  {O._product_name()} AS product_name,
  {O._category()} AS product_category,
  CAST(('0x' || substr(md5(review_id), 1, 8)) AS BIGINT) % 20 AS helpful_votes
FROM mc2
""")
def q_conform_missing(spark, sf_dir):
    ensure_utc(spark)
    stored = with_file_position(spark.read.parquet(fixture.ingest_review_fixture(spark, sf_dir)))
    c = conform.conform_reviews(normalise_missing(stored).drop(*_MISSING))
    return c.select("review_id", "product_id", "rating", "review_text", ts_text("review_date").alias("review_date"),
                    "product_name", "product_category", "helpful_votes")


# ------------------------------------------------ remaining report pieces --

@register("problem_distribution", """
SELECT problem_category, count(*) AS count FROM scored WHERE bert_sentiment = 'negative' GROUP BY problem_category
""")
def q_problem_distribution(spark, sf_dir):
    return problems.problem_distribution(frames.scored(spark, sf_dir))


def _report_keywords_sql() -> str:
    body = _keywords_sql()
    head = body[:body.rindex("SELECT sentiment, rank, term")]
    return head + """
SELECT sentiment, rank, term FROM (
  SELECT sentiment, term,
         CAST(row_number() OVER (PARTITION BY sentiment ORDER BY round(importance, 10) DESC, term) AS BIGINT) AS rank
  FROM kimp)
WHERE rank <= 5 AND sentiment IN ('negative', 'positive')
"""


@register("report_top_keywords", _report_keywords_sql)
def q_report_keywords(spark, sf_dir):
    # classes are independent (own sizes, vocabulary and weights), so the two
    # reported classes are selected at the input: one filter reaches every pass
    scored = frames.scored(spark, sf_dir).where(F.col("bert_sentiment").isin("negative", "positive"))
    kw = keywords.extract_keywords(scored, top_k=5)
    return kw.where(F.col("sentiment").isin("negative", "positive")).select("sentiment", "rank", "term")


def _scoring_report_text_sql() -> str:
    return "WITH kk AS (" + O.sql(_report_keywords_sql()) + """),
t AS (SELECT count(*) AS n, count(bert_sentiment) AS done, avg(bert_confidence) AS conf,
             count(*) FILTER (WHERE bert_sentiment = 'negative') AS neg,
             avg(CAST(sentiment_label = bert_sentiment AS INTEGER)) FILTER (WHERE sentiment_label IS NOT NULL AND bert_sentiment IS NOT NULL) AS acc
      FROM scored),
s AS (SELECT bert_sentiment AS label, count(*) AS c, row_number() OVER (ORDER BY count(*) DESC, bert_sentiment) AS k
      FROM scored WHERE bert_sentiment IS NOT NULL GROUP BY bert_sentiment),
p AS (SELECT problem_category AS label, count(*) AS c, row_number() OVER (ORDER BY count(*) DESC, problem_category) AS k
      FROM scored WHERE problem_category <> 'none' GROUP BY problem_category QUALIFY k <= 5)
SELECT section, ord, text FROM (
  SELECT 1 AS section, 0 AS ord, 'レビュー感情分析 - サマリーレポート' AS text
  UNION ALL SELECT 1, 1, '基本統計:'
  UNION ALL SELECT 1, 2, '総レビュー数: ' || format('{:,.0f}', CAST(n AS DOUBLE)) || '件' FROM t
  UNION ALL SELECT 1, 3, printf('分析完了率: %.1f%%', round(done / n * 100, 1)) FROM t
  UNION ALL SELECT 2, 0, '感情分析結果:'
  UNION ALL SELECT 2, CAST(k AS INTEGER), label || ': ' || format('{:,.0f}', CAST(c AS DOUBLE)) || printf('件 (%.1f%%)', round(c / n * 100, 1)) FROM s, t
  UNION ALL SELECT 2, 100, printf('平均信頼度: %.3f', round(conf, 3)) FROM t
  UNION ALL SELECT 3, 0, '精度評価:'
  UNION ALL SELECT 3, 1, printf('全体精度: %.3f (%.1f%%)', round(acc, 4), round(acc, 4) * 100) FROM t
  UNION ALL SELECT 4, 0, 'ネガティブレビュー分析:'
  UNION ALL SELECT 4, 1, 'ネガティブレビュー: ' || format('{:,.0f}', CAST(neg AS DOUBLE)) || printf('件 (%.1f%%)', round(neg / n * 100, 1)) FROM t
  UNION ALL SELECT 4, 2, '主要問題:'
  UNION ALL SELECT 4, CAST(k + 2 AS INTEGER), printf('- %s: %d件 (%.1f%%)', label, c, round(c / neg * 100, 1)) FROM p, t
  UNION ALL SELECT 5, 0, 'キーワード分析:'
  UNION ALL SELECT 5, CASE sentiment WHEN 'negative' THEN 1 ELSE 2 END,
      sentiment || 'の主要キーワード: ' || string_agg(term, ', ' ORDER BY rank) FROM kk GROUP BY sentiment
  UNION ALL SELECT 6, 0, '次のステップ (Phase 3):'
  UNION ALL SELECT 6, 1, '1. 改善提案エンジンの実装'
  UNION ALL SELECT 6, 2, '2. ROI算出システムの構築'
  UNION ALL SELECT 6, 3, '3. 競合比較機能の追加'
  UNION ALL SELECT 6, 4, '4. Webアプリケーション開発'
)"""


@register("scoring_report_text", _scoring_report_text_sql)
def q_scoring_report_text(spark, sf_dir):
    """The scoring report as lines of text."""
    sc = frames.scored(spark, sf_dir)
    classed = sc.where(F.col("bert_sentiment").isin(K.NEGATIVE, K.POSITIVE))
    report = reports.scoring_report(sc, with_accuracy=True, keywords=keywords.extract_keywords(classed, top_k=5))
    return reports.scoring_report_lines(report)


@register("dashboard_summary_text", f"""
WITH t AS (SELECT count(*) AS n FROM scored),
s AS (SELECT bert_sentiment AS label, count(*) AS c, row_number() OVER (ORDER BY count(*) DESC, bert_sentiment) AS k
      FROM scored WHERE bert_sentiment IS NOT NULL GROUP BY bert_sentiment)
SELECT section, ord, text FROM (
  SELECT 1 AS section, 0 AS ord, '# レビュー分析 - サマリーレポート' AS text
  UNION ALL SELECT 1, 1, '## 分析概要'
  UNION ALL SELECT 1, 2, '- 総レビュー数: ' || format('{{:,.0f}}', CAST(n AS DOUBLE)) || '件' FROM t
  UNION ALL SELECT 1, 3, '- 分析日時: {REPORT_TIME[:16]}'
  UNION ALL SELECT 1, 4, '## 感情分析結果'
  UNION ALL SELECT 1, CAST(k + 4 AS INTEGER), printf('- %s: %d件 (%.1f%%)', label, c, c / n * 100) FROM s, t
)
""")
def q_dashboard_summary_text(spark, sf_dir):
    """The export page's summary as lines of Markdown."""
    return reports.dashboard_summary_lines(frames.scored(spark, sf_dir), REPORT_TIME[:16])


# ------------------------------------------------- sinks, read back (S3..S9) --

def _scratch(spark, name: str) -> str:
    return table_path(spark, f"{name}-{uuid.uuid4().hex}")


_SCORED_EXPORT_SQL = """
SELECT product_id, rating, review_text, sentiment_label, bert_sentiment, round(bert_confidence, 6) AS bert_confidence,
       problem_category, review_length FROM scored
"""


@register("table_write", """
SELECT review_id, product_id, rating, (SELECT count(*) FROM scored) AS rows_written FROM scored
""")
def q_table_write(spark, sf_dir):
    """S3: a table written with its row count observed on the way, read back."""
    path = _scratch(spark, "table-write")
    rows = sinks.write_table(frames.scored(spark, sf_dir).select("review_id", "product_id", "rating"), path)
    return spark.read.parquet(path).withColumn("rows_written", F.lit(rows).cast("bigint"))


@register("scored_export", _SCORED_EXPORT_SQL)
def q_scored_export(spark, sf_dir):
    """The scored result file, written, checked for its columns and read back."""
    path = _scratch(spark, "scored-export")
    sinks.write_table(sinks.scored_export(frames.scored(spark, sf_dir)), path)
    back = spark.read.parquet(path)
    sinks.require_columns(back, K.PHASE3_REQUIRED_COLUMNS)
    return back.withColumn("bert_confidence", r6("bert_confidence"))


@register("versioned_table", """
SELECT review_id, rating, 2 AS version, (SELECT count(*) FROM scored) AS rows_written, 1 AS older_rows FROM scored
""")
def q_versioned_table(spark, sf_dir):
    """A table published twice and read back by its current version; a third write fails and changes nothing."""
    path = _scratch(spark, "versioned")
    sc = frames.scored(spark, sf_dir).select("review_id", "rating")
    versions.publish(sc.limit(1), path)
    versions.publish(sc, path)

    def refuse(_table, rows):
        raise versions.GateError(str(rows))

    try:
        versions.publish(sc.limit(2), path, refuse)
    except versions.GateError:
        pass
    now, old = versions.current(spark, path), versions.history(spark, path)[0]
    return versions.read_version(spark, path).select("review_id", "rating", F.lit(now.number).alias("version"),
                                                     F.lit(now.rows).cast("bigint").alias("rows_written"), F.lit(old.rows).alias("older_rows"))


@register("quality_gate", "SELECT 'missing' AS \"check\", column_name AS item, null_count AS value, true AS failed FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_count FROM processed" for c in PROCESSED_COLUMNS)
    + """) WHERE null_count > 0
UNION ALL SELECT 'short', NULL, count(*) FILTER (WHERE review_length < 10), count(*) FILTER (WHERE review_length < 10) > 0 FROM processed
UNION ALL SELECT 'imbalance', label, n, n < 0.05 * (SELECT count(*) FROM processed) FROM (
  SELECT sentiment_label AS label, count(*) AS n FROM processed WHERE sentiment_label IS NOT NULL GROUP BY 1 ORDER BY 2, 1 LIMIT 1)
""")
def q_quality_gate(spark, sf_dir):
    """A7 to A9 as the gate of phase 1: observed while the processed table is written, read back."""
    seen = Observation("quality")
    table = frames.processed(spark, sf_dir).select(*PROCESSED_COLUMNS)
    sinks.write_table(gate.observe_checks(table, seen), _scratch(spark, "gate"))
    path = _scratch(spark, "gate-checks")
    versions.publish(gate.as_frame(spark, gate.results(table.columns, seen.get)), path)
    return versions.read_version(spark, path)


@register("report_file", lambda: "SELECT text FROM (" + O.sql(_business_sql()) + ")")
def q_report_file(spark, sf_dir):
    """The business report as a text file, read back line by line."""
    path = _scratch(spark, "report-file")
    sinks.write_report(q_business_report(spark, sf_dir), path)
    return spark.read.text(path).select(F.col("value").alias("text"))


@register("sentiment_detail", f"""
SELECT review_text, rating, bert_sentiment, round(bert_confidence, 6) AS bert_confidence FROM (
  SELECT * FROM scored ORDER BY review_id LIMIT {K.DETAIL_ROWS})
""")
def q_sentiment_detail(spark, sf_dir):
    """The detail table of the dashboard, its four columns and first rows."""
    d = summary.preview(frames.scored(spark, sf_dir), K.DETAIL_ROWS, K.SENTIMENT_DETAIL_COLUMNS)
    return d.withColumn("bert_confidence", r6("bert_confidence"))


@register("csv_folder", """
SELECT Id, ProductId, UserId, Score, Summary, Text, CAST(Time AS VARCHAR) AS Time FROM review_raw
""")
def q_csv_folder(spark, sf_dir):
    """A folder of CSV files, named as such."""
    raw = read_reviews(spark, fixture.ingest_review_csv(spark, sf_dir), "csv")
    return raw.select("Id", "ProductId", "UserId", "Score", "Summary", "Text", "Time")


# ------------------------------------ the text operators on ``documents`` --

def _documents(spark, sf_dir):
    """The documents as reviews: the text as it is, one rating for all."""
    docs = fixture.read_table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("review_id"), F.col("text").alias("review_text"),
                       F.lit(None).cast("string").alias("review_title"), F.col("source").alias("product_id"), "lang")


# Python's str.strip() also removes U+001C to U+001F
_STRIP_SQL = r"regexp_replace(regexp_replace({c}, '^[\s\x0B\x1C-\x1F\x85\p{{Z}}]+', ''), '[\s\x0B\x1C-\x1F\x85\p{{Z}}]+$', '')"


@register("document_text_features", f"""
SELECT doc_id, md5(c) AS clean_md5, length(c) AS review_length FROM (
  SELECT doc_id, {_STRIP_SQL.format(c="text")} AS c FROM documents)
""")
def q_document_text_features(spark, sf_dir):
    """P2, P3 on whole documents; a null text has neither."""
    t = preprocess.add_text_features(_documents(spark, sf_dir))
    return t.select(F.col("review_id").cast("bigint").alias("doc_id"), F.md5(F.col("review_text_clean").cast("binary")).alias("clean_md5"),
                    "review_length")


@register("document_products", lambda: f"""
SELECT doc_id, {O._product_name()} AS product_name, {O._category()} AS product_category FROM (
  SELECT doc_id, coalesce(source, '') AS product_id, NULL::VARCHAR AS review_title, text AS review_text FROM documents)
""")
def q_document_products(spark, sf_dir):
    """C3, C4 on whole documents."""
    d = _documents(spark, sf_dir)
    low = F.lower(F.coalesce("review_text", F.lit("")))
    blob = F.concat(low, F.lit(" "), F.lower(F.coalesce("review_title", F.lit(""))))
    return d.select(F.col("review_id").cast("bigint").alias("doc_id"),
                    conform.product_name_expr(low, F.col("review_title"), F.coalesce("product_id", F.lit(""))).alias("product_name"),
                    conform.category_expr(blob).alias("product_category"))


@register("document_lexicon", lambda: "WITH" + _lexicon_sql(False).replace("FROM base", "FROM dbase").replace(
    "WITH lx", " dbase AS (SELECT CAST(doc_id AS VARCHAR) AS review_id, text AS review_text FROM documents), lx").lstrip("\n"))
def q_document_lexicon(spark, sf_dir):
    """M1b on whole documents."""
    s = scoring.score_lexicon(_documents(spark, sf_dir))
    return s.select("review_id", "bert_sentiment", r6("bert_confidence").alias("bert_confidence"))


def _document_keywords_sql() -> str:
    lex = _lexicon_sql(False).replace("FROM base", "FROM dbase").replace(
        "WITH lx", "dbase AS (SELECT CAST(doc_id AS VARCHAR) AS review_id, text AS review_text FROM documents),\nlx")
    head, tail = lex.rstrip().rsplit("SELECT review_id,", 1)
    body = _keywords_sql().replace("FROM scored WHERE", "FROM dscored WHERE").lstrip()
    return ("WITH " + head.strip() + ",\ndlex AS (SELECT review_id," + tail + "),\n"
            "dscored AS (SELECT l.*, review_text FROM dlex l JOIN dbase USING (review_id)),\n" + body[4:].lstrip())


@register("document_keywords", _document_keywords_sql)
def q_document_keywords(spark, sf_dir):
    """K1..K6 on whole documents, classed by the lexicon."""
    kw = keywords.extract_keywords(scoring.score_lexicon(spread(_documents(spark, sf_dir))), sketch=True)
    return kw.select("sentiment", "rank", "term", r6(F.round("importance", 10)).alias("importance"))


@register("scoring_report_full", lambda: "WITH kk AS (" + O.sql(_report_keywords_sql()) + "),\nrr AS (" + O.sql(_SCORING_REPORT_SQL) + """)
SELECT section, metric, key, value FROM rr
UNION ALL SELECT 'keywords', sentiment, term, CAST(rank AS DOUBLE) FROM kk""")
def q_scoring_report_full(spark, sf_dir):
    """R1 with the first five keywords of the negative and the positive class."""
    sc = frames.scored(spark, sf_dir)
    classed = sc.where(F.col("bert_sentiment").isin(K.NEGATIVE, K.POSITIVE))
    r = reports.scoring_report(sc, with_accuracy=True, keywords=keywords.extract_keywords(classed, top_k=5))
    return r.select("section", "metric", "key", r6("value").alias("value"))


# ---------------------------------------- metrics kept up to date (streaming) --

_STATES: dict[tuple[str, str], str] = {}


def _metric_state(spark, sf_dir) -> str:
    """The state of a stream over the stored review files, one file a batch; the first batch is replayed at the end."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STATES:
        path = _scratch(spark, "metric-state")
        ensure_utc(spark)
        source = fixture.ingest_review_fixture(spark, sf_dir)
        reviews = streaming.classify_stream(streaming.read_review_stream(spark, source, max_files_per_trigger=1))
        state.start_metrics(reviews, path, _scratch(spark, "metric-checkpoint")).awaitTermination()
        state.store_batch(frames.scored(spark, sf_dir).limit(5), path, 0)
        _STATES[key] = path
    return _STATES[key]


@register("problem_analysis_incremental", lambda: ORACLE["problem_analysis"])
def q_problem_analysis_incremental(spark, sf_dir):
    """N3 from the cubes of a stream's batches."""
    pa = state.problem_analysis(state.merged_cube(spark, _metric_state(spark, sf_dir)))
    return pa.select("problem_type", "count", r6("percentage").alias("percentage"),
                     r6("avg_rating").alias("avg_rating"), r6("avg_confidence").alias("avg_confidence"))


@register("classification_report_incremental", lambda: ORACLE["classification_report"])
def q_classification_report_incremental(spark, sf_dir):
    """V3 from the cubes of a stream's batches."""
    r = state.classification_report(state.merged_cube(spark, _metric_state(spark, sf_dir)))
    return r.select("label", *[r6(c).alias(c) for c in ("precision", "recall", "f1_score")], "support")


@register("benchmark_metrics_incremental", lambda: ORACLE["benchmark_metrics"])
def q_benchmark_metrics_incremental(spark, sf_dir):
    """T1 from the cubes of a stream's batches."""
    m = state.benchmark_metrics(state.merged_cube(spark, _metric_state(spark, sf_dir)))
    return m.select(*[r6(c).alias(c) for c in ("average_rating", "negative_sentiment_rate", "top_quartile_rating", "bottom_quartile_rating")])


@register("keywords_incremental", lambda: ORACLE["keywords_tfidf"]() if callable(ORACLE["keywords_tfidf"]) else ORACLE["keywords_tfidf"])
def q_keywords_incremental(spark, sf_dir):
    """K1 to K6 from the tokens and counts of a stream's batches, two files a batch."""
    path = _scratch(spark, "keyword-state")
    ensure_utc(spark)
    source = fixture.ingest_review_fixture(spark, sf_dir)
    reviews = streaming.classify_stream(streaming.read_review_stream(spark, source, max_files_per_trigger=2))
    keyword_state.start_keywords(reviews.select("review_text", "bert_sentiment"), path, _scratch(spark, "keyword-checkpoint")).awaitTermination()
    keyword_state.store_batch(frames.scored(spark, sf_dir).limit(5), path, 0)  # a replay
    kw = keyword_state.current_keywords(spark, path)
    return kw.select("sentiment", "rank", "term", r6(F.round("importance", 10)).alias("importance"))


@register("sketch_summary", """
SELECT 'unique_products' AS metric, CAST(count(DISTINCT product_id) AS DOUBLE) AS exact, true AS close FROM scored
UNION ALL SELECT 'unique_users', CAST(count(DISTINCT user_id) AS DOUBLE), true FROM scored
UNION ALL SELECT 'median_review_length', CAST(median(review_length) AS DOUBLE), true FROM scored
""")
def q_sketch_summary(spark, sf_dir):
    """A1, A5 by merged sketches beside the exact values: distinct counts within 3 %, the median within 2 % of the ranks."""
    sc = frames.scored(spark, sf_dir)
    found = state.sketch_summary(state.merged_sketches(spark, _metric_state(spark, sf_dir)))
    # rows by product, reviewer and length, counted in one pass: a percentile beside two distinct counts would sort all rows thrice
    counted = (sc.groupingSets([["product_id"], ["user_id"], ["review_length"]], "product_id", "user_id", "review_length")
               .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid")))

    def of(column, gid):
        return (F.col("gid") == gid) & F.col(column).isNotNull()

    quantiles = F.percentile("review_length", F.array(F.lit(0.48), F.lit(0.5), F.lit(0.52)), F.when(of("review_length", 6), F.col("n")).otherwise(0))
    exact = counted.agg(F.count_if(of("product_id", 3)).cast("double").alias("p"), F.count_if(of("user_id", 5)).cast("double").alias("u"),
                        quantiles.alias("q")).select(F.explode(F.array(
        F.struct(F.lit("unique_products").alias("metric"), F.col("p").alias("exact"), F.col("p") * 0.97, F.col("p") * 1.03),
        F.struct(F.lit("unique_users").alias("metric"), F.col("u").alias("exact"), F.col("u") * 0.97, F.col("u") * 1.03),
        F.struct(F.lit("median_review_length").alias("metric"), F.col("q")[1].alias("exact"), F.col("q")[0], F.col("q")[2]))).alias("e")) \
        .select("e.metric", "e.exact", F.col("e.col3").alias("least"), F.col("e.col4").alias("most"))
    return found.join(F.broadcast(exact), "metric").select("metric", "exact", F.col("estimate").between(F.col("least"), F.col("most")).alias("close"))
