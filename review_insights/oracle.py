"""DuckDB SQL twins of the registered queries (the correctness oracle).

``PRELUDE`` re-states, in plain SQL over the pre-registered driver views, the
review fixture and the conform / preprocess / classify stages.  Each oracle
query is ``PRELUDE`` followed by its own ``SELECT``.  Constants (keyword lists,
templates) are interpolated from ``constants``; the logic is written here
independently of the Spark code.
"""

from __future__ import annotations

from review_insights import constants as K
from review_insights.sources.fixture import FIXTURE_PHRASES


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(items) -> str:
    return "[" + ", ".join(_q(i) for i in items) + "]"


def _contains_any(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, {_q(w)})" for w in words) + ")"


def _hits(col: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains({col}, {_q(w)}) AS INTEGER)" for w in words) + ")"


_NA = ", ".join(_q(t) for t in K.NA_TOKENS)


def _na(col: str) -> str:
    return f"CASE WHEN {col} IN ({_NA}) THEN NULL ELSE {col} END"


def _product_name() -> str:
    parts = [f"WHEN length(review_title) > {K.TITLE_MIN_LENGTH} THEN substr(review_title, 1, {K.TITLE_MAX_CHARS})"]
    for kw in K.PRODUCT_NAME_KEYWORDS:
        parts.append(f"WHEN contains(lower(coalesce(review_text, '')), {_q(kw)}) THEN {_q(kw.title())}")
    parts.append("WHEN length(product_id) > 0 THEN 'Product ' || product_id")
    return "CASE " + " ".join(parts) + f" ELSE {_q(K.UNKNOWN_PRODUCT_NAME)} END"


def _category() -> str:
    blob = "(lower(coalesce(review_text, '')) || ' ' || lower(coalesce(review_title, '')))"
    parts = [f"WHEN {_contains_any(blob, words)} THEN {_q(cat)}" for cat, words in K.CATEGORY_KEYWORDS]
    return "CASE " + " ".join(parts) + f" ELSE {_q(K.DEFAULT_CATEGORY)} END"


def _problem() -> str:
    low = "lower(review_text)"
    names = [n for n, _ in K.PROBLEM_KEYWORDS]
    scores = ",\n    ".join(f"{_hits(low, words)} AS s_{n}" for n, words in K.PROBLEM_KEYWORDS)
    best = "greatest(" + ", ".join(f"s_{n}" for n in names) + ")"
    whens = " ".join(f"WHEN s_{n} = {best} THEN {_q(n)}" for n in names)
    return scores, f"CASE WHEN review_text IS NULL OR {best} = 0 THEN 'other' {whens} END"


_SCORES, _PROBLEM_CASE = _problem()


def _template_rows() -> str:
    rows = []
    for i, (p, c, acts, cost, mult, tl) in enumerate(K.IMPROVEMENT_TEMPLATES, 1):
        rows.append(f"({_q(p)}, {_q(c)}, {_list(acts)}, CAST({cost} AS BIGINT), CAST({mult} AS DOUBLE), "
                    f"{_q(tl)}, CAST({i} AS BIGINT))")
    return ",\n    ".join(rows)


_TEMPLATE_ROWS = _template_rows()
_NUMERIC_RE = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"

PRELUDE = f"""
WITH li AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_shipdate,
         l_orderkey * 31 + l_linenumber * 17 + l_partkey * 7 + l_suppkey AS h
  FROM lineitem
),
fx AS (
  SELECT
    concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS Id,
    'B' || lpad(CAST(l_partkey AS VARCHAR), 6, '0') AS ProductId,
    'U' || CAST(l_suppkey AS VARCHAR) AS UserId,
    CASE WHEN h % 47 = 0 THEN NULL WHEN h % 53 = 0 THEN '0' WHEN h % 59 = 0 THEN '7'
         WHEN h % 61 = 0 THEN '3.5' WHEN h % 67 = 0 THEN 'n/a'
         ELSE CAST(CAST(ceil(l_quantity / 10) AS BIGINT) AS VARCHAR) END AS Score,
    CASE WHEN h % 3 = 0 THEN NULL WHEN h % 3 = 1 THEN 'ok'
         ELSE list_extract({_list(FIXTURE_PHRASES)}, CAST(h % 12 + 1 AS INTEGER)) END AS Summary,
    CASE WHEN h % 41 = 0 THEN NULL
         ELSE '  ' || list_extract({_list(FIXTURE_PHRASES)}, CAST(h % 12 + 1 AS INTEGER)) || '. '
              || list_extract({_list(FIXTURE_PHRASES)}, CAST((h * 5 + l_linenumber) % 12 + 1 AS INTEGER)) || ' ' END AS Text,
    CASE WHEN h % 43 = 0 THEN NULL ELSE CAST(epoch(l_shipdate) AS BIGINT) END AS Time,
    CASE WHEN h % 37 = 0 THEN NULL WHEN h % 10 < 5 THEN 'positive'
         WHEN h % 10 < 8 THEN 'negative' ELSE 'neutral' END AS bert_sentiment,
    CAST(0.5 AS DOUBLE) + CAST(h % 50 AS DOUBLE) / CAST(100 AS DOUBLE) AS bert_confidence
  FROM li
),
review_raw AS (
  SELECT {_na('Id')} AS Id, {_na('ProductId')} AS ProductId, {_na('UserId')} AS UserId,
         {_na('Score')} AS Score, {_na('Summary')} AS Summary, {_na('Text')} AS Text, Time,
         {_na('bert_sentiment')} AS bert_sentiment, bert_confidence
  FROM fx
),
renamed AS (
  SELECT Id AS review_id, ProductId AS product_id, UserId AS user_id, Score AS rating_text,
         Summary AS review_title, Text AS review_text, Time AS review_epoch,
         bert_sentiment, bert_confidence,
         md5(Id) AS id_md5
  FROM review_raw
),
typed AS (
  SELECT *,
    CASE WHEN regexp_matches(CAST(rating_text AS VARCHAR), '{_NUMERIC_RE}')
         THEN TRY_CAST(trim(CAST(rating_text AS VARCHAR)) AS DOUBLE) END AS rating_num
  FROM renamed
),
review AS (
  SELECT review_id, product_id, user_id,
    CAST(trunc(least(greatest(rating_num, 1.0), 5.0)) AS BIGINT) AS rating,
    review_title, review_text,
    CASE WHEN review_epoch BETWEEN -62135596800 AND 253402300799
         THEN make_timestamp(CAST(review_epoch AS BIGINT) * 1000000) END AS review_date,
    {_product_name()} AS product_name,
    {_category()} AS product_category,
    CAST(('0x' || substr(id_md5, 1, 8)) AS BIGINT) % 20 AS helpful_votes,
    CAST(('0x' || substr(id_md5, 1, 8)) AS BIGINT) % 20 + CAST(('0x' || substr(id_md5, 9, 8)) AS BIGINT) % 10 AS total_votes,
    CAST(('0x' || substr(id_md5, 17, 8)) AS BIGINT) % 10 < 8 AS verified_purchase,
    bert_sentiment, bert_confidence
  FROM typed
  WHERE rating_num IS NOT NULL AND NOT isnan(rating_num)
),
prep AS (
  SELECT *,
    regexp_replace(review_text, '^\\s+|\\s+$', '', 'g') AS review_text_clean
  FROM review
  WHERE review_text IS NOT NULL AND rating IS NOT NULL
),
prep2 AS (
  SELECT *,
    CAST(length(review_text_clean) AS BIGINT) AS review_length,
    (rating - 1) / 4 AS rating_normalized,
    CASE WHEN rating >= 4 THEN 'positive' WHEN rating = 3 THEN 'neutral' ELSE 'negative' END AS sentiment_label,
    CASE WHEN total_votes IS NOT NULL THEN helpful_votes / greatest(total_votes, 1) END AS helpfulness_ratio,
    CAST(year(review_date) AS BIGINT) AS review_year,
    CAST(month(review_date) AS BIGINT) AS review_month
  FROM prep
),
base AS (
  SELECT *,
    coalesce(verified_purchase AND review_length >= 20 AND total_votes >= 1, false) AS is_high_quality
  FROM prep2
),
cat_stats AS (
  SELECT product_category, avg(rating) AS category_mean, stddev_samp(rating) AS category_std,
         count(rating) AS category_count
  FROM base GROUP BY product_category
),
processed AS (
  SELECT b.*, c.category_mean, c.category_std, c.category_count
  FROM base b JOIN cat_stats c USING (product_category)
),
prob AS (
  SELECT *,
    {_SCORES}
  FROM base
),
scored AS (
  SELECT * EXCLUDE ({', '.join('s_' + n for n, _ in K.PROBLEM_KEYWORDS)}),
    CASE WHEN bert_sentiment = 'negative' THEN {_PROBLEM_CASE} ELSE 'none' END AS problem_category
  FROM prob
),
neg AS (
  SELECT * FROM scored WHERE bert_sentiment = 'negative'
),
problem_analysis AS (
  SELECT problem_category AS problem_type, count(*) AS cnt, avg(rating) AS avg_rating,
         avg(bert_confidence) AS avg_confidence,
         count(*) / (SELECT count(*) FROM neg) * 100 AS percentage
  FROM neg WHERE problem_category <> 'none' GROUP BY problem_category
),
templates AS (
  SELECT * FROM (VALUES
    {_TEMPLATE_ROWS}
  ) AS t(problem_type, category, suggestions, base_cost, impact_multiplier, timeline, template_ord)
),
prio0 AS (
  SELECT p.problem_type, t.category, t.template_ord, t.suggestions, t.timeline,
    round(p.percentage / 100 * 0.4 + (CAST(1 AS DOUBLE) - p.avg_confidence) * 0.3
          + t.impact_multiplier * 0.2 + CAST(1 AS DOUBLE) / (t.base_cost / 25000) * 0.1, 3) AS priority_score,
    round(p.percentage / 100, 3) AS problem_frequency,
    round(CAST(1 AS DOUBLE) - p.avg_confidence, 3) AS sentiment_intensity,
    t.impact_multiplier AS business_impact,
    round(CAST(1 AS DOUBLE) / (t.base_cost / 25000), 3) AS implementation_ease,
    t.base_cost AS estimated_cost,
    round(p.cnt * 10 / t.base_cost, 2) AS roi_estimate,
    p.cnt AS affected_reviews
  FROM problem_analysis p JOIN templates t ON p.problem_type = t.problem_type
),
priority AS (
  SELECT *, row_number() OVER (ORDER BY priority_score DESC, template_ord) AS priority_rank FROM prio0
),
suggestions AS (
  SELECT category, problem_type, priority_score, priority_rank, affected_reviews, estimated_cost,
    roi_estimate, suggestions, coalesce(timeline, '{K.DEFAULT_TIMELINE}') AS implementation_timeline,
    CASE WHEN estimated_cost > 60000 THEN '{K.RISK_HIGH}' WHEN estimated_cost > 35000 THEN '{K.RISK_MID}'
         ELSE '{K.RISK_LOW}' END AS risk_level,
    least(CAST(0.7 AS DOUBLE) + priority_score * 0.2 + least(roi_estimate * 0.1, CAST(0.2 AS DOUBLE)),
          CAST(0.95 AS DOUBLE)) AS success_probability,
    template_ord
  FROM priority
),
roi AS (
  SELECT problem_type, category, priority_rank, estimated_cost AS investment,
    affected_reviews * 100 AS potential_revenue_recovery,
    affected_reviews * 100 * CAST(0.85 AS DOUBLE) * 3 AS expected_revenue_recovery,
    affected_reviews * 100 * CAST(0.85 AS DOUBLE) * 3 / estimated_cost * 100 AS roi_percentage,
    estimated_cost / (affected_reviews * 100 * CAST(0.85 AS DOUBLE) * 3 / 12) AS payback_period_months,
    affected_reviews * 100 * CAST(0.85 AS DOUBLE) * 3 * success_probability / estimated_cost * 100 AS risk_adjusted_roi
  FROM suggestions
),
bench AS (
  SELECT avg(rating) AS average_rating,
    avg(CASE WHEN bert_sentiment = 'negative' THEN 1 ELSE 0 END) AS negative_sentiment_rate,
    avg(CASE WHEN bert_sentiment = 'positive' THEN 1 ELSE 0 END) AS positive_rate,
    count(*) FILTER (WHERE rating = 5) / count(rating) AS five_star_share,
    count(*) FILTER (WHERE rating = 5) / count(*) AS five_star_rate,
    quantile_cont(rating, 0.25) AS bottom_quartile_rating,
    quantile_cont(rating, 0.75) AS top_quartile_rating
  FROM scored
)
"""


def sql(body: str) -> str:
    """A complete oracle query: the shared prelude plus one final SELECT.

    A body that starts with its own ``WITH`` extends the prelude's CTE list.
    """
    text = body.lstrip()
    if text[:4].upper() == "WITH":
        return PRELUDE.rstrip() + ",\n" + text[4:]
    return PRELUDE + body
