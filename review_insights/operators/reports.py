"""Reports as tables (R1..R6) and their text rendering.

Report content is tidy rows; text lines are produced from those small frames
with ``format_string`` and written by ``sinks.write_report``.  Every frame
here is bounded by construction (a few dozen rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from review_insights import constants as K
from review_insights.operators.benchmark import percentile_position
from review_insights.operators.patterns import _real_flag


def _row(section: str, metric: str, key: Column | None, value: Column) -> Column:
    return F.struct(F.lit(section).alias("section"), F.lit(metric).alias("metric"),
                    (key if key is not None else F.lit(None).cast("string")).alias("key"),
                    value.cast("double").alias("value"))


def scoring_report(scored: DataFrame, accuracy: DataFrame | None = None, with_accuracy: bool = False,
                   true_col: str = "sentiment_label", pred_col: str = "bert_sentiment",
                   keywords: DataFrame | None = None) -> DataFrame:
    """Scoring summary as ``(section, metric, key, value)``: rows, completion %,
    sentiment counts and % of rows, mean confidence, accuracy, negatives and the
    five most frequent problems as % of negatives.

    ``with_accuracy`` computes the accuracy (rows with both labels, 4 dp) in the
    same pass; a precomputed ``accuracy`` frame is appended as given.  ``keywords``
    (``sentiment, rank, term``) adds the first five terms of the negative and the
    positive class: the class as metric, the term as key, its rank as value."""
    both = F.col(true_col).isNotNull() & F.col(pred_col).isNotNull()
    acc = (F.avg(F.when(both, (F.col(true_col) == F.col(pred_col)).cast("int"))) if with_accuracy
           else F.lit(None).cast("double"))
    # One grouping-sets pass: the grand total, per sentiment and per problem.
    # grouping_id bits: bert_sentiment=2, problem_category=1 (1 = aggregated away)
    g = (scored.groupingSets([[], ["bert_sentiment"], ["problem_category"]], "bert_sentiment", "problem_category")
         .agg(F.count(F.lit(1)).alias("c"),
              F.count("bert_sentiment").alias("scored"),
              F.avg("bert_confidence").alias("avg_conf"),
              F.count_if(F.col("bert_sentiment") == K.NEGATIVE).alias("neg"),
              _real_flag(),
              acc.alias("acc"),
              F.grouping_id().alias("gid")))
    gid = F.col("gid")
    is_total, is_sent, is_prob = gid == 3, gid == 1, gid == 2
    # the result has at most 1 + 4 + 7 rows, so windows over all of it are cheap
    everything = Window.partitionBy()
    real_prob = is_prob & (F.col("_real") > 0)
    g = g.select(
        "*",
        F.max(F.when(is_total, F.col("c"))).over(everything).alias("n_total"),
        F.max(F.when(is_total, F.col("neg"))).over(everything).alias("neg_total"),
        F.row_number().over(Window.partitionBy(real_prob).orderBy(F.desc("c"), F.asc("problem_category")))
        .alias("prob_rank"))

    def pct(num: Column, den: Column, digits: int = 1) -> Column:
        return F.round(F.try_divide(num, den) * 100, digits)

    def entry(cond: Column, section: str, metric: str, key: Column | None, value: Column) -> Column:
        return F.when(cond, _row(section, metric, key, value))

    top = real_prob & (F.col("prob_rank") <= 5)
    sent = is_sent & F.col("bert_sentiment").isNotNull()
    entries = F.array(
        entry(is_total, "basic", "total_reviews", None, F.col("c")),
        entry(is_total, "basic", "completion_pct", None, pct(F.col("scored"), F.col("c"))),
        entry(is_total, "sentiment", "avg_confidence", None, F.round("avg_conf", 3)),
        entry(is_total, "negative", "negative_count", None, F.col("neg")),
        entry(is_total, "negative", "negative_pct", None, pct(F.col("neg"), F.col("c"))),
        entry(sent, "sentiment", "count", F.col("bert_sentiment"), F.col("c")),
        entry(sent, "sentiment", "pct", F.col("bert_sentiment"), pct(F.col("c"), F.col("n_total"))),
        entry(top, "problems", "count", F.col("problem_category"), F.col("c")),
        entry(top, "problems", "pct_of_negative", F.col("problem_category"), pct(F.col("c"), F.col("neg_total"))),
        entry(is_total & F.lit(with_accuracy) & F.col("acc").isNotNull(), "accuracy", "accuracy", None,
              F.round("acc", 4)),
    )
    out = g.select(F.explode(entries).alias("r")).where(F.col("r").isNotNull()).select("r.*")
    if accuracy is not None:
        out = out.unionByName(accuracy.select(F.explode(F.array(
            _row("accuracy", "accuracy", None, F.col("accuracy")))).alias("r")).select("r.*"))
    if keywords is not None:
        top = keywords.where(F.col("sentiment").isin(K.NEGATIVE, K.POSITIVE) & (F.col("rank") <= 5))
        out = out.unionByName(top.select(F.lit("keywords").alias("section"), F.col("sentiment").alias("metric"),
                                         F.col("term").alias("key"), F.col("rank").cast("double").alias("value")))
    return out


def roadmap(suggestions: DataFrame) -> DataFrame:
    """Phase 1 = the top-ranked improvement, phase 2 = the second, with budgets."""
    return suggestions.where(F.col("priority_rank") <= 2).select(
        F.col("priority_rank").alias("phase"), "category", F.col("estimated_cost").alias("budget"))


def kpi_targets(scored: DataFrame) -> DataFrame:
    """Rating target min(mean + 0.5, 5); negative-share target max(current% - 5, 5)."""
    m = scored.agg(F.avg("rating").alias("current_avg_rating"),
                   (F.count_if(F.col("bert_sentiment") == K.NEGATIVE) / F.count(F.lit(1)) * 100)
                   .alias("current_negative_pct"))
    return m.select(
        "current_avg_rating",
        F.least(F.col("current_avg_rating") + K.TARGET_RATING_STEP, F.lit(K.TARGET_RATING_MAX)).alias("target_avg_rating"),
        "current_negative_pct",
        F.greatest(F.col("current_negative_pct") - K.KPI_NEGATIVE_PERCENT_STEP,
                   F.lit(float(K.KPI_NEGATIVE_PERCENT_MIN))).alias("target_negative_pct"))


def top3_summary(suggestions: DataFrame, roi_by_category: DataFrame) -> DataFrame:
    """Closing list: the three top-ranked improvements with their gross ROI % (0 if absent)."""
    r = roi_by_category.select("problem_type", "roi_percentage")
    return (suggestions.where(F.col("priority_rank") <= 3).join(r, "problem_type", "left")
            .select("priority_rank", "category", "priority_score", "estimated_cost",
                    F.coalesce("roi_percentage", F.lit(0.0)).alias("roi_percentage")))


def dashboard_summary(scored: DataFrame, generated_at: str | None = None) -> DataFrame:
    """Export-page summary: total rows, generation time (as given, or the time of
    the query), count and % per sentiment."""
    when = F.lit(generated_at) if generated_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm")
    per = scored.groupBy("bert_sentiment").agg(F.count(F.lit(1)).alias("count"))
    # at most four aggregated rows (three labels and null): the total is a window sum
    per = per.withColumn("n", F.sum("count").over(Window.partitionBy())).where(F.col("bert_sentiment").isNotNull())
    n = F.col("n")
    return per.select(n.alias("total_reviews"),
                      when.alias("generated_at"),
                      F.col("bert_sentiment").alias("sentiment"), "count",
                      (F.col("count") / n * 100).alias("share"))


def _lines(section: int, texts: list[Column], frame: DataFrame) -> DataFrame:
    return frame.select(F.posexplode(F.array(*texts)).alias("ord", "text")) \
        .select(F.lit(section).alias("section"), "ord", "text")


def business_report_lines(metrics: DataFrame, suggestions: DataFrame, roi_cat: DataFrame, roi_all: DataFrame,
                          position: DataFrame, generated_at: str | None = None, title: str = K.REPORT_TITLE) -> DataFrame:
    """The business report as ordered text lines ``(section, ord, text)``.

    ``metrics`` is one row of :func:`benchmark.benchmark_metrics`.  Sections, each
    under its heading: 1 title and summary with the return in total, 2 suggestions,
    3 return per category, 4 position with strengths, weaknesses and
    opportunities, 5 roadmap, 6 KPIs.  Without reviews only the title, the time and
    the headings are there.  ``generated_at`` is printed as given (default: the
    time of the query).  The priority ROI ratio is printed as a ratio.  Money uses
    thousands separators; percentages one decimal.
    """
    L, H = K.REPORT_LABELS, K.REPORT_HEADINGS
    when = F.lit(generated_at) if generated_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    negative = F.col("negative_count") / F.col("total_reviews") * 100
    top = suggestions.where(F.col("priority_rank") == 1).agg(F.first("category")).scalar()
    head = metrics.withColumn("top", top).where(F.col("total_reviews") > 0)
    fixed = [(1, 0, title), (1, 2, H["summary"]), (2, -1, H["suggestions"]), (3, -1, H["roi"]), (4, -2, H["position"]),
             (4, 0, K.REPORT_LISTS["strength"]), (4, 100, K.REPORT_LISTS["weakness"]), (4, 200, K.REPORT_LISTS["opportunity"]),
             (5, -1, H["roadmap"]), (6, -1, H["kpi"])]
    frame = metrics.select(F.inline(F.array(*[F.struct(F.lit(s).alias("section"), F.lit(o).alias("ord"), F.lit(t).alias("text"))
                                              for s, o, t in fixed])))
    time = metrics.select(F.lit(1).alias("section"), F.lit(1).alias("ord"), F.format_string(L["generated"], when).alias("text"))
    s1 = head.select(F.posexplode(F.array(
        F.format_string(L["total"], F.format_number("total_reviews", 0)),
        F.format_string(L["negative"], F.format_number("negative_count", 0), negative),
        F.format_string(L["mean"], F.col("average_rating")),
        F.when(F.col("top").isNotNull(), F.format_string(L["top"], F.col("top"))),
    )).alias("at", "text")).where(F.col("text").isNotNull()).select(F.lit(1).alias("section"), (F.col("at") + 3).alias("ord"), "text")
    total = roi_all.select(F.lit(1).alias("section"), F.lit(7).alias("ord"), F.format_string(
        L["roi_total"], F.format_number("total_investment", 0), F.format_number("total_expected_return", 1),
        F.col("overall_roi_percentage")).alias("text"))
    s2 = suggestions.select(F.lit(2).alias("section"), F.col("priority_rank").cast("int").alias("ord"), F.format_string(
        L["suggestion"],
        F.col("priority_rank"), F.col("category"), F.col("priority_score").cast("string"),
        F.col("affected_reviews"), F.format_number("estimated_cost", 0), F.col("roi_estimate"),
        F.col("implementation_timeline"), F.col("risk_level"), F.col("success_probability") * 100,
        F.array_join(F.slice("suggestions", 1, 3), " / ")).alias("text"))
    s3 = roi_cat.select(F.lit(3).alias("section"), F.col("priority_rank").cast("int").alias("ord"), F.format_string(
        L["roi"], F.col("category"), F.format_number("investment", 0), F.format_number("expected_revenue_recovery", 1),
        F.col("roi_percentage"), F.col("payback_period_months")).alias("text"))
    where = head.select(F.lit(4).alias("section"), F.lit(-1).alias("ord"), F.format_string(
        L["position"], percentile_position(F.col("average_rating")), F.col("average_rating"),
        F.col("negative_sentiment_rate") * 100).alias("text"))
    kind = F.element_at(F.create_map(*[F.lit(x) for k, v in (("strength", 0), ("weakness", 100), ("opportunity", 200)) for x in (k, v)]),
                        F.col("kind"))
    s4 = position.select(F.lit(4).alias("section"), (kind + F.col("ord")).cast("int").alias("ord"),
                         F.format_string(K.REPORT_ITEM, F.col("text")).alias("text"))
    plan = roadmap(suggestions)
    s5 = plan.select(F.lit(5).alias("section"), F.col("phase").cast("int").alias("ord"), F.when(
        F.col("phase") == 1, F.format_string(L["phase1"], F.col("category"), F.format_number("budget", 0)))
        .otherwise(F.format_string(L["phase2"], F.col("category"), F.format_number("budget", 0))).alias("text"))
    s6 = _lines(6, [
        F.format_string(L["kpi_rating"], F.col("average_rating"),
                        F.least(F.col("average_rating") + K.TARGET_RATING_STEP, F.lit(K.TARGET_RATING_MAX))),
        F.format_string(L["kpi_negative"], negative,
                        F.greatest(negative - K.KPI_NEGATIVE_PERCENT_STEP, F.lit(float(K.KPI_NEGATIVE_PERCENT_MIN)))),
        *[F.lit(x) for x in K.KPI_FIXED_LINES],
    ], head)
    out = frame
    for part in (time, s1, total, s2, s3, where, s4, s5, s6):
        out = out.unionByName(part)
    return out


def scoring_report_lines(report: DataFrame, title: str = K.SCORING_REPORT_TITLE) -> DataFrame:
    """:func:`scoring_report` as ordered text lines ``(section, ord, text)``.

    Sections: 1 title and basic figures, 2 sentiment by falling count (ties by
    label) and mean confidence, 3 accuracy, 4 negatives with the main problems, 5
    keywords, 6 next steps; the heading of a section whose figures are absent is
    left out.  The report has a few dozen rows.
    """
    L, H = K.SCORING_REPORT_LABELS, K.SCORING_REPORT_HEADINGS
    section, metric, value = F.col("section"), F.col("metric"), F.col("value")
    # counts and shares of one key become one row; every other figure is a row of its own
    share = metric.isin("pct", "pct_of_negative", "negative_pct")
    of = F.when(section == "negative", F.lit("negative")).when(section == "keywords", metric) \
        .when(section.isin("sentiment", "problems") & F.col("key").isNotNull(), F.lit("count")).otherwise(metric)
    rows = (report.groupBy(section, of.alias("of"), F.when(section != "keywords", F.col("key")).alias("key"))
            .agg(F.max(F.when(~share, value)).alias("n"), F.max(F.when(share, value)).alias("pct"),
                 F.array_sort(F.collect_list(F.when(section == "keywords", F.struct(value.alias("rank"), F.col("key").alias("term"))))).alias("terms")))
    place = F.row_number().over(Window.partitionBy("section", "of").orderBy(F.desc("n"), F.asc("key")))
    is_ = lambda name, what: (section == name) & (F.col("of") == what)
    number = F.format_number("n", 0)
    known = [
        (is_("basic", "total_reviews"), 1, F.lit(2), F.format_string(L["total"], number)),
        (is_("basic", "completion_pct"), 1, F.lit(3), F.format_string(L["completion"], F.col("n"))),
        (is_("sentiment", "count"), 2, F.col("place"), F.format_string(L["count"], F.col("key"), number, F.col("pct"))),
        (is_("sentiment", "avg_confidence"), 2, F.lit(100), F.format_string(L["confidence"], F.col("n"))),
        (is_("accuracy", "accuracy"), 3, F.lit(1), F.format_string(L["accuracy"], F.col("n"), F.col("n") * 100)),
        (is_("negative", "negative"), 4, F.lit(1), F.format_string(L["negative"], number, F.col("pct"))),
        (is_("problems", "count"), 4, F.col("place") + 2, F.format_string(L["problem"], F.col("key"), F.col("n").cast("bigint"), F.col("pct"))),
        *[(is_("keywords", name), 5, F.lit(k), F.format_string(L["keywords"], F.lit(name), F.array_join(F.col("terms.term"), ", ")))
          for k, name in ((1, K.NEGATIVE), (2, K.POSITIVE))],
    ]
    line = None
    for cond, number_of, order, text in known:
        entry = F.struct(F.lit(number_of).alias("section"), order.cast("int").alias("ord"), text.alias("text"))
        line = F.when(cond, entry) if line is None else line.when(cond, entry)
    lines = rows.withColumn("place", place).select(line.alias("line")).where("line IS NOT NULL AND line.text IS NOT NULL").select("line.*")
    headings = [(1, 1, H["basic"], 1, 0), (2, 0, H["sentiment"], 2, 0), (3, 0, H["accuracy"], 3, 0), (4, 0, H["negative"], 4, 0),
                (4, 2, H["problems"], 4, 3), (5, 0, H["keywords"], 5, 0)]
    present = lines.agg(*[F.max(((F.col("section") == s) & (F.col("ord") >= least)).cast("int")).alias(f"h{k}")
                          for k, (_, _, _, s, least) in enumerate(headings)])
    fixed = [(1, 0, title), *[(6, k, x) for k, x in enumerate((H["next"], *K.SCORING_REPORT_NEXT))]]
    as_line = lambda s, o, t: F.struct(F.lit(s).alias("section"), F.lit(o).alias("ord"), F.lit(t).alias("text"))
    around = present.select(F.explode(F.array(*[as_line(*x) for x in fixed], *[
        F.when(F.col(f"h{k}") == 1, as_line(s, o, t)) for k, (s, o, t, _, _) in enumerate(headings)])).alias("line")) \
        .where("line IS NOT NULL").select("line.*")
    return lines.unionByName(around)


def dashboard_summary_lines(scored: DataFrame, generated_at: str | None = None, title: str = K.DASHBOARD_TITLE) -> DataFrame:
    """The export page's summary as ordered Markdown lines ``(section, ord, text)``: the sentiments by
    falling count (ties by label).  Without rows the total is 0."""
    L, H = K.DASHBOARD_LABELS, K.DASHBOARD_HEADINGS
    when = F.lit(generated_at) if generated_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm")
    per = scored.groupBy("bert_sentiment").agg(F.count(F.lit(1)).alias("n"))
    # at most four aggregated rows (three labels and null)
    all_rows = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.array_sort(F.collect_list(
        F.when(F.col("bert_sentiment").isNotNull(), F.struct((-F.col("n")).alias("n"), F.col("bert_sentiment").alias("label"))))).alias("rows"))
    counts = F.transform("rows", lambda x: F.format_string(L["count"], x["label"], -x["n"], -x["n"] / F.col("total") * 100))
    texts = F.concat(F.array(F.lit(title), F.lit(H["overview"]), F.format_string(L["total"], F.format_number("total", 0)),
                             F.format_string(L["generated"], when), F.lit(H["sentiment"])), counts)
    return all_rows.select(F.lit(1).alias("section"), F.posexplode(texts).alias("ord", "text"))
