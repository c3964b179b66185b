"""Edge frames for the aggregate operators (empty inputs, ties, bounds)."""

from pyspark.sql import functions as F

from review_insights.operators import (charts, keywords, patterns, priority, roi, row_index, scoring,
                                       validation)

SCORED_SCHEMA = "review_id string, rating bigint, bert_sentiment string, bert_confidence double, " \
                "problem_category string, sentiment_label string, review_text string"


def _scored(spark, rows):
    return spark.createDataFrame(rows, SCORED_SCHEMA)


def test_no_negatives_gives_empty_patterns_and_suggestions(spark):
    df = _scored(spark, [("1", 5, "positive", 0.9, "none", "positive", "great")])
    pa = patterns.problem_analysis(df)
    assert pa.count() == 0
    assert priority.improvement_suggestions(priority.priority_scores(pa)).count() == 0
    assert roi.roi_overall(roi.roi_by_category(priority.improvement_suggestions(
        priority.priority_scores(pa)))).first().overall_roi_percentage == 0.0


def test_problem_percentage_counts_none_in_denominator(spark):
    rows = [("1", 1, "negative", 0.6, "quality", "negative", "bad"),
            ("2", 2, "negative", 0.8, "none", "negative", "x"),
            ("3", 1, "negative", 0.7, "quality", "negative", "bad"),
            ("4", 1, "negative", 0.7, "other", "negative", "x")]
    pa = {r.problem_type: r for r in patterns.problem_analysis(_scored(spark, rows)).collect()}
    assert set(pa) == {"quality", "other"}
    assert pa["quality"].percentage == 50.0 and pa["quality"]["count"] == 2


def test_priority_ties_keep_template_order(spark):
    # equal counts and confidences; taste and quality differ only by template values
    probs = spark.createDataFrame([("price", 1, 1.0, 0.5, 50.0), ("shipping", 1, 1.0, 0.5, 50.0)],
                                  "problem_type string, count bigint, avg_rating double, "
                                  "avg_confidence double, percentage double")
    ranks = {r.problem_type: r.priority_rank for r in priority.priority_scores(probs).collect()}
    assert ranks == {"price": 1, "shipping": 2}


def test_risk_and_success_ladders(spark):
    probs = spark.createDataFrame([("quality", 1000, 1.0, 0.5, 100.0), ("price", 100000, 1.0, 0.5, 100.0)],
                                  "problem_type string, count bigint, avg_rating double, "
                                  "avg_confidence double, percentage double")
    s = {r.problem_type: r for r in priority.improvement_suggestions(priority.priority_scores(probs)).collect()}
    # quality: 0.7 + 0.2 * 0.883 + min(0.1 * 0.13, 0.2)
    assert s["quality"].risk_level == "高" and abs(s["quality"].success_probability - 0.8896) < 1e-12
    # price: roi bonus capped at 0.2, total capped at 0.95; cost 25000 is low risk
    assert s["price"].risk_level == "低" and s["price"].success_probability == 0.95


def test_histogram_constant_column_puts_all_in_first_bin(spark):
    df = spark.createDataFrame([(0.7,), (0.7,), (None,)], "bert_confidence double")
    h = charts.confidence_histogram(df, 5).orderBy("bin").collect()
    assert [r["count"] for r in h] == [2, 0, 0, 0, 0]


def test_histogram_max_falls_in_last_bin(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "bert_confidence double")
    h = charts.confidence_histogram(df, 2).orderBy("bin").collect()
    assert [r["count"] for r in h] == [1, 2]


def test_confusion_matrix_label_only_in_predictions(spark):
    pairs = spark.createDataFrame([("positive", "positive"), ("negative", "neutral")],
                                  "true_label string, pred_label string")
    cm = {(r.true_label, r.pred_label): r["count"] for r in validation.confusion_matrix(pairs).collect()}
    assert len(cm) == 9 and cm[("negative", "neutral")] == 1 and cm[("neutral", "neutral")] == 0
    rep = {r.label: r for r in validation.classification_report(pairs).collect()}
    assert rep["neutral"].precision == 0.0 and rep["neutral"].support == 0
    assert rep["accuracy"].f1_score == 0.5


def test_tfidf_small_class_is_skipped(spark):
    # 7 documents: 0.7 * 7 < 5, so the class has no vocabulary
    rows = [(str(i), "negative", "tasty tasty snack bar") for i in range(7)]
    rows += [(f"p{i}", "positive", f"great coffee beans term{i % 2}") for i in range(10)]
    df = spark.createDataFrame(rows, "review_id string, bert_sentiment string, review_text string")
    kw = keywords.extract_keywords(df)
    assert {r.sentiment for r in kw.collect()} <= {"positive"}


def test_tfidf_norms_are_one(spark):
    rows = [(str(i), "positive", f"alpha beta gamma{'x' * (i % 3)} delta") for i in range(20)]
    df = spark.createDataFrame(rows, "review_id string, bert_sentiment string, review_text string")
    imp = keywords.keyword_importance(df, min_df=1, max_df=1.0)
    assert imp.count() > 0
    assert all(0 < r.importance <= 1 for r in imp.collect())


def test_top_k_per_group_matches_plain_window(spark):
    df = spark.range(2000).select((F.col("id") % 3).alias("g"), F.col("id").cast("string").alias("term"),
                                  (F.col("id") * 7919 % 1000).alias("v"))
    got = keywords.top_k_per_group(df, ["g"], [F.desc("v"), F.asc("term")], 10, "term", buckets=8)
    from pyspark.sql import Window
    ref = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("v"), F.asc("term"))))
    ref = ref.where("rank <= 10")
    assert sorted(got.collect()) == sorted(ref.select(*got.columns).collect())


def test_row_index_is_dense_and_partition_invariant(spark):
    base = spark.range(500).select(F.format_string("k%05d", "id").alias("k"))
    for parts in (1, 7):
        idx = row_index.with_row_index(base.repartition(parts), ["k"], "i", "n").collect()
        assert sorted(r.i for r in idx) == list(range(500))
        assert all(r.k == f"k{r.i:05d}" and r.n == 500 for r in idx)


def test_batch_scorer_failure_falls_back_per_batch(spark):
    class Broken:
        def __call__(self, texts):
            raise RuntimeError("model down")

    df = spark.createDataFrame([("1", "great"), ("2", None)], "review_id string, review_text string")
    out = scoring.score_sentiment(df, lambda: Broken()).collect()
    assert all(r.bert_sentiment == "neutral" and r.bert_confidence == 0.5 and r.score_error for r in out)


def test_golden_inline_reviews(spark):
    # the five smoke reviews: scored, classified and validated end to end
    rows = [("1", "This product is amazing! I love it so much.", 5, "positive"),
            ("2", "Terrible quality. Very disappointed.", 1, "negative"),
            ("3", "It's okay, nothing special.", 3, "neutral"),
            ("4", "Worst purchase ever. Complete waste of money.", 1, "negative"),
            ("5", "Great value for money. Highly recommended!", 5, "positive")]
    df = spark.createDataFrame(rows, "review_id string, review_text string, rating int, sentiment_label string")
    scored = scoring.score_lexicon(df)
    labels = [r.bert_sentiment for r in scored.orderBy("review_id").collect()]
    assert labels == ["positive", "negative", "neutral", "negative", "positive"]
    from review_insights.operators.problems import classify_problems
    probs = [r.problem_category for r in classify_problems(scored).orderBy("review_id").collect()]
    assert probs == ["none", "quality", "none", "quality", "none"]
    acc = validation.accuracy(validation.valid_pairs(scored)).first()
    assert acc.accuracy == 1.0 and acc.total_samples == 5


def test_row_index_splits_a_hot_key_and_stays_exact(spark):
    from review_insights.operators.row_index import with_row_index

    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.format_string("k%05d", "id")).alias("key"),
        F.col("id").cast("string").alias("payload"))
    out = with_row_index(df, ["key"], "pos", "total")
    rows = out.select("key", "payload", "pos", "total").collect()
    assert sorted(r.pos for r in rows) == list(range(3000)) and {r.total for r in rows} == {3000}
    expected = sorted(rows, key=lambda r: (r.key, r.payload))
    assert [r.pos for r in expected] == list(range(3000))
    # the range sort key carries the other columns, so equal keys can be split
    assert row_index._tie_breakers(df, ["key"]) == ["payload"]
