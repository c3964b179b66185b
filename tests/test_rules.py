"""One small hand-computed frame per null/format rule and per threshold."""

import math

from pyspark.sql import functions as F

from review_insights.functions.numeric import coerce_numeric, epoch_to_timestamp
from review_insights.functions.text import keyword_clean, strip_unicode
from review_insights.operators import conform, preprocess, problems
from review_insights.sources.readers import normalise_missing


def test_missing_tokens_become_null_but_lowercase_none_survives(spark):
    df = spark.createDataFrame([("NA",), ("n/a",), ("",), ("None",), ("none",), ("ok",)], "c string")
    out = [r.c for r in normalise_missing(df).collect()]
    assert out == [None, None, None, None, "none", "ok"]


def test_strip_matches_python_str_strip(spark):
    texts = ["  a b ", " x ", "\x1cy\x1f", "\tz\n", "　w "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(strip_unicode(F.col("t"))).collect()]
    assert got == [t.strip() for t in texts]


def test_keyword_clean_deletes_non_letters_and_keeps_unicode_space(spark):
    df = spark.createDataFrame([("Don't a.b C3",), (None,)], "t string")
    got = [r[0] for r in df.select(keyword_clean(F.col("t"))).collect()]
    assert got == ["dont ab c", ""]


def test_numeric_coercion_like_a_lenient_parser(spark):
    vals = [" 4 ", "1e0", "0x5", "5d", "nan", "inf", "2.9", "abc", None]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(coerce_numeric(F.col("v"))).collect()]
    assert got[:2] == [4.0, 1.0]
    assert got[2] is None and got[3] is None and got[4] is None
    assert math.isinf(got[5]) and got[6] == 2.9 and got[7] is None and got[8] is None


def test_rating_truncates_and_clips_before_int(spark):
    df = spark.createDataFrame([("r", v) for v in ["2.9", "0", "7", "inf", "3.5", "x"]], "review_id string, rating string")
    got = [r.rating for r in conform.coerce_rating(df).collect()]
    assert got == [2, 1, 5, 5, 3]


def test_epoch_guard(spark):
    df = spark.createDataFrame([(0.0,), (1e20,), (None,)], "t double")
    got = [r[0] for r in df.select(epoch_to_timestamp(F.col("t")).cast("string")).collect()]
    assert got == ["1970-01-01 00:00:00", None, None]


def test_sentiment_label_boundaries(spark):
    df = spark.createDataFrame([(r,) for r in [1.0, 2.0, 3.0, 3.5, 4.0, 5.0]], "rating double")
    got = [r.sentiment_label for r in preprocess.add_rating_features(df).collect()]
    assert got == ["negative", "negative", "neutral", "negative", "positive", "positive"]


def test_helpfulness_and_quality_flag(spark):
    df = spark.createDataFrame(
        [(5, 0, True, 25), (5, None, True, 25), (3, 4, True, 19), (None, 2, None, 30)],
        "helpful_votes int, total_votes int, verified_purchase boolean, review_length int")
    out = preprocess.add_quality_flag(preprocess.add_helpfulness(df)).collect()
    assert [r.helpfulness_ratio for r in out] == [5.0, None, 0.75, None]
    assert [r.is_high_quality for r in out] == [False, False, False, False]
    ok = spark.createDataFrame([(1, 1, True, 20)], "helpful_votes int, total_votes int, "
                               "verified_purchase boolean, review_length int")
    assert preprocess.add_quality_flag(ok).first().is_high_quality is True


def test_title_length_rule_and_keyword_order(spark):
    rows = [("abc", "I like green tea", "B1"), ("abcd", "coffee", "B1"), (None, "nothing here", "B7"),
            (None, "nothing", None), (None, "instead of rice", "B2")]
    df = spark.createDataFrame(rows, "review_title string, review_text string, product_id string")
    got = [r.product_name for r in conform.infer_product_fields(df).collect()]
    # 'tea' precedes 'green tea'; 'instead' contains 'tea'
    assert got == ["Tea", "abcd", "Product B7", "Unknown Food Product", "Tea"]


def test_category_inference_first_group_wins(spark):
    rows = [("chips and coffee", None), ("a snack", "x"), ("plain", "juice box"), ("plain", None)]
    df = spark.createDataFrame(rows, "review_text string, review_title string").withColumn("product_id", F.lit("B"))
    got = [r.product_category for r in conform.infer_product_fields(df).collect()]
    assert got == ["beverages", "snacks", "beverages", "food"]


def test_problem_classifier_ties_and_nulls(spark):
    rows = [("negative", "bad price"), ("negative", "overpriced"), ("negative", None),
            ("negative", "fine"), ("positive", "bad"), (None, "bad"), ("negative", "sweet and salty but bad")]
    df = spark.createDataFrame(rows, "bert_sentiment string, review_text string")
    got = [r.problem_category for r in problems.classify_problems(df).collect()]
    # 'overpriced' hits both 'overpriced' and 'price' (2 for price)
    assert got == ["quality", "price", "other", "other", "none", "none", "taste"]
