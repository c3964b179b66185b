"""Hand-written expected values: the twins share the constants, so these do not come from them."""

import pytest
from pyspark.sql import functions as F

from review_insights.functions.stopwords import english_stop_words, read_stop_words
from review_insights.operators import benchmark, keywords, problems
from review_insights.functions.labels import rating_to_sentiment


def test_stop_words_of_the_reference_vectoriser():
    words = english_stop_words()
    assert len(words) == 318 == len(set(words)) and words[:5] == ("a", "about", "above", "across", "after")
    assert {"cant", "couldnt", "hasnt", "whereupon", "yourselves"} <= set(words)
    assert not {"good", "taste", "coffee", "dont"} & set(words)


def test_stop_words_are_a_parameter(tmp_path):
    path = tmp_path / "words.txt"
    path.write_text("alpha beta\ngamma alpha\n")
    assert read_stop_words(str(path)) == ("alpha", "beta", "gamma")


def test_contractions_lose_their_apostrophe_before_the_stop_list(spark):
    docs = spark.createDataFrame([("1", "positive", "I can't drink it, it hasn't a fresh taste")],
                                 "review_id string, bert_sentiment string, review_text string")
    terms = keywords.document_terms(keywords.keyword_documents(docs)).first()["terms"]
    assert terms == ["drink", "fresh", "taste", "drink fresh", "fresh taste"]


@pytest.mark.parametrize("rating, label", [(1, "negative"), (2, "negative"), (3, "neutral"), (4, "positive"), (5, "positive")])
def test_labels(spark, rating, label):
    assert spark.range(1).select(rating_to_sentiment(F.lit(rating)).alias("l")).first()["l"] == label


@pytest.mark.parametrize("mean, place", [(4.6, 90), (4.5, 90), (4.2, 75), (3.5, 50), (3.1, 25), (2.9, 10)])
def test_percentile_ladder(spark, mean, place):
    assert spark.range(1).select(benchmark.percentile_position(F.lit(mean)).alias("p")).first()["p"] == place


@pytest.mark.parametrize("text, kind", [("the flavor is bland", "taste"), ("poor and stale", "quality"), ("it arrived in a terrible state", "quality"),
                                        ("too expensive", "price"), ("late delivery", "shipping"), ("no response from support", "service")])
def test_problem_types(spark, text, kind):
    df = spark.createDataFrame([(text, "negative")], "review_text string, bert_sentiment string")
    assert problems.classify_problems(df).first()["problem_category"] == kind
