"""Keywords counted by runs of documents."""

import random

import pyarrow as pa
import pytest

from review_insights.functions.stopwords import english_stop_words
from review_insights.operators import keywords, scoring
from review_insights.plans.catalog import QUERIES
from tests_support import records_read

ALPHABET = "abAB\t\n\x0b\x0c\r \x85\xa0   ​    　\x1c1'-é中İK"


def texts(n=1_500):
    rng = random.Random(4)
    made = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(n)]
    return made + [None, "", "the tea and the Box", "a b c", None, "tea"]


def test_a_class_made_from_the_text_is_computed_once_a_row(spark, sf_small):
    """A filter on the class, moved below the lexicon, held a copy of it for each use."""
    docs = keywords.keyword_documents(scoring.score_lexicon(spark.read.parquet(f"{sf_small}/documents.parquet"), "text"), "text")
    plan = keywords.class_sizes(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1, plan


def test_occurrences_are_added_up_before_they_are_rows(spark, sf_small):
    plan = QUERIES["document_keywords"](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert "explode(arrays_zip" not in plan and "explode(terms" not in plan


def test_tokens_equal_the_column_expressions(spark):
    made = texts()
    df = spark.createDataFrame([(k, t) for k, t in enumerate(made)], "k int, t string")
    wanted = {r["k"]: r["w"] for r in df.select("k", keywords.kept_tokens(keywords.keyword_clean(df["t"])).alias("w")).collect()}
    for lo, hi in ((0, len(made)), (5, 40), (len(made) - 6, len(made))):
        document, word, words = keywords._piece_tokens(pa.array(made, pa.string())[lo:hi], pa.array(list(english_stop_words())))
        found = [[] for _ in range(lo, hi)]
        for d, w in zip(document, word):
            found[d].append(words[w].as_py())
        assert found == [wanted[k] for k in range(lo, hi)]


@pytest.mark.parametrize("piece", [1, 40, 1 << 20])
def test_counts_and_weights_do_not_depend_on_pieces(spark, monkeypatch, piece):
    monkeypatch.setattr(keywords, "PIECE_BYTES", piece)
    rng = random.Random(6)
    rows = [(t, rng.choice(["positive", "negative", None, "other"])) for t in texts(300)]
    df = spark.createDataFrame(rows, "review_text string, bert_sentiment string").repartition(3)
    docs = keywords.keyword_documents(df)
    terms = keywords.document_terms(docs)
    counted = keywords._summed(keywords.piece_counts(docs)).select("sentiment", "term", "total", "df")
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, keywords.term_counts(terms).collect()))
    vocab = keywords.vocabulary(docs, keywords.class_sizes(docs), 50, 1, 1.0)
    weights = [sorted((r["sentiment"], r["term"], round(r["importance"], 12)) for r in w.collect())
               for w in (keywords.weighted(terms, vocab), keywords.keyword_importance(df, max_features=50, min_df=1, max_df=1.0))]
    assert weights[0] == weights[1] and weights[0]


def test_no_rows_at_all(spark):
    empty = spark.createDataFrame([(None, "positive"), ("1 2", "positive"), ("x", None)], "review_text string, bert_sentiment string")
    assert keywords.extract_keywords(empty, min_df=1, max_df=1.0).count() == 0


def test_a_filter_on_the_result_adds_no_pass(spark, tmp_path):
    rows = [(t, "positive" if k % 2 else "negative") for k, t in enumerate(["good tea box"] * 300 + ["bad tea"] * 300)]
    spark.createDataFrame(rows, "review_text string, bert_sentiment string").write.parquet(str(tmp_path / "rows"))
    found = keywords.extract_keywords(spark.read.parquet(str(tmp_path / "rows")), max_df=1.0)
    assert records_read(spark, lambda: found.where("sentiment = 'positive'").collect()) <= 3 * len(rows)
