"""The sketched vocabulary equals the plain one, whatever the bounds; rare terms stay out of the shuffle."""

import random

import pytest

from review_insights.operators import keywords
from review_insights.operators.dims import spread

SCHEMA = "review_text string, bert_sentiment string"


@pytest.fixture(scope="module")
def reviews(spark):
    rng = random.Random(3)
    words = [f"{a}{b}" for a in "abcdefghij" for b in ("ka", "lo", "mi", "nu")]
    weights = [1 / (k + 1) for k in range(len(words))]
    rows = [(" ".join(rng.choices(words, weights, k=rng.randint(0, 25))), rng.choice(["positive"] * 6 + ["negative"] * 3 + ["neutral", None, "other"]))
            for _ in range(600)]
    rows += [("copied text of many rows", "negative")] * 300 + [(None, "positive"), ("", "neutral")] * 3
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def rows_of(df):
    return sorted((r["sentiment"], r["rank"], r["term"], round(r["importance"], 9)) for r in df.collect())


@pytest.mark.parametrize("width, one_in, candidates, max_features", [
    (1 << 16, 16, 4, 50), (7, 3, 1, 20), (64, 1, 2, 30), (1 << 10, 1_000_000, 4, 40), (256, 2, 1, 100_000)])
def test_same_keywords(monkeypatch, reviews, width, one_in, candidates, max_features):
    for name, value in (("SKETCH_WIDTH", width), ("SAMPLE_ONE_IN", one_in), ("CANDIDATES", candidates)):
        monkeypatch.setattr(keywords, name, value)
    plain = keywords.extract_keywords(reviews, top_k=30, max_features=max_features)
    sketched = keywords.extract_keywords(reviews, top_k=30, max_features=max_features, sketch=True)
    assert rows_of(sketched) == rows_of(plain)


def test_counts_are_exact(monkeypatch, reviews):
    """Every eligible term at the floor or above has its exact counts."""
    monkeypatch.setattr(keywords, "SKETCH_WIDTH", 512)
    terms = keywords.document_terms(keywords.keyword_documents(reviews))
    sizes = keywords.class_sizes(terms)
    exact = {(r["sentiment"], r["term"]): (r["total"], r["df"]) for r in keywords._counts(keywords.term_occurrences(terms), "term").collect()}
    found = [tuple(r) for r in keywords.sketched_counts(terms, sizes, 20, 5, 0.7).collect()]
    assert len({r[:2] for r in found}) == len(found) < len(exact)
    assert all(exact[r[:2]] == r[2:] for r in found)


def test_empty_input(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert keywords.extract_keywords(df, sketch=True).count() == 0


def test_small_inputs_are_dealt_out(spark, sf_small, monkeypatch):
    df = spark.read.parquet(f"{sf_small}/documents.parquet")
    assert "Repartition" in spread(df)._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr("review_insights.operators.dims.SPREAD_BYTES", 1)
    assert spread(df) is df


def test_keywords_of_stored_batches_equal_the_whole_run(spark, reviews, tmp_path):
    from review_insights.streaming import keyword_state as ks

    path = str(tmp_path / "keywords")
    parts = reviews.randomSplit([0.5, 0.3, 0.2], seed=3)
    whole = None
    for k, part in enumerate(parts):
        part = spark.createDataFrame(part.collect(), SCHEMA).repartition(2)
        whole = part if whole is None else whole.unionByName(part)
        assert ks.store_batch(part, path, k)
        assert rows_of(ks.current_keywords(spark, path)) == rows_of(keywords.extract_keywords(whole))
    assert not ks.store_batch(whole, path, 1)  # a replayed batch changes nothing
    assert ks.compact(spark, path) == 3
    assert rows_of(ks.current_keywords(spark, path)) == rows_of(keywords.extract_keywords(whole))
    more = spark.createDataFrame([("fresh words of a later batch", "positive")] * 40, SCHEMA)
    assert ks.store_batch(more, path, 3)
    assert rows_of(ks.current_keywords(spark, path)) == rows_of(keywords.extract_keywords(whole.unionByName(more)))


def test_stored_keywords_read_no_text(spark, reviews, tmp_path):
    from review_insights.streaming import keyword_state as ks

    path = str(tmp_path / "keywords")
    ks.store_batch(reviews, path, 0)
    plan = ks.current_keywords(spark, path)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and "lower(" not in plan
