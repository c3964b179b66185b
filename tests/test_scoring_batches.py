"""Batches by work, bad rows alone, and models as versions."""

import random

import pytest

from review_insights.operators import scoring
from review_insights.plans import phases


def test_batches_stay_in_their_budget():
    rng = random.Random(1)
    for _ in range(200):
        lengths = [rng.randint(1, 60) for _ in range(rng.randint(0, 80))]
        budget = rng.randint(1, 200)
        batches = list(scoring.work_batches(lengths, budget))
        assert sorted(i for b in batches for i in b) == list(range(len(lengths)))
        for batch in batches:
            assert len(batch) == 1 or len(batch) * max(lengths[i] for i in batch) <= budget
        for one, two in zip(batches, batches[1:]):  # nothing of the next batch would have fitted
            assert (len(one) + 1) * lengths[two[0]] > budget


def test_one_bad_row_in_ten_thousand_marks_one_row():
    calls = []

    def scorer(texts):
        calls.append(len(texts))
        if "bad" in texts:
            raise ValueError
        return [("POSITIVE", 0.9)] * len(texts)

    texts = ["fine"] * 10_000
    texts[6_789] = "bad"
    found, failed = scoring.score_or_halve(scorer, texts)
    assert [i for i, f in enumerate(failed) if f] == [6_789] and found[6_789] == ("neutral", 0.5)
    assert found.count(("POSITIVE", 0.9)) == 9_999 and len(calls) < 40


@pytest.mark.parametrize("result", [[("POSITIVE", 0.5)], [("POSITIVE", "x")] * 3, None])
def test_results_of_the_wrong_shape_are_failures(result):
    found, failed = scoring.score_or_halve(lambda texts: result if len(texts) != 1 else None, ["a", "b", "c"])
    assert failed == [True] * 3 and found == [("neutral", 0.5)] * 3
    assert scoring.score_or_halve(lambda texts: [], []) == ([], [])


def test_same_labels_in_bounded_batches(spark):
    class Recorder(scoring.PandasLexiconScorer):
        """Fails when a call holds more work than allowed, so that a row would be marked."""

        def __call__(self, texts):
            lengths = [min(scoring.word_count(t), 20) for t in texts]
            assert len(texts) == 1 or len(texts) * max(lengths) <= 64
            return super().__call__(texts)

    rng = random.Random(2)
    words = ["good", "bad", "tea", "stale", "love", "waste", "box"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 15, 200]))) if k % 9 else None) for k in range(500)]
    df = spark.createDataFrame(rows, "review_id long, review_text string").repartition(3)
    found = scoring.score_sentiment(df, Recorder, batch_tokens=64, max_tokens=20, model_key="lexicon-1")
    wanted = scoring.score_lexicon(df)
    columns = ["review_id", "bert_sentiment", "bert_confidence"]
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(map(tuple, wanted.select(*columns).collect()))
    assert found.where("score_error").count() == 0


def test_a_worker_loads_a_model_once(spark, tmp_path):
    mark = str(tmp_path / "loads")

    def factory():
        with open(mark, "a") as f:
            f.write("x")
        return scoring.PandasLexiconScorer()

    one = spark.sparkContext.defaultParallelism
    df = spark.range(0, 400, 1, 4 * one).select("id", scoring.F.lit("good tea").alias("review_text"))
    for _ in range(2):
        scoring.score_sentiment(df, factory, model_key="once-1").write.format("noop").mode("overwrite").save()
    with open(mark) as f:
        assert 1 <= len(f.read()) <= 2 * one  # processes, not tasks


def test_phase_2_scores_with_a_saved_model(spark, tmp_path):
    rows = [(f"r{k}", "p", 5.0 if k % 2 else 1.0, "good tea" if k % 2 else "bad tea", "positive" if k % 2 else "negative", 8) for k in range(60)]
    path = str(tmp_path / "processed")
    spark.createDataFrame(rows, "review_id string, product_id string, rating double, review_text string, sentiment_label string, "
                                "review_length int").write.parquet(path)
    first = phases.analyze_phase(spark, path, str(tmp_path / "out"), scorer="mllib")
    assert first.versions["sentiment_model"] == 1
    saved = str(tmp_path / "out" / "sentiment_model")
    again = phases.analyze_phase(spark, path, str(tmp_path / "out"), scorer="mllib", model_path=saved)
    assert "sentiment_model" not in again.versions and again.versions["scored"] == 2
    label = lambda p: {r["review_id"]: r["bert_sentiment"] for r in spark.read.parquet(p.tables["scored"]).collect()}
    assert label(first) == label(again) and set(label(first).values()) == {"positive", "negative"}
    with pytest.raises(FileNotFoundError):
        scoring.load_model(spark, saved, 5)


def test_small_batches_cost_no_more_than_large_ones():
    """A call costs in proportion to its texts: bounded work and halving make many small batches."""
    import time

    texts = ["great tea but stale and bad packaging number %d" % k for k in range(20_000)]
    scorer = scoring.PandasLexiconScorer()
    start = time.perf_counter()
    whole = scorer(texts)
    middle = time.perf_counter()
    small = [found for k in range(0, len(texts), 10) for found in scorer(texts[k:k + 10])]
    end = time.perf_counter()
    assert small == whole
    assert end - middle < 5 * (middle - start) + 1


def test_lexicon_results_of_single_texts():
    found = scoring.PandasLexiconScorer()(["GREAT but bad, terrible", "", None, float("nan"), "Great", "good and bad"])
    assert [label for label, _ in found] == ["NEGATIVE", "NEUTRAL", "NEUTRAL", "NEUTRAL", "POSITIVE", "NEUTRAL"]
    assert [round(score, 9) for _, score in found] == [round(0.5 + 0.5 / 3, 9), 0.5, 0.5, 0.5, 1.0, 0.5]
