"""Exact samples against a sort in plain Python."""

import hashlib
import random

import pytest

from review_insights.operators import sampling, scoring

SCHEMA = "id string, text string"


def wanted(rows, n, seed=42):
    """The first rows by hash of the key; rows of one key are told apart by content only."""
    digest = lambda r: hashlib.md5(f"{r[0] or ''}|{seed}".encode()).hexdigest()
    return sorted(map(digest, rows))[:n]


def checked(df, rows, n, **kw):
    found = [tuple(r) for r in sampling.exact_sample(df, n, ["id"], **kw).collect()]
    assert len(found) == min(n, len(rows))
    digests = sorted(hashlib.md5(f"{r[0] or ''}|{kw.get('seed', 42)}".encode()).hexdigest() for r in found)
    assert digests == wanted(rows, n, kw.get("seed", 42))
    left = {}
    for r in rows:
        left[r] = left.get(r, 0) + 1
    for r in found:
        left[r] -= 1
        assert left[r] >= 0
    return sorted(found, key=str)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(sampling, "TOP_K", 3)
    monkeypatch.setattr(sampling, "NEAR_LEAST", 20)


def test_distinct_keys(spark, small):
    rows = [(f"r{k}", f"text {k}") for k in range(3000)]
    for n in (0, 3, 4, 1000, 2999, 3000, 5000):
        results = {str(checked(spark.createDataFrame(rows, SCHEMA).repartition(p), rows, n)) for p in (1, 5)}
        assert len(results) == 1


def test_repeated_keys_and_copies(spark, small):
    """A third of all rows has one key: some of them copies, some with their own texts; nulls are a key."""
    rng = random.Random(1)
    rows = ([("hot", "same")] * 700 + [("hot", f"own {k}") for k in range(700)] + [(None, None)] * 300
            + [(f"r{rng.randint(0, 900)}", rng.choice(["a", "b", None])) for _ in range(2000)])
    for n in (5, 500, 1200, 2500, 3699, 3700):
        results = {str(checked(spark.createDataFrame(rows, SCHEMA).repartition(p), rows, n)) for p in (1, 6)}
        assert len(results) == 1


def test_selection_equals_the_top_k(spark, monkeypatch):
    rows = [(f"r{k % 800}", f"text {k % 950}") for k in range(2000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    top = sorted(map(tuple, sampling.exact_sample(df, 900, ["id"]).collect()))
    monkeypatch.setattr(sampling, "TOP_K", 10)
    monkeypatch.setattr(sampling, "NEAR_LEAST", 15)
    assert top == sorted(map(tuple, sampling.exact_sample(df, 900, ["id"]).collect()))


def test_empty_and_seed(spark, small):
    df = spark.createDataFrame([], SCHEMA)
    assert sampling.exact_sample(df, 10, ["id"]).count() == 0
    rows = [(f"r{k}", "t") for k in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert checked(df, rows, 100, seed=1) != checked(df, rows, 100, seed=2)


def test_no_task_sorts_the_texts(spark, small, monkeypatch):
    """Rows that are certain are not exchanged; only those near the cut meet, as distinct rows."""
    monkeypatch.setattr(sampling, "DIGITS", 1)
    df = spark.createDataFrame([(f"r{k}", "x" * 50) for k in range(5000)], SCHEMA).repartition(4)
    plan = sampling.exact_sample(df, 2500, ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "GlobalLimit" not in plan and "Union" in plan
    near = sampling._cut(df, 2500, ["id"], 42, 125)
    inside = df.where(sampling.order_columns(df, ["id"], 42)[0].startswith(near[0])).count()
    assert near[1] < inside <= 125


def test_training_rows_are_an_exact_sample(spark, small):
    df = spark.createDataFrame([("good tea" if k % 2 else "bad tea", "positive" if k % 2 else "negative") for k in range(400)],
                               "review_text string, sentiment_label string")
    model = scoring.train_sentiment_model(df, max_rows=100, max_iter=3, num_features=64)
    assert scoring.score_with_model(model, df).count() == 400
