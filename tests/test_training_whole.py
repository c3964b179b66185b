"""The sentiment model is trained on every labelled row (F1)."""

import os

from pyspark.sql import functions as F

from review_insights.operators import scoring
from review_insights.plans import catalog
from review_insights.session import table_path
from tests_support import records_read


def reviews(spark, rows, path):
    """One review in fifty has a word of its own, one in seven no label, one in eleven no text; one label comes once."""
    k = F.col("id")
    text = F.when(k % 11 > 0, F.concat(F.lit("Plain tea"), F.when(k % 50 == 1, F.lit(" quince")).otherwise(F.lit(""))))
    label = F.when(k == 1, F.lit("neutral")).when(k % 7 > 0, F.when(k % 2 == 0, F.lit("positive")).otherwise(F.lit("negative")))
    spark.range(0, rows, 1, 4).select(text.alias("review_text"), label.alias("sentiment_label")).write.parquet(path)
    return spark.read.parquet(path)


def test_counts_of_the_model_come_from_all_rows(spark, tmp_path):
    rows = 240_000
    df = reviews(spark, rows, str(tmp_path / "rows"))
    models = []
    read = records_read(spark, lambda: models.append(scoring.train_sentiment_model(df, num_features=1 << 8, max_iter=2)))
    labelled = [k for k in range(rows) if k % 7 > 0]
    indexer, tf, idf, classifier = models[0].stages[0], models[0].stages[3], models[0].stages[4], models[0].stages[5]
    assert len(labelled) > 200_000 and idf.numDocs == len(labelled)
    assert idf.docFreq[tf.indexOf("quince")] == sum(k % 50 == 1 and k % 11 > 0 for k in labelled)
    assert idf.docFreq[tf.indexOf("tea")] == sum(k % 11 > 0 for k in labelled)
    assert indexer.labels == ["negative", "neutral", "positive"] and classifier.numClasses == 3
    # the texts are read once; label indexer, document frequencies and regression read their term counts
    assert read <= rows + 5 * len(labelled), read
    assert not [name for name in os.listdir(table_path(spark, "").removeprefix("file:")) if name.startswith("training-")]


def test_no_query_trains_on_a_sample(spark, sf_small, monkeypatch):
    monkeypatch.setattr(scoring, "exact_sample", lambda *a, **kw: (_ for _ in ()).throw(AssertionError("a sample was drawn")))
    for name in ("score_mllib", "score_saved_model"):
        assert catalog.QUERIES[name](spark, sf_small).count() > 0
