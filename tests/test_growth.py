"""Steps whose time or memory grew faster than they had to (FINDINGS_r03)."""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from review_insights.operators import keywords, sampling, scoring
from review_insights.plans.catalog import QUERIES
from review_insights.streaming import keyword_state, state
from tests_support import records_read


def test_copies_of_a_key_cost_few_passes(spark, monkeypatch):
    df = spark.range(30_000).select((F.col("id") % 3).cast("string").alias("k"))
    passes = []
    collect = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: passes.append(1) or collect(self))
    digits, missing = sampling._cut(df, 4_000, ["k"], 42, 2_000)
    monkeypatch.undo()
    assert len(passes) <= 2 and len(digits) == sampling.KEY_DIGITS + sampling.ROW_DIGITS
    assert sampling.exact_sample(df, 4_000, ["k"]).count() == 4_000


def test_training_reads_the_table_a_few_times_only(spark, tmp_path):
    rows = spark.range(30_000).select(F.concat(F.lit("good text "), F.translate((F.col("id") % 3).cast("string"), "012", "abc")).alias("review_text"),
                                      F.when(F.col("id") % 2 == 0, "positive").otherwise("negative").alias("sentiment_label"))
    rows.write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    read = records_read(spark, lambda: scoring.train_sentiment_model(df, num_features=1 << 6, max_iter=1, max_rows=4_000))
    assert read <= 5 * 30_000, read


def test_a_stream_computes_only_the_columns_that_metrics_need(spark, tmp_path):
    schema = "sentiment_label string, bert_sentiment string, problem_category string, rating bigint, bert_confidence double, " \
             "product_id string, user_id string, review_length bigint, extra string"
    spark.createDataFrame([("positive", "positive", "none", 5, 0.9, "p", "u", 12, "x")], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withColumn("extra", F.raise_error(F.col("extra")))
    state.start_metrics(stream, str(tmp_path / "state"), str(tmp_path / "checkpoint")).awaitTermination()
    assert state.merged_cube(spark, str(tmp_path / "state")).select("n").collect()[0][0] == 1


def test_exact_values_beside_sketches_sort_no_rows(spark, sf_small):
    plan = QUERIES["sketch_summary"](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"(Object|Sort)\w*Aggregate\(keys?=\[[^\]]", plan), plan


def test_document_weights_do_not_depend_on_batches():
    rng = np.random.default_rng(5)
    docs = [rng.integers(1, 9, rng.integers(1, 30)).astype(np.int32) for _ in range(60)]
    rows = [(k == 0, part) for d in docs for k, part in enumerate(np.array_split(d, 1 + len(d) // 8))]
    expected = np.zeros(9)
    for d in docs:
        ids, tf = np.unique(d, return_counts=True)
        w = tf * (ids / 10)
        expected[ids] += w / np.sqrt((w * w).sum())

    def batch(part):
        return pa.RecordBatch.from_arrays([pa.array([f for f, _ in part], pa.bool_()), pa.array([x for _, x in part], pa.list_(pa.int32())),
                                           pa.array([x / 10 for _, x in part], pa.list_(pa.float64()))], ["first", "ids", "idfs"])

    for size in (1, 2, 7, 1000):
        out = list(keywords._weight_sums(batch(rows[k:k + size]) for k in range(0, len(rows), size)))[0]
        found = np.zeros(9)
        found[out.column(0).to_numpy()] = out.column(1).to_numpy()
        assert np.allclose(found, expected)


def test_occurrences_are_not_shuffled_one_by_one(spark):
    df = spark.createDataFrame([("alpha beta alpha gamma", "positive")] * 30 + [("beta", "positive"), (None, "positive")], "review_text string, bert_sentiment string")
    plan = keywords.keyword_importance(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"HashAggregate\(keys=\[doc_id", plan), plan
    assert "namedlambdavariable" not in keywords.term_occurrences(df.select(
        F.col("bert_sentiment").alias("sentiment"), F.split("review_text", " ").alias("terms")))._jdf.queryExecution().optimizedPlan().toString().lower()


def test_a_batch_is_read_once_for_tokens_counts_and_sizes(spark, tmp_path):
    rows = spark.range(1_000).select(F.lit("alpha beta").alias("review_text"), F.lit("positive").alias("bert_sentiment"))
    rows.write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    cleaned = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: cleaned.add(1) or x)
    assert keyword_state.store_batch(df.withColumn("review_text", seen("review_text")), str(tmp_path / "state"), 0)
    assert cleaned.value == 1_000
    assert keyword_state.read_frames(spark, str(tmp_path / "state"), "sizes").collect()[0]["n"] == 1_000
