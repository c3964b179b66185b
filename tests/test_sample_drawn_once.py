"""The training sample is drawn in one pass, and scoring makes probabilities only."""

from pyspark.sql import functions as F

from review_insights.operators import sampling, scoring
from tests_support import records_read


def test_a_sample_with_copies_is_drawn_in_one_pass(spark, tmp_path):
    rows = spark.range(0, 30_000, 1, 3).select(F.concat(F.lit("text "), (F.col("id") % 7).cast("string")).alias("t"),
                                               F.when(F.col("id") % 5 > 0, F.col("id") % 2).alias("l"))
    rows.write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    first, row = sampling.order_columns(df, ["t"], 42)
    wanted = df.orderBy(first, row).limit(9_000).groupBy("t", "l").count().collect()
    sample = sampling.exact_sample(df, 9_000, ["t"])
    assert sorted(map(str, sample.groupBy("t", "l").count().collect())) == sorted(map(str, wanted))
    assert records_read(spark, lambda: sample.write.format("noop").mode("overwrite").save()) == 30_000


def test_a_model_is_scored_without_raw_predictions(spark):
    df = spark.createDataFrame([("good tea", "positive"), ("bad tea", "negative"), ("plain tea", "neutral"), (None, "neutral")] * 10,
                               "review_text string, sentiment_label string")
    model = scoring.train_sentiment_model(df, num_features=1 << 6, max_iter=3)
    scored = scoring.score_with_model(model, df)
    assert scored.columns == ["review_text", "sentiment_label", "bert_confidence", "bert_sentiment"]
    text = df.withColumn("_text", F.coalesce("review_text", F.lit("")))
    plain = model.stages[-1].transform(model.stages[4].transform(model.stages[3].transform(model.stages[2].transform(model.stages[1].transform(text)))))
    labels = model.stages[0].labels
    wanted = [(labels[int(r["_pred"])], max(r["_prob"])) for r in plain.collect()]
    assert [(r["bert_sentiment"], r["bert_confidence"]) for r in scored.collect()] == wanted
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("UDF(") <= 6, plan
