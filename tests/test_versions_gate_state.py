"""Versioned tables, the quality gate, and metrics stored batch by batch."""

import random

import pytest
from pyspark.sql import functions as F

from review_insights.operators import benchmark, gate, patterns, validation
from review_insights.plans import frames, phases
from review_insights.sources import versions
from review_insights.streaming import state


def numbers(spark, path, n=None):
    return sorted(r["id"] for r in versions.read_version(spark, path, n).collect())


def test_versions_follow_one_another(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        versions.current(spark, path)
    assert versions.publish(spark.range(3), path).number == 1
    v = versions.publish(spark.range(5), path)
    assert (v.number, v.rows) == (2, 5) and numbers(spark, path) == [0, 1, 2, 3, 4] and numbers(spark, path, 1) == [0, 1, 2]
    assert [x.number for x in versions.expire(spark, path, keep=1)] == [1]
    assert [x.number for x in versions.history(spark, path)] == [2] and numbers(spark, path) == [0, 1, 2, 3, 4]
    with pytest.raises(FileNotFoundError):
        versions.read_version(spark, path, 1)


def test_a_failing_write_or_check_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.publish(spark.range(3), path)
    half = spark.range(0, 1000, 1, 4).select(F.when(F.col("id") == 700, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        versions.publish(half, path)

    def refuse(table, rows):
        assert (table.count(), rows) == (9, 9)
        raise versions.GateError("no")

    with pytest.raises(versions.GateError):
        versions.publish(spark.range(9), path, refuse)
    assert numbers(spark, path) == [0, 1, 2] and versions.publish(spark.range(1), path).number == 2


def test_a_number_is_taken_once(spark, tmp_path):
    files = versions._Files(spark, str(tmp_path))
    assert files.create_whole(f"{tmp_path}/m/1.json", "a") and not files.create_whole(f"{tmp_path}/m/1.json", "b")
    assert files.read(f"{tmp_path}/m/1.json") == "a" and files.names(f"{tmp_path}/m") == ["1.json"]


def test_checks_of_a_written_table(spark):
    from pyspark.sql import Observation

    df = spark.createDataFrame([("a", 5, "positive", None)] * 30 + [(None, 50, "negative", None), ("b", 50, None, None)],
                               "review_id string, review_length int, sentiment_label string, `odd name.x` string")
    seen = Observation("q")
    gate.observe_checks(df, seen).write.format("noop").mode("overwrite").save()
    found = {(r.check, r.item): (r.value, r.failed) for r in gate.results(df.columns, seen.get)}
    assert found == {("missing", "review_id"): (1, True), ("missing", "sentiment_label"): (1, True), ("missing", "odd name.x"): (32, True),
                     ("short", None): (30, True), ("imbalance", "negative"): (1, True)}
    assert gate.results([], {"rows": 0, "short": 0}) == [gate.CheckResult("short", None, 0, False)]
    with pytest.raises(ValueError):
        gate.stopping([], ["nothing"])


def test_a_failing_gate_stops_phase_1(spark, sf_small, tmp_path):
    out_dir, raw = str(tmp_path), frames.review_raw(spark, sf_small)
    first = phases.collect_phase(spark, raw, out_dir)
    assert first.rows["quality_checks"] == len(first.checks) > 0 and first.versions["processed"] == 1
    short = next(r for r in first.checks if r.check == "short")
    if not short.failed:
        raw = raw.withColumn("Text", F.lit("tiny"))
    with pytest.raises(versions.GateError):
        phases.collect_phase(spark, raw, out_dir, stop_on=["short"])
    assert versions.current(spark, f"{out_dir}/processed_data").number == 1  # readers keep the version before
    assert versions.current(spark, f"{out_dir}/quality_checks").number == 2  # and see why
    assert phases.collect_phase(spark, raw, out_dir).versions["processed"] == 2


def test_phases_write_charts_and_texts(spark, sf_small, tmp_path):
    p1 = phases.collect_phase(spark, frames.review_raw(spark, sf_small), str(tmp_path))
    p2 = phases.analyze_phase(spark, p1.tables["processed"], str(tmp_path), scorer="given")
    p3 = phases.improve_phase(spark, p2.tables["scored"], str(tmp_path))
    assert spark.read.parquet(p1.tables["data_summary"]).count() > 0
    text = [r.value for r in spark.read.text(p2.tables["scoring_report_text"]).collect()]
    assert text[0] == "レビュー感情分析 - サマリーレポート" and text[-1] == "4. Webアプリケーション開発"
    assert spark.read.text(p2.tables["dashboard_summary"]).first().value == "# レビュー分析 - サマリーレポート"
    assert spark.read.parquet(p2.tables["chart_confidence_histogram"]).count() == 50
    for name in ("chart_label_comparison", "chart_problem_share", "chart_rating_sentiment", "chart_sentiment_counts"):
        assert p2.rows[name] == spark.read.parquet(p2.tables[name]).count() > 0
    assert p3.rows["top3_summary"] == min(3, p3.rows["improvement_suggestions"]) and p3.rows["roadmap"] <= 2 and p3.rows["kpi_targets"] == 1
    assert p3.rows["chart_priority_roi"] == p3.rows["improvement_suggestions"] and p3.rows["chart_problem_names"] == p3.rows["problem_analysis"]


SCHEMA = ("sentiment_label string, bert_sentiment string, problem_category string, rating double, bert_confidence double, "
          "product_id string, user_id string, review_length int")


def reviews(spark, n, seed):
    rng = random.Random(seed)
    labels = ["positive", "negative", "neutral", None]
    return spark.createDataFrame([(rng.choice(labels), rng.choice(labels), rng.choice(["none", "taste", "price", "other"]),
                                   rng.choice([1.0, 2.0, 3.0, 4.0, 5.0, None]), rng.choice([None, rng.random()]), f"p{rng.randint(0, 4000)}",
                                   f"u{rng.randint(0, n)}", rng.randint(0, 500)) for _ in range(n)], SCHEMA)


def plain(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


def test_state_equals_the_batch_queries(spark, tmp_path):
    path, parts = str(tmp_path / "s"), [reviews(spark, n, k) for k, n in enumerate((400, 1, 900, 0, 50))]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)

    def same():
        cubes = state.merged_cube(spark, path)
        problems = patterns.problem_analysis(whole)
        assert plain(state.problem_analysis(cubes).select(*problems.columns)) == plain(problems)
        assert plain(state.classification_report(cubes)) == plain(validation.classification_report(validation.valid_pairs(whole)))
        assert plain(state.benchmark_metrics(cubes)) == plain(benchmark.benchmark_metrics(whole))

    for k, part in enumerate(parts):
        assert state.store_batch(part, path, k)
    same()
    assert not state.store_batch(whole, path, 2)  # a replayed batch changes nothing
    same()
    assert state.compact(spark, path) == 5 and state.stored_batches(spark, path) == [0, 1, 2, 3, 4]
    same()
    assert not state.store_batch(whole, path, 4)  # not after folding either
    extra = reviews(spark, 70, 9)
    assert state.store_batch(extra, path, 5)
    whole = whole.unionByName(extra)
    same()
    assert state.compact(spark, path) == 6
    same()


def test_a_batch_that_failed_half_way_is_stored_again(spark, tmp_path):
    path = str(tmp_path / "s")
    state.store_batch(reviews(spark, 10, 1), path, 0)
    bad = reviews(spark, 10, 2).withColumn("bert_confidence", F.when(F.col("rating") > 0, F.raise_error(F.lit("lost"))).cast("double"))
    with pytest.raises(Exception, match="lost"):
        state.store_batch(bad, path, 1)
    assert state.stored_batches(spark, path) == [0] and state.merged_cube(spark, path).agg(F.sum("n")).first()[0] == 10
    assert state.store_batch(reviews(spark, 5, 3), path, 1)
    assert state.merged_cube(spark, path).agg(F.sum("n")).first()[0] == 15


def test_sketches_stay_in_their_bounds(spark, tmp_path):
    path = str(tmp_path / "s")
    parts = [reviews(spark, 4000, k) for k in range(4)]
    whole = parts[0]
    for k, part in enumerate(parts):
        state.store_batch(part, path, k)
        whole = whole if k == 0 else whole.unionByName(part)
    found = {r["metric"]: r["estimate"] for r in state.sketch_summary(state.merged_sketches(spark, path)).collect()}
    exact = whole.agg(F.countDistinct("product_id"), F.countDistinct("user_id"), F.percentile("review_length", F.array(F.lit(0.48), F.lit(0.52)))).first()
    assert abs(found["unique_products"] / exact[0] - 1) < 0.03 and abs(found["unique_users"] / exact[1] - 1) < 0.03
    assert exact[2][0] <= found["median_review_length"] <= exact[2][1]
