"""End-to-end phase plans on written tables, and the streaming path."""

import os
import tempfile

from pyspark.sql import functions as F

from review_insights.operators import patterns
from review_insights.plans import frames, phases
from review_insights.sources.fixture import review_fixture
from review_insights import streaming


def test_three_phases_write_and_chain(spark, sf_small):
    out_dir = tempfile.mkdtemp(prefix="ri-phases-")
    raw = frames.review_raw(spark, sf_small)
    p1 = phases.collect_phase(spark, raw, out_dir)
    assert p1.rows["raw"] >= p1.rows["processed"] > 0 and p1.rows["dropped"] >= 0
    p2 = phases.analyze_phase(spark, p1.tables["processed"], out_dir, scorer="given")
    assert p2.rows["scored"] == p1.rows["processed"]
    p3 = phases.improve_phase(spark, p2.tables["scored"], out_dir)
    written = {r.problem_type: r["count"] for r in spark.read.parquet(p3.tables["problem_analysis"]).collect()}
    direct = {r.problem_type: r["count"] for r in patterns.problem_analysis(frames.scored(spark, sf_small)).collect()}
    assert written == direct
    lines = [r.value for r in spark.read.text(p3.tables["business_report"]).collect()]
    headings = ["レビュー分析 - ビジネス改善提案レポート", "エグゼクティブサマリー", "改善提案詳細（優先度順）", "ROI・投資対効果分析",
                "競合比較・市場ポジション", "実装ロードマップ", "成功指標・KPI"]
    assert lines[0] == headings[0] and [x for x in lines if x in headings] == headings
    assert all(lines.index(b) - lines.index(a) > 1 for a, b in zip(headings, headings[1:])) and lines[-1] != headings[-1]


def test_lexicon_scorer_phase(spark, sf_small):
    out_dir = tempfile.mkdtemp(prefix="ri-phases-")
    p1 = phases.collect_phase(spark, frames.review_raw(spark, sf_small), out_dir)
    p2 = phases.analyze_phase(spark, p1.tables["processed"], out_dir, scorer="lexicon")
    labels = {r.bert_sentiment for r in spark.read.parquet(p2.tables["scored"]).select("bert_sentiment").distinct().collect()}
    assert labels <= {"positive", "negative", "neutral"}


def test_stream_problem_counts_equal_batch(spark, sf_small):
    src = tempfile.mkdtemp(prefix="ri-stream-src-")
    raw = review_fixture(spark, sf_small)
    raw.repartition(3).write.mode("overwrite").parquet(src)
    stream = streaming.read_review_stream(spark, src, max_files_per_trigger=1)
    counts = streaming.problem_counts(streaming.classify_stream(stream), window="3650 days", watermark="3650 days")
    ckpt = tempfile.mkdtemp(prefix="ri-stream-ckpt-")
    q = streaming.start(counts, ckpt, query_name="ri_problem_counts", output_mode="complete")
    q.awaitTermination(300)
    got = (spark.table("ri_problem_counts").groupBy("problem_category").agg(F.sum("count").alias("n"))
           .collect())
    batch = patterns.problem_analysis(frames.scored(spark, sf_small).where(F.col("review_date").isNotNull()))
    assert {r.problem_category: r.n for r in got} == {r.problem_type: r["count"] for r in batch.collect()}
