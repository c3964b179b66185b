"""End-to-end phase plans: collect -> analyze -> improve, with their file outputs.

Each phase ends in tables written once (Parquet, or CSV where the original hands
CSV files between phases); the next phase scans them.  Writing cuts the lineage, so
a lost executor only recomputes work since the last table, and the expensive
scoring step never reruns for downstream queries.  Every output is a version of a
table (:mod:`review_insights.sources.versions`): it appears when it is complete, and
a phase that fails leaves readers the version before.  Tables go under the shared
folder named by ``spark.checkpoint.dir`` unless an output directory is given.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from review_insights import constants as K
from review_insights.operators import (benchmark, charts, conform, gate, keywords, patterns, preprocess, priority, problems,
                                       reports, roi, scoring, summary, validation)
from review_insights.operators.dims import rows_once
from review_insights.session import table_path
from review_insights.sources import sinks, versions


@dataclass
class PhaseOutput:
    """Files written by a phase, the version each one is, and the row counts observed while writing."""
    tables: dict[str, str] = field(default_factory=dict)
    rows: dict[str, int] = field(default_factory=dict)
    versions: dict[str, int] = field(default_factory=dict)
    checks: list[gate.CheckResult] = field(default_factory=list)


def _out(spark: SparkSession, out_dir: str | None, name: str) -> str:
    return os.path.join(out_dir, name) if out_dir else table_path(spark, name)


def _publish(out: PhaseOutput, out_dir: str | None, name: str, frame: DataFrame, fmt: str = "parquet", stored_as: str | None = None,
             check: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Publish ``frame`` as the next version of the output and read it back."""
    spark = frame.sparkSession
    v = versions.publish(frame, _out(spark, out_dir, stored_as or name), check, fmt)
    out.tables[name], out.rows[name], out.versions[name] = v.location, v.rows, v.number
    return spark.read.format(fmt).load(v.location)


def _publish_text(out: PhaseOutput, out_dir: str | None, name: str, lines: DataFrame) -> None:
    """Publish report lines as one ordered text file."""
    def write(frame: DataFrame, location: str) -> int:
        sinks.write_report(frame, location)
        return spark.read.text(location).count()

    spark = lines.sparkSession
    v = versions.publish(lines, _out(spark, out_dir, f"{name}_txt"), fmt="text", write=write)
    out.tables[name], out.rows[name], out.versions[name] = v.location, v.rows, v.number


def collect_phase(spark: SparkSession, raw: DataFrame, out_dir: str | None = None, metadata_mode: str = "keep",
                  stop_on: Iterable[str] = ()) -> PhaseOutput:
    """Phase 1: conform and preprocess raw reviews; write raw and processed tables,
    the quality checks and the summary.

    The checks are observed while the processed table is written.  Those named in
    ``stop_on`` (``missing``, ``short``, ``imbalance``) raise :class:`versions.GateError`
    when they fail: the checks are published, the processed table is not.
    """
    out = PhaseOutput()
    conformed = _publish(out, out_dir, "raw", conform.conform_reviews(raw, metadata_mode=metadata_mode), stored_as="raw_reviews")
    rows_in, quality = Observation("preprocess"), Observation("quality")
    processed = preprocess.preprocess(conformed, observation=rows_in)

    def passes(_table: DataFrame, _rows: int) -> None:
        out.checks = gate.results(processed.columns, quality.get)
        _publish(out, out_dir, "quality_checks", gate.as_frame(spark, out.checks))
        stopped = gate.stopping(out.checks, stop_on)
        if stopped:
            raise versions.GateError(f"processed_data was not published: {[(r.check, r.item, r.value) for r in stopped]}")

    gate.stopping([], stop_on)
    written = _publish(out, out_dir, "processed", gate.observe_checks(processed, quality), stored_as="processed_data", check=passes)
    out.rows["dropped"] = int(rows_in.get.get("rows_in", 0)) - out.rows["processed"]
    _publish(out, out_dir, "data_summary", summary.data_summary(written))
    return out


def analyze_phase(spark: SparkSession, processed_path: str, out_dir: str | None = None,
                  scorer: str = "lexicon", model_path: str | None = None) -> PhaseOutput:
    """Phase 2: score sentiment, classify problems, write the scored table and the
    result export; keyword, validation and report tables are written alongside.

    ``scorer``: ``lexicon`` (Catalyst), ``batch`` (``mapInPandas`` harness with
    the default batch model), ``mllib`` (the saved pipeline at ``model_path``; without
    one, a logistic regression is trained on the rating-derived labels and published
    first) or ``given`` (keep existing model columns).
    """
    out = PhaseOutput()
    df = spark.read.parquet(processed_path)
    if scorer == "lexicon":
        scored = scoring.score_lexicon(df)
    elif scorer == "batch":
        scored = scoring.score_sentiment(df)
    elif scorer == "mllib":
        if model_path is None:
            model_path = _out(spark, out_dir, "sentiment_model")
            out.versions["sentiment_model"] = scoring.publish_model(scoring.train_sentiment_model(df), model_path).number
        scored = scoring.score_with_model(scoring.load_model(spark, model_path), df)
    elif scorer == "given":
        scored = df
    else:
        raise ValueError(f"unknown scorer {scorer!r}")
    s = _publish(out, out_dir, "scored", problems.classify_problems(scored), stored_as="scored_reviews")
    _publish(out, out_dir, "results_csv", sinks.scored_export(s), "csv", stored_as="sentiment_analysis_results_csv")
    if scoring.ERROR_COL in s.columns:
        # rows whose scorer failed and that carry the fallback label
        out.rows["score_errors"] = s.where(F.col(scoring.ERROR_COL)).count()
    terms = _publish(out, out_dir, "keywords", keywords.extract_keywords(s))
    _publish(out, out_dir, "classification_report", validation.classification_report(validation.valid_pairs(s)))
    report = _publish(out, out_dir, "scoring_report", reports.scoring_report(s, with_accuracy=True, keywords=terms))
    _publish_text(out, out_dir, "scoring_report_text", reports.scoring_report_lines(report))
    _publish_text(out, out_dir, "dashboard_summary", reports.dashboard_summary_lines(s))
    for name, frame in {
        "chart_label_comparison": charts.label_comparison(s),
        "chart_confidence_histogram": charts.confidence_histogram(s),
        "chart_problem_share": charts.problem_share(s),
        "chart_rating_sentiment": charts.rating_sentiment_crosstab(s),
        "chart_sentiment_counts": charts.sentiment_counts(s),
    }.items():
        _publish(out, out_dir, name, frame)
    return out


def improve_phase(spark: SparkSession, scored_path: str, out_dir: str | None = None) -> PhaseOutput:
    """Phase 3: negative patterns, priorities, suggestions, ROI, benchmark, chart inputs,
    roadmap, KPI targets, the closing list of three and the business report (text), from the scored table."""
    out = PhaseOutput()
    s = spark.read.parquet(scored_path)
    sinks.require_columns(s, K.PHASE3_REQUIRED_COLUMNS)
    # written once and read back: all later frames derive from this small table
    probs = _publish(out, out_dir, "problem_analysis", patterns.problem_analysis(s))
    metrics = rows_once(benchmark.benchmark_metrics(s))
    prio = priority.priority_scores(probs)
    sug = priority.improvement_suggestions(prio)
    rc = roi.roi_by_category(sug)
    position = benchmark.competitive_position(s, probs, prio, metrics)
    for name, frame in {
        "improvement_suggestions": sinks.suggestion_export(sug),
        "roi_by_category": rc,
        "roi_overall": roi.roi_overall(rc),
        "competitive_position": position,
        "roadmap": reports.roadmap(sug),
        "kpi_targets": reports.kpi_targets(s),
        "top3_summary": reports.top3_summary(sug, rc),
        "chart_priority_roi": charts.priority_roi_points(sug, rc),
        "chart_problem_names": charts.problem_display_counts(probs),
    }.items():
        _publish(out, out_dir, name, frame)
    _publish_text(out, out_dir, "business_report", reports.business_report_lines(metrics, sug, rc, roi.roi_overall(rc), position))
    return out
