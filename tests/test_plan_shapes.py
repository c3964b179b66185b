"""Physical-plan properties the design relies on (checked on the executed plans)."""

import pytest

from review_insights.plans import catalog
from tests_support import records_read

QUERIES = catalog.QUERIES
PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "PythonUDF")


def _plan(spark, name, sf_small):
    df = QUERIES[name](spark, sf_small)
    df.collect()
    # the final adaptive plan after execution
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["problem_analysis", "classify_problems", "preprocess", "keywords_tfidf",
                                  "data_summary", "classification_report", "competitive_position",
                                  "score_lexicon"])
def test_no_python_outside_scoring(spark, sf_small, name):
    plan = _plan(spark, name, sf_small)
    assert not any(node in plan for node in PYTHON_NODES), plan


def test_scoring_harness_is_arrow_batched(spark, sf_small):
    assert "MapInPandas" in _plan(spark, "score_batch_model", sf_small)


@pytest.mark.parametrize("name", ["preprocess", "keywords_tfidf", "priority_scores"])
def test_bounded_dimensions_are_broadcast(spark, sf_small, name):
    plan = _plan(spark, name, sf_small)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("name", ["problem_analysis", "summary_category", "keywords_tfidf", "chart_problem_share"])
def test_aggregates_are_partial_before_shuffle(spark, sf_small, name):
    plan = _plan(spark, name, sf_small)
    assert "partial_" in plan


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_or_nested_loop_joins(spark, sf_small, name):
    if name == "score_mllib":
        pytest.skip("iterative training job")
    plan = _plan(spark, name, sf_small)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_no_text_is_shuffled_by_the_keyword_query(spark, sf_small):
    """Documents are tokenised where they are read; one shuffle by document carries ids."""
    final = _plan(spark, "keywords_tfidf", sf_small).split("== Initial Plan ==")[0]
    assert final.count("Exchange hashpartitioning(doc_id") == 1, final
    assert final.count("regexp_extract_all") <= 2, final  # one tokeniser call in each of the two passes


@pytest.mark.parametrize("name,passes", [
    ("problem_analysis", 1), ("load_distributions", 1), ("scoring_report", 1), ("chart_label_comparison", 1),
    ("classification_report", 1), ("confusion_matrix", 1), ("label_distributions", 1), ("roi_dashboard", 1),
    ("chart_confidence_histogram", 1), ("null_audit", 2), ("data_summary", 2), ("competitive_position", 2),
    ("business_report", 2), ("keywords_tfidf", 3), ("report_top_keywords", 3), ("conform_missing_columns", 2),
])
def test_review_table_passes_are_bounded(spark, sf_small, name, passes):
    """Rows that tasks read from files, from Spark's event log, against the table's rows."""
    QUERIES["negative_count"](spark, sf_small).collect()  # the ingest is done before counting
    total = spark.read.parquet(f"{sf_small}/lineitem.parquet").count()
    read = records_read(spark, lambda: QUERIES[name](spark, sf_small).collect())
    assert read <= passes * total, (read, total)


BUILDS_NOTHING = sorted(set(QUERIES) - {
    # these write a table or fit a model while they are built, or check the size of a broadcast
    "table_write", "scored_export", "report_file", "score_mllib", "preprocess", "null_audit",
    "versioned_table", "quality_gate", "score_saved_model",
    # these find the n-th hash, or run a stream, while they are built
    "sample_reviews_large", "problem_analysis_incremental", "classification_report_incremental",
    "benchmark_metrics_incremental", "sketch_summary", "keywords_incremental",
    # CSV readers take the column names from the first line of a file
    "csv_scan", "csv_folder"})


@pytest.mark.parametrize("name", BUILDS_NOTHING)
def test_building_a_query_reads_nothing(spark, sf_small, name):
    QUERIES["negative_count"](spark, sf_small).collect()
    QUERIES["csv_scan"](spark, sf_small)
    assert records_read(spark, lambda: QUERIES[name](spark, sf_small)) == 0
