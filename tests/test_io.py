"""Sources and sinks: CSV quirks, missing files, projections, report text."""

import os
import tempfile

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from review_insights.sources import readers, sinks


def _tmp():
    return tempfile.mkdtemp(prefix="ri-io-")


def test_csv_quoted_newlines_doubled_quotes_and_na_tokens(spark):
    path = os.path.join(_tmp(), "raw.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write('Id,Score,Text\n1,5,"line one\nline ""two"""\n2,NA,None\n3,n/a,plain\n')
    rows = readers.read_reviews(spark, path).orderBy("Id").collect()
    assert [r.Id for r in rows] == ["1", "2", "3"]
    assert rows[0].Text == 'line one\nline "two"'
    assert rows[1].Score is None and rows[1].Text is None and rows[2].Score is None


def test_missing_file_raises(spark):
    with pytest.raises(AnalysisException):
        readers.read_reviews(spark, "/nonexistent/reviews.csv").collect()


def test_write_table_counts_rows_and_round_trips(spark):
    df = spark.range(123).select(F.col("id").cast("string").alias("review_id"))
    out = os.path.join(_tmp(), "t")
    assert sinks.write_table(df, out) == 123
    assert spark.read.parquet(out).count() == 123
    csv_out = os.path.join(_tmp(), "c")
    assert sinks.write_table(df, csv_out, fmt="csv") == 123


def test_available_column_projection_and_required_check(spark):
    df = spark.createDataFrame([("B1", 5, "x")], "product_id string, rating int, review_text string")
    assert sinks.scored_export(df).columns == ["product_id", "rating", "review_text"]
    with pytest.raises(ValueError, match="bert_sentiment"):
        sinks.require_columns(df, ["rating", "bert_sentiment"])


def test_suggestion_export_first_action_or_empty(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "priority_rank int, suggestions array<string>")
    got = [r.top_suggestion for r in sinks.suggestion_export(df).orderBy("priority_rank").collect()]
    assert got == ["a", ""]


def test_write_report_orders_lines(spark):
    lines = spark.createDataFrame([(2, 0, "second"), (1, 1, "b"), (1, 0, "a")], "section int, ord int, text string")
    out = os.path.join(_tmp(), "r")
    sinks.write_report(lines, out)
    texts = [r.value for r in spark.read.text(out).collect()]
    assert texts == ["a", "b", "second"]


def test_csv_sink_keeps_whitespace_quotes_and_newlines(spark):
    df = spark.createDataFrame([("1", '  padded "quoted"\nnext line ')], "Id string, Text string")
    out = os.path.join(_tmp(), "ws")
    assert sinks.write_table(df, out, fmt="csv") == 1
    back = readers.read_reviews_csv(spark, out).collect()
    assert back[0].Text == '  padded "quoted"\nnext line '


def test_checkpoint_folder_comes_from_the_session(spark):
    from review_insights.session import checkpoint_dir, table_path

    configured = spark.sparkContext.getCheckpointDir()
    assert checkpoint_dir(spark) == configured
    assert table_path(spark, "x").startswith(configured)


def test_intermediate_tables_can_be_dropped(spark, tmp_path, monkeypatch):
    import os

    from review_insights import session

    monkeypatch.setattr(session, "checkpoint_dir", lambda _: str(tmp_path))
    spark.range(3).write.parquet(session.table_path(spark, "one"))
    (tmp_path / "other").mkdir()
    session.drop_intermediate(spark)
    assert os.listdir(tmp_path) == ["other"]
