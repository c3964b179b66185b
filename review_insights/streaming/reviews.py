"""Structured Streaming over arriving review files.

The conform, preprocess and classify stages are row-wise, so they apply to a
``readStream`` frame unchanged.  Two things need batch context and are handled
explicitly: category statistics come from a static frame (stream-static
broadcast join, the frame is bounded by the number of categories), and
missing id/date columns cannot be filled from a global row position (a stream
has no global order), so such sources are rejected.

``problem_counts`` is the stateful part: negatives per event-time window and
problem type, with a watermark so that old windows are finalised and their
state dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from review_insights import constants as K
from review_insights.operators import conform, preprocess, problems

RAW_REVIEW_SCHEMA = T.StructType([
    T.StructField("Id", T.StringType()),
    T.StructField("ProductId", T.StringType()),
    T.StructField("UserId", T.StringType()),
    T.StructField("Score", T.StringType()),
    T.StructField("Summary", T.StringType()),
    T.StructField("Text", T.StringType()),
    T.StructField("Time", T.LongType()),
    T.StructField("bert_sentiment", T.StringType()),
    T.StructField("bert_confidence", T.DoubleType()),
])


def read_review_stream(spark: SparkSession, path: str, schema: T.StructType = RAW_REVIEW_SCHEMA,
                       fmt: str = "parquet", max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream of raw review files (Parquet, or CSV with the same quoting rules)."""
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    from review_insights.sources.readers import normalise_missing
    return normalise_missing(reader.load(path))


def classify_stream(raw: DataFrame, category_stats: DataFrame | None = None) -> DataFrame:
    """Conform, preprocess and classify a streaming frame row by row."""
    renamed = conform.rename_columns(raw)
    missing = [c for c in ("product_id", "review_date") if c not in renamed.columns]
    if missing:
        raise ValueError(f"streaming sources must carry {missing}: positions cannot be assigned in a stream")
    reviews = conform.conform_reviews(raw)
    processed = preprocess.preprocess(reviews, with_category_stats=False)
    if category_stats is not None:
        processed = processed.join(category_stats, "product_category", "inner")
    return problems.classify_problems(processed)


def problem_counts(classified: DataFrame, window: str = "30 days", watermark: str = "60 days") -> DataFrame:
    """Negative reviews per (event-time window, problem type): count, mean rating
    and mean confidence.  The watermark bounds the state kept for late rows."""
    neg = classified.where(F.col("bert_sentiment") == K.NEGATIVE).where(F.col("review_date").isNotNull())
    return (neg.withWatermark("review_date", watermark)
            .groupBy(F.window("review_date", window).alias("window"), "problem_category")
            .agg(F.count(F.lit(1)).alias("count"), F.avg("rating").alias("avg_rating"),
                 F.avg("bert_confidence").alias("avg_confidence")))


def start(frame: DataFrame, checkpoint_location: str, sink_path: str | None = None, query_name: str | None = None,
          output_mode: str = "append", available_now: bool = True) -> StreamingQuery:
    """Start a query writing Parquet files (or an in-process memory table when no
    path is given, for inspection in tests).  The checkpoint location must be on
    shared storage so a restarted driver resumes where it stopped."""
    writer = frame.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer
    if sink_path:
        return writer.format("parquet").option("path", sink_path).start()
    return writer.format("memory").queryName(query_name or "review_stream").start()
