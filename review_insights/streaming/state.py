"""Metrics kept up to date batch by batch.

Every micro-batch of scored reviews is reduced once, where it arrives, to a small
cube: rows by rule label, model label, problem and rating, with their number and
the sum and number of confidences.  Counts, means, the problem mix (N3), the
benchmark (T1) and the classification report (V3) of all reviews so far are sums
over the cubes, so new reviews never make old ones be read again.  Beside the cube a
batch stores mergeable sketches: distinct products and reviewers (HLL) and quantiles
of the review length (KLL).

Storage: ``<path>/data/<unique name>`` per batch and ``<path>/batches/<id>.json``,
renamed into place.  A batch that is replayed finds its manifest and changes
nothing; one that failed half-way left no manifest and is stored again.
:func:`fold` folds the batches into one table (``<path>/bases/<n>.json`` names the
batches inside); readers take the last base and the batches it does not name, so a
reader, or a crash, between its steps sees every batch exactly once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from review_insights import constants as K
from review_insights.operators import validation
from review_insights.sources.versions import _Files

KEYS = ("sentiment_label", "bert_sentiment", "problem_category", "rating")
#: Columns of the scored reviews that the metrics need.
STORED_COLUMNS = (*KEYS, "bert_confidence", "product_id", "user_id", "review_length")
#: Accuracy of the sketches: 2^LOG_K registers give about 1.04 / sqrt(2^LOG_K) relative error; KLL's rank error is about 2.6 / K^0.96.
HLL_LOG_K, KLL_K = 14, 400


def cube(scored: DataFrame) -> DataFrame:
    """One partial aggregate over few keys: ratings are a handful of values, labels and problems closed sets."""
    return scored.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.sum("bert_confidence").alias("confidence_sum"),
                                     F.count("bert_confidence").alias("confidence_n"))


def sketches(scored: DataFrame) -> DataFrame:
    """One row of sketches, merged partially in every task."""
    return scored.agg(F.count(F.lit(1)).alias("rows"), F.hll_sketch_agg("product_id", F.lit(HLL_LOG_K)).alias("products"),
                      F.hll_sketch_agg("user_id", F.lit(HLL_LOG_K)).alias("users"),
                      F.kll_sketch_agg_double(F.col("review_length").cast("double"), F.lit(KLL_K)).alias("lengths"))


def _manifests(files: _Files, folder: str) -> list[dict]:
    return [json.loads(files.read(f"{folder}/{name}")) for name in files.names(folder) if name.endswith(".json") and not name.startswith(".")]


def _write(path: str, frames: dict[str, DataFrame | Callable[[str], DataFrame]]) -> str:
    """Write the frames in their order; one that is made from those before is a function of their location."""
    location = f"{path.rstrip('/')}/data/{uuid.uuid4().hex}"
    for name, frame in frames.items():
        (frame(location) if callable(frame) else frame).write.parquet(f"{location}/{name}")
    return location


def store_frames(spark: SparkSession, path: str, batch_id: int, frames: Callable[[], dict[str, DataFrame | Callable[[str], DataFrame]]]) -> bool:
    """Store the frames of one batch; False if the batch is stored already."""
    files = _Files(spark, path)
    name = f"{path.rstrip('/')}/batches/{batch_id:012d}.json"
    if f"{batch_id:012d}.json" in files.names(f"{path.rstrip('/')}/batches") or any(
            batch_id in m["batches"] for m in _manifests(files, f"{path.rstrip('/')}/bases")):
        return False
    location = _write(path, frames())
    return files.create_whole(name, json.dumps({"batch": batch_id, "data": location}))


def store_batch(scored: DataFrame, path: str, batch_id: int) -> bool:
    """Store the metrics of one batch; False if the batch is stored already."""
    # a cube has a few thousand rows at most
    return store_frames(scored.sparkSession, path, batch_id, lambda: {"cube": cube(scored).coalesce(1), "sketches": sketches(scored)})


def _parts(spark: SparkSession, path: str) -> tuple[list[str], list[int]]:
    """Locations that hold every stored batch once, and the ids of the batches."""
    files = _Files(spark, path)
    # batches first: what is folded away in between is in the base that is read after
    batches = _manifests(files, f"{path.rstrip('/')}/batches")
    bases = _manifests(files, f"{path.rstrip('/')}/bases")
    base = max(bases, key=lambda m: m["base"], default={"batches": [], "data": None})
    left = [m for m in batches if m["batch"] not in set(base["batches"])]
    return ([base["data"]] if base["data"] else []) + [m["data"] for m in left], sorted(base["batches"] + [m["batch"] for m in left])


def stored_batches(spark: SparkSession, path: str) -> list[int]:
    return _parts(spark, path)[1]


def read_frames(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One of the frames of all batches."""
    found = _parts(spark, path)[0]
    if not found:
        raise FileNotFoundError(f"no batch stored in {path}")
    return spark.read.parquet(*[f"{x}/{name}" for x in found])


def merged_cube(spark: SparkSession, path: str) -> DataFrame:
    """The cube of all batches."""
    return read_frames(spark, path, "cube").groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in ("n", "confidence_sum", "confidence_n")])


def merged_sketches(spark: SparkSession, path: str) -> DataFrame:
    return read_frames(spark, path, "sketches").agg(
        F.sum("rows").alias("rows"), F.hll_union_agg("products").alias("products"), F.hll_union_agg("users").alias("users"),
        F.kll_merge_agg_double("lengths").alias("lengths"))


def fold(spark: SparkSession, path: str, merged: Callable[[], dict[str, DataFrame]]) -> int:
    """Replace all stored batches by one base of the ``merged`` frames; the number of batches folded."""
    files, ids = _Files(spark, path), stored_batches(spark, path)
    if not ids:
        return 0
    before = _manifests(files, f"{path.rstrip('/')}/bases")
    location = _write(path, merged())
    number = 1 + max((m["base"] for m in before), default=0)
    if not files.create_whole(f"{path.rstrip('/')}/bases/{number:08d}.json", json.dumps({"base": number, "batches": ids, "data": location})):
        return 0  # another one was faster
    for batch in ids:
        files.drop(f"{path.rstrip('/')}/batches/{batch:012d}.json")
    return len(ids)


def compact(spark: SparkSession, path: str) -> int:
    """Fold the stored metrics into one cube and one row of sketches."""
    return fold(spark, path, lambda: {"cube": merged_cube(spark, path).coalesce(1), "sketches": merged_sketches(spark, path)})


# ------------------------------------------------------- metrics from the cube --

def problem_analysis(cubes: DataFrame) -> DataFrame:
    """As ``patterns.problem_analysis`` over all rows: the total is a window over the seven groups."""
    rated = F.when(F.col("rating").isNotNull(), F.col("n"))
    per = (cubes.where(F.col("bert_sentiment") == K.NEGATIVE).groupBy("problem_category")
           .agg(F.sum("n").alias("count"), (F.sum(F.col("rating") * F.col("n")) / F.sum(rated)).alias("avg_rating"),
                (F.sum("confidence_sum") / F.sum("confidence_n")).alias("avg_confidence")))
    per = per.withColumn("percentage", F.col("count") / F.sum("count").over(Window.partitionBy()) * 100)
    return per.where(F.col("problem_category") != K.PROBLEM_NONE).withColumnRenamed("problem_category", "problem_type")


def classification_report(cubes: DataFrame) -> DataFrame:
    """As ``validation.classification_report``, from the stored pair counts."""
    pairs = cubes.where(F.col("sentiment_label").isNotNull() & F.col("bert_sentiment").isNotNull()).groupBy(
        F.col("sentiment_label").alias("true_label"), F.col("bert_sentiment").alias("pred_label")).agg(F.sum("n").alias("count"))
    return validation.classification_report(pairs)


def benchmark_metrics(cubes: DataFrame) -> DataFrame:
    """As ``benchmark.benchmark_metrics``: the percentiles are exact, weighted by the number of each rating."""
    def rows(cond):
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))

    rated = F.col("rating").isNotNull()
    total, five = F.sum("n"), rows(F.col("rating") == 5)
    of = cubes.groupBy("rating").agg(F.sum("n").alias("n")).where(rated)
    quartiles = of.agg(F.percentile("rating", F.array(F.lit(0.25), F.lit(0.75)), F.col("n")).alias("q")).scalar()
    out = cubes.agg(
        total.alias("total_reviews"), rows(F.col("bert_sentiment") == K.NEGATIVE).alias("negative_count"),
        (F.sum(F.col("rating") * F.col("n")) / rows(rated)).alias("average_rating"),
        (rows(F.col("bert_sentiment") == K.NEGATIVE) / total).alias("negative_sentiment_rate"),
        (rows(F.col("bert_sentiment") == K.POSITIVE) / total).alias("positive_rate"),
        (five / rows(rated)).alias("five_star_share"), (five / total).alias("five_star_rate"))
    return out.select("*", quartiles[0].alias("bottom_quartile_rating"), quartiles[1].alias("top_quartile_rating"))


def sketch_summary(sketched: DataFrame) -> DataFrame:
    """Estimates ``(metric, estimate)``: distinct products and reviewers, median review length."""
    return sketched.select(F.explode(F.array(
        F.struct(F.lit("unique_products").alias("metric"), F.hll_sketch_estimate("products").cast("double").alias("estimate")),
        F.struct(F.lit("unique_users").alias("metric"), F.hll_sketch_estimate("users").cast("double").alias("estimate")),
        F.struct(F.lit("median_review_length").alias("metric"),
                 F.kll_sketch_get_quantile_double("lengths", F.lit(0.5)).alias("estimate")))).alias("s")).select("s.*")


def start_metrics(scored_stream: DataFrame, path: str, checkpoint_location: str, available_now: bool = True) -> StreamingQuery:
    """Keep the state at ``path`` up to date with a stream of scored reviews (as from ``classify_stream``)."""
    def keep(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            store_batch(batch, path, batch_id)
        finally:
            batch.unpersist()

    # a batch reaches ``keep`` as computed rows: columns that are not needed are left out of the stream, not of the batch
    needed = scored_stream.select(*STORED_COLUMNS)
    writer = needed.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint_location)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
