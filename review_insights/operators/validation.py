"""Prediction validation against rating-derived labels (V1..V5).

Everything is computed from one ``groupBy(true, pred)`` over the valid rows: a
table of at most (labels x labels) counts.  Each report refers to that table
once (the counts are gathered into one row and unfolded from there), so the
big table is scanned once and building a report starts no job.  The label set
must be closed: ``check_labels`` raises on more than ``MAX_LABELS`` values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# More distinct labels than this mean that the column holds no labels.
MAX_LABELS = 100

TRUE_COL, PRED_COL = "sentiment_label", "bert_sentiment"


def valid_pairs(df: DataFrame, true_col: str = TRUE_COL, pred_col: str = PRED_COL) -> DataFrame:
    """Rows that carry both labels, as ``(true_label, pred_label)``.  A missing
    label column yields an empty result rather than an error."""
    if true_col not in df.columns or pred_col not in df.columns:
        return df.sparkSession.createDataFrame([], "true_label string, pred_label string")
    return (df.where(F.col(true_col).isNotNull() & F.col(pred_col).isNotNull())
            .select(F.col(true_col).alias("true_label"), F.col(pred_col).alias("pred_label")))


def pair_counts(pairs: DataFrame) -> DataFrame:
    """``(true_label, pred_label, count)``; pairs that carry counts are taken as counted."""
    if "count" in pairs.columns:
        return pairs.groupBy("true_label", "pred_label").agg(F.sum("count").alias("count"))
    return pairs.groupBy("true_label", "pred_label").agg(F.count(F.lit(1)).alias("count"))


def accuracy(pairs: DataFrame) -> DataFrame:
    """Accuracy (4 dp) and the number of compared rows."""
    return pairs.agg(F.round(F.avg((F.col("true_label") == F.col("pred_label")).cast("int")), 4).alias("accuracy"),
                     F.count(F.lit(1)).alias("total_samples"))


def _gathered(pairs: DataFrame) -> DataFrame:
    """One row: the sorted label set and the count of every pair, as a map."""
    row = pair_counts(pairs).agg(
        F.array_sort(F.array_distinct(F.concat(F.collect_set("true_label"), F.collect_set("pred_label")))).alias("labels"),
        F.map_from_entries(F.collect_list(F.struct(F.struct("true_label", "pred_label"), "count"))).alias("counts"))
    closed = F.when(F.size("labels") <= MAX_LABELS, F.col("labels")).otherwise(
        F.raise_error(F.lit(f"more than {MAX_LABELS} labels")).cast("array<string>"))
    return row.select(closed.alias("labels"), "counts")


def confusion_matrix(pairs: DataFrame) -> DataFrame:
    """Counts for every (true, predicted) pair over the sorted union of labels seen
    in either column; absent pairs are 0."""
    grid = (_gathered(pairs).select(F.explode("labels").alias("true_label"), "labels", "counts")
            .select("true_label", F.explode("labels").alias("pred_label"), "counts"))
    n = F.element_at("counts", F.struct("true_label", "pred_label"))
    return grid.select("true_label", "pred_label", F.coalesce(n, F.lit(0)).cast("bigint").alias("count"))


def classification_report(pairs: DataFrame) -> DataFrame:
    """Per-class precision / recall / F1 / support plus the accuracy, macro and
    weighted-average rows; undefined ratios are 0.  The accuracy row carries the
    accuracy in ``f1_score`` and the total in ``support``."""
    cm = confusion_matrix(pairs)
    zero = F.lit(0).cast("bigint")
    hit = F.when(F.col("true_label") == F.col("pred_label"), F.col("count")).otherwise(zero)
    sides = F.array(
        F.struct(F.col("true_label").alias("label"), F.col("count").alias("support"), hit.alias("tp"), zero.alias("predicted")),
        F.struct(F.col("pred_label").alias("label"), zero.alias("support"), zero.alias("tp"), F.col("count").alias("predicted")))
    per = cm.select(F.inline(sides)).groupBy("label").agg(
        F.sum("support").alias("support"), F.sum("tp").alias("tp"), F.sum("predicted").alias("predicted"))

    def ratio(n, d):
        return F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0))

    per = per.select(
        "label",
        ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1_score"),
        F.col("support").cast("bigint").alias("support"),
        F.col("tp"))
    total = F.sum("support")
    summary = per.agg(
        F.collect_list(F.struct("label", "precision", "recall", "f1_score", "support")).alias("classes"),
        total.alias("total"), F.sum("tp").alias("tp_total"),
        F.avg("precision").alias("p_macro"), F.avg("recall").alias("r_macro"), F.avg("f1_score").alias("f_macro"),
        (F.sum(F.col("precision") * F.col("support")) / total).alias("p_w"),
        (F.sum(F.col("recall") * F.col("support")) / total).alias("r_w"),
        (F.sum(F.col("f1_score") * F.col("support")) / total).alias("f_w"))
    def row(label, p, r, f):
        return F.struct(F.lit(label).alias("label"), p.cast("double").alias("precision"),
                        r.cast("double").alias("recall"), f.cast("double").alias("f1_score"),
                        F.col("total").cast("bigint").alias("support"))

    none = F.lit(None)
    totals = F.array(
        row("accuracy", none, none, F.try_divide(F.col("tp_total"), F.col("total"))),
        row("macro avg", F.col("p_macro"), F.col("r_macro"), F.col("f_macro")),
        row("weighted avg", F.col("p_w"), F.col("r_w"), F.col("f_w")))
    return summary.select(F.inline(F.concat("classes", totals)))


def label_distributions(pairs: DataFrame) -> DataFrame:
    """True and predicted label counts as ``(side, label, count)``."""
    sides = F.array(F.struct(F.lit("true").alias("side"), F.col("true_label").alias("label"), "count"),
                    F.struct(F.lit("pred").alias("side"), F.col("pred_label").alias("label"), "count"))
    return (pair_counts(pairs).select(F.inline(sides))
            .groupBy("side", "label").agg(F.sum("count").cast("bigint").alias("count")))
