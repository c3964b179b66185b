"""Connected components of a distributed edge table, by alternating large-star
and small-star steps; each round is written to the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from review_insights.llm.common import saved


def _round(edges: DataFrame) -> DataFrame:
    """Large star, then small star.  ``edges`` hold ``a > b``."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.join(least, "a").where("b > a AND b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a").select(F.explode(F.array(
        F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
    return small.where("a != b").distinct()


def _is_forest(edges: DataFrame) -> bool:
    """Whether every node has one parent and no parent has a parent."""
    parents = edges.select(F.col("b").alias("a")).distinct().withColumn("up", F.lit(1))
    seen = edges.groupBy("a").agg(F.count(F.lit(1)).alias("up")).unionByName(parents)
    return seen.groupBy("a").agg(F.sum("up").alias("n")).where("n > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node that is not the least of its component;
    all others are their own.  ``edges``: a written table of ``(a, b)``."""
    now = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    while not _is_forest(now):
        now = saved(_round(now), "stars", narrow=True)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
