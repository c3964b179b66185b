"""Joins against small dimension frames with a checked size bound.

A dimension (category statistics, label grids, templates) is broadcast only
after a size check: at most ``max_rows + 1`` rows are fetched; if the frame is
within the bound it becomes a local relation and is broadcast, otherwise the
join falls back to a shuffle join, where AQE's skew-join handling splits hot
keys.  The probe is bounded by the limit, so nothing unbounded reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from review_insights.session import spark_context

DEFAULT_MAX_DIM_ROWS = 100_000


def rows_once(df: DataFrame) -> DataFrame:
    """The rows of a small closed set (problem types, label pairs) as one array row.

    A frame that is referenced several times in one query would be computed once
    per reference, with different columns pruned each time.  Gathered into one
    row, all references need the same columns below the gathering, so the planner
    shares a single exchange and the big table is read once.  Lazy; only for
    frames whose size the operator's own rules bound.
    """
    return df.agg(F.collect_list(F.struct(*[F.col(c) for c in df.columns])).alias("rows")).select(F.inline("rows"))


def bounded_local(dim: DataFrame, max_rows: int = DEFAULT_MAX_DIM_ROWS) -> DataFrame | None:
    """The dimension as a local relation if it has at most ``max_rows`` rows, else None."""
    rows = dim.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return None
    return dim.sparkSession.createDataFrame(rows, dim.schema)


def join_dimension(big: DataFrame, dim: DataFrame, on, how: str = "inner",
                   max_rows: int = DEFAULT_MAX_DIM_ROWS) -> DataFrame:
    """Join ``big`` to ``dim``: broadcast when the size check passes, shuffle otherwise."""
    local = bounded_local(dim, max_rows)
    if local is None:
        return big.join(dim, on, how)
    return big.join(F.broadcast(local), on, how)


#: Bytes of input for each core up to which a scan is dealt out again.
SPREAD_BYTES = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small input over all cores.

    A file of one row group is one task, however many cores there are.  Below
    ``SPREAD_BYTES`` for each core (by the size Spark estimates, no job) the rows are
    dealt out; a larger input has tasks enough and is never shuffled.  Sessions without
    a SparkContext know neither and keep the input as it is.
    """
    if spark_context(df.sparkSession) is None:
        return df
    cores = int(df.sparkSession._jsparkSession.sparkContext().defaultParallelism())
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPREAD_BYTES else df
