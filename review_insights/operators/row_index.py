"""Global 0-based row index, without a single-task window.

Rows read from files keep their place: ``with_file_position`` takes the file and
the row number from the scan itself, and a table of one row per file yields
each file's starting offset.  Nothing is sorted, shuffled or checkpointed, and
the text columns are not touched.

Where an order by columns is wanted instead, the frame is range-partitioned and
sorted by the key, each row gets ``monotonically_increasing_id()`` (partition
index in the high bits, position in the low 33 bits), and a per-partition count
table yields the offsets.  That sorted frame is checkpointed to the shared
checkpoint folder so the partition layout the offsets were computed on is the
one that is read back, even when tasks or executors are lost and recomputed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from review_insights.session import checkpoint_dir

_LOW_BITS = (1 << 33) - 1
_UNORDERABLE = (T.MapType, T.ArrayType, T.StructType, T.BinaryType)


FILE_COL, PLACE_COL = "_file_path", "_file_row"


def with_file_position(df: DataFrame) -> DataFrame:
    """Carry the file and the row number inside it along; ``df`` is a scan of Parquet files."""
    return df.select("*", F.col("_metadata.file_path").alias(FILE_COL), F.col("_metadata.row_index").alias(PLACE_COL))


def has_file_position(df: DataFrame) -> bool:
    return FILE_COL in df.columns and PLACE_COL in df.columns


def index_by_file(df: DataFrame, name: str = "row_index", total_name: str | None = None) -> DataFrame:
    """Add ``name`` = position of the row in the files, taken by name, and drop the carried columns."""
    files = df.groupBy(FILE_COL).agg((F.max(PLACE_COL) + 1).alias("_ri_rows"))
    # one row per file
    offsets = files.select(
        FILE_COL,
        (F.sum("_ri_rows").over(Window.orderBy(FILE_COL)) - F.col("_ri_rows")).alias("_ri_offset"),
        F.sum("_ri_rows").over(Window.partitionBy()).alias("_ri_total"))
    out = df.join(offsets, FILE_COL).withColumn(name, F.col("_ri_offset") + F.col(PLACE_COL))
    if total_name:
        out = out.withColumn(total_name, F.col("_ri_total"))
    return out.drop(FILE_COL, PLACE_COL, "_ri_offset", "_ri_total")


def _tie_breakers(df: DataFrame, order_by: list[str]) -> list[str]:
    """The other sortable columns, appended to the sort key.

    Range partitioning cannot split rows with equal keys, so a key value held
    by a large share of the rows would land in one task.  With the remaining
    columns as tie-breakers those rows spread over partitions, and the order is
    still deterministic (only fully identical rows remain tied, and their
    positions are interchangeable).
    """
    return [f.name for f in df.schema.fields
            if f.name not in order_by and not isinstance(f.dataType, _UNORDERABLE)]


def with_row_index(df: DataFrame, order_by: list[str], name: str = "row_index",
                   total_name: str | None = None) -> DataFrame:
    """Add ``name`` = position of the row in ``order_by`` order (0-based).

    When ``total_name`` is given, the total row count is added as well (the
    date spread needs it), taken from the same per-partition count table.
    """
    checkpoint_dir(df.sparkSession)
    sorted_df = (df.orderBy(*order_by, *_tie_breakers(df, order_by))
                 .withColumn("_ri_mid", F.monotonically_increasing_id())
                 .checkpoint(eager=True))
    parts = (sorted_df.select(F.shiftright("_ri_mid", 33).alias("_ri_part"))
             .groupBy("_ri_part").agg(F.count(F.lit(1)).alias("_ri_n")))
    # one row per partition: a window over it is cheap and bounded
    offsets = parts.select(
        "_ri_part",
        (F.sum("_ri_n").over(Window.orderBy("_ri_part")) - F.col("_ri_n")).alias("_ri_offset"),
        F.sum("_ri_n").over(Window.partitionBy()).alias("_ri_total"),
    )
    out = sorted_df.join(F.broadcast(offsets),
                         F.shiftright(sorted_df["_ri_mid"], 33) == offsets["_ri_part"])
    out = out.withColumn(name, F.col("_ri_offset") + F.col("_ri_mid").bitwiseAND(F.lit(_LOW_BITS)))
    if total_name:
        out = out.withColumn(total_name, F.col("_ri_total"))
    return out.drop("_ri_mid", "_ri_part", "_ri_offset", "_ri_total")
