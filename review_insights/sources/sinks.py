"""Sinks: table writes, available-column projections and report text files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from review_insights import constants as K

# CSV as the original tools write it: header row, doubled quotes inside quoted
# fields, and values written verbatim (Spark's writer trims leading and trailing
# whitespace unless told not to).
CSV_WRITE_OPTIONS = {
    "header": "true",
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def require_columns(df: DataFrame, required: Iterable[str]) -> None:
    """Fail early (at analysis time, no job) when required columns are absent."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def select_available(df: DataFrame, wanted: Iterable[str]) -> DataFrame:
    """Project the wanted columns that exist, in the wanted order."""
    return df.select(*[c for c in wanted if c in df.columns])


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> int:
    """Write a table and return its row count, counted during the write itself."""
    obs = Observation("rows_written")
    observed = df.observe(obs, F.count(F.lit(1)).alias("rows"))
    writer = observed.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.options(**CSV_WRITE_OPTIONS)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return int(obs.get.get("rows", 0))


def scored_export(df: DataFrame) -> DataFrame:
    """The scored-review result file: the eight result columns that are present."""
    return select_available(df, K.SCORED_EXPORT_COLUMNS)


def suggestion_export(suggestions: DataFrame) -> DataFrame:
    """Flatten suggestion records to the 11 export columns; first action or ''."""
    flat = suggestions.withColumn(
        "top_suggestion", F.coalesce(F.try_element_at("suggestions", F.lit(1)), F.lit("")))
    return select_available(flat, K.SUGGESTION_EXPORT_COLUMNS)


def write_report(lines: DataFrame, path: str) -> None:
    """Write report lines ``(section, ord, text)`` as one ordered text file.

    Report frames are bounded by construction (tens of lines), so a single
    output partition is safe here.
    """
    (lines.orderBy("section", "ord").select("text")
     .coalesce(1).write.mode("overwrite").text(path))
