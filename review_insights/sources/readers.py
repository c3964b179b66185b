"""Review readers: CSV and Parquet scans with CSV-style missing-token handling."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from review_insights import constants as K


def normalise_missing(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Turn the CSV missing-value tokens (``'', 'NA', 'n/a', 'NULL', ...``) into nulls.

    Applied to string columns only; other columns are untouched.  Lower-case
    ``none`` is not a token and survives (it is a problem-category value).
    """
    string_cols = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    targets = [c for c in (columns or df.columns) if c in string_cols]
    tokens = list(K.NA_TOKENS)
    return df.withColumns({c: F.when(~F.col(c).isin(tokens), F.col(c)) for c in targets})


def read_reviews_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read review CSV files (a file, directory or glob) into string columns.

    Quoted fields may contain newlines and doubled quotes, so ``multiLine`` and
    ``escape='"'`` are always set.  Such files are not splittable: convert them
    to Parquet once (``write_table``) before heavy use.  No schema inference:
    every column is read as text and typed later by ``conform_reviews``.
    """
    reader = (spark.read.option("header", True).option("multiLine", True)
              .option("escape", '"').option("quote", '"').option("mode", "PERMISSIVE"))
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", False)
    return normalise_missing(reader.csv(path))


def read_reviews_parquet(spark: SparkSession, path: str) -> DataFrame:
    return normalise_missing(spark.read.parquet(path))


def read_reviews(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Read a file, a folder of files or a glob as ``fmt`` (``csv`` or ``parquet``).

    Without ``fmt`` the name decides; name it for a folder of CSV files.  A
    missing path raises Spark's PATH_NOT_FOUND.
    """
    if fmt is None:
        fmt = "csv" if path.lower().rstrip("/").endswith((".csv", ".csv.gz")) else "parquet"
    if fmt not in ("csv", "parquet"):
        raise ValueError(f"unknown review format: {fmt}")
    return read_reviews_csv(spark, path) if fmt == "csv" else read_reviews_parquet(spark, path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table (``{sf_dir}/{name}.parquet``)."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
