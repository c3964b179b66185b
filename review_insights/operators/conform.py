"""Conform a raw review export to the review schema (rename, complete, infer, type).

Every step is a column expression over one row, so conforming is a single
narrow stage: no shuffle unless a required column is missing and a row index
has to be assigned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from review_insights import constants as K
from review_insights.functions.numeric import clip_to_int, coerce_numeric, epoch_to_timestamp
from review_insights.functions.text import contains_any, contains_kw, lower_or_empty
from review_insights.operators.row_index import has_file_position, index_by_file, with_row_index

METADATA_MODES = ("keep", "hash", "rand")


def rename_columns(df: DataFrame) -> DataFrame:
    """Raw export names -> review names; absent names are ignored."""
    return df.withColumnsRenamed({k: v for k, v in K.RENAME_MAP.items() if k in df.columns})


def _default_order(df: DataFrame) -> list[str]:
    return ["review_id"] if "review_id" in df.columns else sorted(df.columns)


def complete_required(df: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """Add absent required columns.  Only absent *columns* are filled; nulls stay.

    * ``product_id`` -> ``B%06d`` of the row position: in the files when the frame
      carries it (``with_file_position``), else in ``order_by`` order
    * ``rating`` -> 5
    * ``review_text`` -> a fixed placeholder sentence
    A missing date column (handled in ``convert_dates``) needs the same row
    position, so both are assigned in one indexing pass.
    """
    need_index = "product_id" not in df.columns or "review_date" not in df.columns
    if need_index and order_by is None and has_file_position(df):
        df = index_by_file(df, "_row_index", "_row_total")
    elif need_index:
        df = with_row_index(df, order_by or _default_order(df), "_row_index", "_row_total")
    if "product_id" not in df.columns:
        df = df.withColumn("product_id", F.format_string(K.PRODUCT_ID_FORMAT, F.col("_row_index")))
    if "rating" not in df.columns:
        df = df.withColumn("rating", F.lit(K.DEFAULT_RATING))
    if "review_text" not in df.columns:
        df = df.withColumn("review_text", F.lit(K.DEFAULT_REVIEW_TEXT))
    return df


def product_name_expr(low_text: Column, title: Column, product_id: Column) -> Column:
    """Title (if longer than 3 chars, first 50), else the first product keyword in
    the lower-cased text (title-cased), else ``Product <id>``, else a fixed name."""
    expr = F.when(F.length(title) > K.TITLE_MIN_LENGTH, F.substring(title, 1, K.TITLE_MAX_CHARS))
    for kw in K.PRODUCT_NAME_KEYWORDS:
        expr = expr.when(contains_kw(low_text, kw), F.lit(kw.title()))
    expr = expr.when(F.length(product_id) > 0, F.concat(F.lit("Product "), product_id))
    return expr.otherwise(F.lit(K.UNKNOWN_PRODUCT_NAME))


def category_expr(blob: Column) -> Column:
    """First keyword group found in ``lower(text) + ' ' + lower(title)``; default food."""
    expr = None
    for category, words in K.CATEGORY_KEYWORDS:
        test = contains_any(blob, words)
        expr = F.when(test, F.lit(category)) if expr is None else expr.when(test, F.lit(category))
    return expr.otherwise(F.lit(K.DEFAULT_CATEGORY))


def infer_product_fields(df: DataFrame) -> DataFrame:
    """``product_name`` and ``product_category`` from title, text and id.

    The lowered texts are their own projection so each keyword scan reads a
    computed column instead of re-lowering the text per keyword.
    """
    title = F.col("review_title") if "review_title" in df.columns else F.lit(None).cast("string")
    out = df.withColumns({
        "_cf_low": lower_or_empty(F.col("review_text")),
        "_cf_title": lower_or_empty(title),
    })
    out = out.withColumn("_cf_blob", F.concat(F.col("_cf_low"), F.lit(" "), F.col("_cf_title")))
    return out.withColumns({
        "product_name": product_name_expr(F.col("_cf_low"), title, F.col("product_id").cast("string")),
        "product_category": category_expr(F.col("_cf_blob")),
    }).drop("_cf_low", "_cf_title", "_cf_blob")


def convert_dates(df: DataFrame) -> DataFrame:
    """Epoch seconds -> timestamp (bad values null); absent column -> even spread of
    2023-01-01 .. 2024-12-31 over the row positions, both ends included."""
    if "review_date" in df.columns:
        return df.withColumn("review_date", epoch_to_timestamp(F.col("review_date")))
    start = F.unix_micros(F.lit(K.SPREAD_START).cast("timestamp"))
    end = F.unix_micros(F.lit(K.SPREAD_END).cast("timestamp"))
    n = F.col("_row_total")
    step = (end - start).cast("double") / (n - 1)
    micros = F.when(n <= 1, start).otherwise(start + (F.col("_row_index") * step).cast("bigint"))
    return df.withColumn("review_date", F.timestamp_micros(micros))


def _hash_slice(key: Column, pos: int) -> Column:
    return F.conv(F.substring(F.md5(key.cast("string")), pos, 8), 16, 10).cast("bigint")


def fill_metadata(df: DataFrame, mode: str = "keep", seed: int = 42, key: str = "review_id") -> DataFrame:
    """Vote counts and the verified flag.

    ``keep``: existing columns are kept, absent ones filled deterministically as in
    ``hash``.  ``hash``: helpful in [0,20), total = helpful + [0,10), verified with
    probability 0.8, all from the md5 of the review key (reproducible, and the same
    in any SQL engine with md5).  ``rand``: seeded random values that overwrite any
    existing columns.
    """
    if mode not in METADATA_MODES:
        raise ValueError(f"mode must be one of {METADATA_MODES}")
    if mode == "rand":
        helpful = F.floor(F.rand(seed) * 20).cast("bigint")
        return (df.withColumn("helpful_votes", helpful)
                .withColumn("total_votes", F.col("helpful_votes") + F.floor(F.rand(seed + 1) * 10).cast("bigint"))
                .withColumn("verified_purchase", F.rand(seed + 2) < 0.8))
    k = F.col(key) if key in df.columns else F.concat_ws("|", *[F.col(c).cast("string") for c in df.columns])
    helpful = _hash_slice(k, 1) % 20
    fills = {
        "helpful_votes": helpful,
        "total_votes": helpful + _hash_slice(k, 9) % 10,
        "verified_purchase": _hash_slice(k, 17) % 10 < 8,
    }
    if mode == "keep":
        present = [c for c in fills if c in df.columns]
        if "helpful_votes" in present and "total_votes" not in present:
            fills["total_votes"] = F.col("helpful_votes") + _hash_slice(k, 9) % 10
        fills = {c: e for c, e in fills.items() if c not in present}
    return df.withColumns(fills)


def coerce_rating(df: DataFrame) -> DataFrame:
    """Numeric or drop the row; clip to 1..5 and truncate to an integer."""
    x = coerce_numeric(F.col("rating"))
    return (df.withColumn("rating", x).where(F.col("rating").isNotNull())
            .withColumn("rating", clip_to_int(F.col("rating"), 1, 5).cast("bigint")))


def conform_reviews(raw: DataFrame, metadata_mode: str = "keep", seed: int = 42,
                    order_by: list[str] | None = None) -> DataFrame:
    """Raw review export -> conformed review table (C1..C8)."""
    df = rename_columns(raw)
    if "review_id" in df.columns:
        df = df.withColumn("review_id", F.col("review_id").cast("string"))
    df = complete_required(df, order_by)
    df = infer_product_fields(df)
    df = convert_dates(df)
    df = fill_metadata(df, metadata_mode, seed)
    df = coerce_rating(df)
    return df.drop("_row_index", "_row_total")
