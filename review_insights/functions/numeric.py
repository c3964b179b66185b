"""Numeric coercion and guarded arithmetic with pandas-compatible null rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Plain decimal / scientific notation or an infinity, optionally padded by
# whitespace: what a lenient numeric parser accepts.  Java-only forms such as
# '5d' or hex are rejected here even though a cast would take them.
_NUMERIC_TEXT = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)\s*$"

# Smallest and largest epoch second a timestamp can hold (years 1..9999).
EPOCH_MIN = -62135596800
EPOCH_MAX = 253402300799


def coerce_numeric(c: Column) -> Column:
    """String or number -> double; unparsable text and NaN become null."""
    as_text = c.cast("string")
    parsed = F.when(as_text.rlike(_NUMERIC_TEXT), F.trim(as_text).try_cast("double"))
    return F.nanvl(parsed, F.lit(None).cast("double"))


def clip_to_int(x: Column, lo: int, hi: int) -> Column:
    """Clip to [lo, hi] first (so infinities are defined), then truncate to int."""
    return F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi))).cast("int")


def epoch_to_timestamp(c: Column) -> Column:
    """Epoch seconds -> timestamp; unparsable or out-of-range values -> null."""
    secs = coerce_numeric(c)
    return F.when(secs.between(EPOCH_MIN, EPOCH_MAX), F.timestamp_seconds(secs))


def safe_div(num: Column, den: Column) -> Column:
    """Division that yields null instead of raising when the denominator is 0."""
    return F.try_divide(num, den)


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)
