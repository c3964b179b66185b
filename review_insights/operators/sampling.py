"""Samples of an exact size from tables of any size.

Rows are ordered by a hash of a key and a seed, then by a hash of the whole row,
and the first ``n`` of that order are the sample: the same rows whatever the
partitioning, in any engine with md5.  A small sample is a top-k.  A large one is
never sorted in one place: the ``n``-th row of the order is found by selection on
the digits of the hash.

* One pass counts rows by the next four hex digits (at most 65,536 counts).
* All rows below the digits at which the count passes ``n`` belong to the sample;
  the search goes on inside these digits with what is missing, until they hold few
  rows (or only rows with the same hash of key and content).  Digits that
  all rows inside share are taken at once, so copies cost no pass for each of them.
* Rows that may belong to the sample are counted as distinct rows in one pass; the few
  near the cut are ordered, and cut at the missing number.

The passes read the key only (the whole row where keys repeat beyond the limit);
rows that are far from the cut are never shuffled.
"""

from __future__ import annotations

import os.path
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Samples up to this size are a top-k: every task sends that many rows at most.
TOP_K = 1_000
DIGITS = 4
KEY_DIGITS, ROW_DIGITS = 32, 16
#: The rows among which the last ones are found: this share of the sample, but no fewer than so many.
NEAR_SHARE, NEAR_LEAST = 0.05, 2_000


def order_columns(df: DataFrame, key: Sequence[str], seed: int) -> tuple[Column, Column]:
    """The two parts of the order, as hex digits."""
    name = F.concat_ws("|", *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("")) for k in key], F.lit(str(seed)))
    row = F.lpad(F.lower(F.hex(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))), ROW_DIGITS, "0")
    return F.md5(name), row


def _cut(df: DataFrame, n: int, key: Sequence[str], seed: int, near: int) -> tuple[str, int] | None:
    """Digits within which the ``n``-th row lies and the rows missing there; None if there are no more than ``n`` rows."""
    first, row = order_columns(df, key, seed)
    digits, missing = "", n
    while len(digits) < KEY_DIGITS + ROW_DIGITS:
        # the content is hashed only where keys repeat
        name = first if len(digits) + DIGITS <= KEY_DIGITS else F.concat(first, row)
        inside, ends = df.select(name.alias("_h")), []
        if digits:
            # few rows are left: the digits that their least and greatest hash share cost no pass each
            inside = df.select(name.alias("_h"), F.concat(first, row).alias("_f")).where(F.col("_h").startswith(digits))
            ends = [F.min("_f").alias("lo"), F.max("_f").alias("hi")]
        counts = inside.groupBy(F.substring("_h", len(digits) + 1, DIGITS).alias("d")).agg(F.count(F.lit(1)).alias("n"), *ends).collect()
        for found in sorted(counts, key=lambda r: r["d"]):
            count = found["n"]
            if count > missing:
                digits = os.path.commonprefix([found["lo"], found["hi"]]) if ends else digits + found["d"]
                break
            missing -= count
        else:
            return None if not digits else (digits + "g", 0)
        if missing == 0 or count <= near:
            break
    return digits, missing


def exact_sample(df: DataFrame, n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """``min(n, rows)`` rows of ``df``, the first in the order of the hash of ``key`` and ``seed``.

    Large samples start jobs while they are built (the counts).  ``df`` is read
    again, so it must give the same rows each time.
    """
    first, row = order_columns(df, key, seed)
    if n <= TOP_K:
        return df.orderBy(first, row).limit(n)
    found = _cut(df, n, key, seed, max(int(NEAR_SHARE * n), NEAR_LEAST))
    if found is None:
        return df
    digits, missing = found
    name = first if len(digits) <= KEY_DIGITS else F.concat(first, row)
    if missing == 0:
        return df.where(name < digits)
    # at most n rows and few near the cut, or copies that the partial aggregation counts where they are read.  What tells
    # them apart is an aggregate, so both parts come from one exchange and the rows are read once
    columns = [F.col(f"`{c}`") for c in df.columns]
    near = name.startswith(digits)
    inside = df.where((name < digits) | near).groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies"), F.max(near).alias("_near"))
    before = F.sum("_copies").over(Window.orderBy("_first", "_row", *columns)
                                   .rowsBetween(Window.unboundedPreceding, 0)) - F.col("_copies")
    last = (inside.where(F.col("_near")).withColumns({"_first": first, "_row": row}).withColumn("_before", before).where(F.col("_before") < missing)
            .select(*columns, F.least(F.col("_copies"), F.lit(missing) - F.col("_before")).alias("_taken")))
    taken = inside.where(~F.col("_near")).select(*columns, F.col("_copies").alias("_taken")).unionByName(last)
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_taken")))).select(*columns)
