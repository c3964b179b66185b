"""Exact dedup by distributed MSD radix partitioning.

Texts are equal when identical after replacing every run of the white space
bytes 0x20, 0x09-0x0D by one space.  Equality is decided by the bytes
themselves; no digest takes part in it (the SHA-256 is only an output column).

Method.  The radix string of a text is its length followed by its normalised
bytes.  Most significant digit first, rows are split by successive digits:
level 0 by (length, bytes 0-63), level k by bytes ``BOUNDS[k]`` up to
``BOUNDS[k + 1]``.  A group that is a singleton, or whose texts have ended,
leaves the recursion; only the rest goes to the next level.  As the digits
widen by a factor of eight, ten levels hold every text Spark can hold.

Scale.  Inside each Arrow batch the same recursion runs in memory first and
equal texts of the batch become one row with the list of their ids, so a hot
group enters the shuffle as one row per batch and not one per copy.  Group
sizes are counted with map-side partial aggregation; the join that brings the
group id back to the rows is a plain shuffle join, which adaptive execution
splits if skewed.  Every level is written to the shared checkpoint folder and
holds the bytes of the still undecided rows only.

Defined results: a null text counts as empty, and all empty texts form one
group (a text of white space only equals " ").  Of repeated rows with one
doc_id one row is kept.  A null id sorts after all others.  An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from review_insights.llm.common import id_and_bytes, numbered, partition_id, saved, unused, without_rows

#: Byte offsets between the digits of the radix string.
BOUNDS = (0, 64, 512, 4096, 1 << 15, 1 << 18, 1 << 21, 1 << 24, 1 << 27, 1 << 31)
LEVELS = len(BOUNDS) - 1

_SPACE = b" \t\n\x0b\x0c\r"

_ROW = T.StructType([
    T.StructField("row", T.LongType()),
    T.StructField("members", T.ArrayType(T.StructType([
        T.StructField("no_id", T.BooleanType()), T.StructField("id", T.LongType()), T.StructField("row_id", T.LongType())]))),
    T.StructField("length", T.LongType()),
    T.StructField("sha", T.StringType()),
    *[T.StructField(f"d{k}", T.BinaryType()) for k in range(LEVELS)],
])


def normalise(data: bytes) -> bytes:
    """Every run of white space bytes becomes one space, also at the edges."""
    body = b" ".join(data.split())
    if data and data[0] in _SPACE:
        body = b" " + body
    if data and data[-1] in _SPACE and body != b" ":
        body += b" "
    return body


def radix_groups(texts: list[bytes]) -> list[list[int]]:
    """Indexes of equal texts, by MSD radix recursion with an explicit stack."""
    done: list[list[int]] = []
    by_length: dict[int, list[int]] = {}
    for i, t in enumerate(texts):
        by_length.setdefault(len(t), []).append(i)
    stack = [(0, g) for g in by_length.values()]
    while stack:
        level, group = stack.pop()
        if len(group) == 1 or BOUNDS[level] >= len(texts[group[0]]):
            done.append(group)
            continue
        split: dict[bytes, list[int]] = {}
        for i in group:
            split.setdefault(texts[i][BOUNDS[level]:BOUNDS[level + 1]], []).append(i)
        stack.extend((level + 1, g) for g in split.values())
    return done


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per distinct text of a batch, with the sorted ids of its copies."""
    row, schema = partition_id() << 33, None
    for batch in batches:
        ids, row_ids = batch.column("id").to_pylist(), batch.column("row_id").to_pylist()
        texts = [normalise(b) for b in batch.column("data").to_pylist()]
        out = []
        for group in radix_groups(texts):
            members = sorted((ids[i] is None, ids[i] or 0, row_ids[i]) for i in group)
            text = texts[group[0]]
            out.append({
                "row": row, "length": len(text), "sha": hashlib.sha256(text).hexdigest(),
                "members": [{"no_id": a, "id": None if a else b, "row_id": c} for a, b, c in members],
                **{f"d{k}": text[BOUNDS[k]:BOUNDS[k + 1]] for k in range(LEVELS)},
            })
            row += 1
        if schema is None:
            member = pa.struct([("no_id", pa.bool_()), ("id", pa.int64()), ("row_id", pa.int64())])
            schema = pa.schema([("row", pa.int64()), ("members", pa.list_(member)), ("length", pa.int64()),
                                ("sha", pa.string()), *[(f"d{k}", pa.binary()) for k in range(LEVELS)]])
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 row_col: str | None = None) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256, row_id``.

    ``row_col`` names a column that tells rows with one id apart (default: a
    row number given at the scan).
    """
    row_id = F.col(row_col) if row_col else F.monotonically_increasing_id()
    picked = id_and_bytes(docs, id_col, text_col, row_id.cast("long").alias("row_id"))
    rows = saved(picked.mapInArrow(_collapse, _ROW).withColumn("grp", F.lit(0).cast("long")), "radix-rows")

    decided = None
    for level in range(LEVELS):
        digits = [f"d{k}" for k in range(level + 1, LEVELS)]
        key = ["grp", "length", f"d{level}"] if level == 0 else ["grp", f"d{level}"]
        sizes = rows.groupBy(*key).agg(
            F.count(F.lit(1)).alias("g_rows"), F.sum(F.size("members")).alias("g_size"),
            F.min(F.struct(F.col("members")[0]["no_id"], F.col("members")[0]["id"],
                           F.col("members")[0]["row_id"], "row")).alias("g_first"))
        split = rows.join(sizes, key)
        ended = (F.col("g_rows") == 1) | (F.col("length") <= BOUNDS[level + 1])
        split = split.select(
            F.col("g_first.row").alias("grp"), "row", "members", "length", "sha", "g_size",
            F.col("g_first.id").alias("keep_id"), F.col("g_first.row").alias("first_row"), ended.alias("ended"),
            *[F.when(~ended, F.col(d)).alias(d) for d in digits])
        split = saved(split, f"radix-level{level}")
        part = split.where("ended").select("row", "members", "sha", "g_size", "keep_id", "first_row")
        decided = part if decided is None else decided.unionByName(part)
        rows = split.where("NOT ended").select("grp", "row", "members", "length", "sha", *digits)
        if rows.isEmpty():
            break
    return (decided.select("*", F.posexplode("members").alias("at", "member"))
            .select(F.col("member.id").alias("doc_id"), "keep_id", F.col("g_size").alias("group_size"),
                    ((F.col("row") == F.col("first_row")) & (F.col("at") == 0)).alias("kept"),
                    F.col("sha").alias("text_sha256"), F.col("member.row_id").alias("row_id")))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without later copies, all columns as they were.

    Rows are told apart by their place in files (see :func:`common.numbered`).
    """
    row = unused(docs, "_radix_row")
    rows = numbered(docs, row)
    gone = exact_groups(rows, id_col, text_col, row).where("NOT kept").select(F.col("row_id").alias(row))
    return without_rows(rows, row, gone, docs.columns, "radix-dropped")
