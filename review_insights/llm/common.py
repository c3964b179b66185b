"""Helpers shared by the corpus operators: table access, written intermediate
tables, and byte-level work on Arrow columns."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from review_insights.session import table_path

#: Bytes of text worked on at once inside a task: bounds the numpy temporaries.
BLOCK_BYTES = 1 << 18

_MIX1 = 0xBF58476D1CE4E5B9
_MIX2 = 0x94D049BB133111EB
_M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables of a few numbers a row (ids, pairs, edges) use one partition in so many.
NARROW = 16


def narrowed(df: DataFrame) -> DataFrame:
    """Fewer partitions for rows of a few numbers, in proportion to the shuffle partitions."""
    return df.coalesce(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // NARROW))


def saved(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    Cuts the lineage: what follows survives the loss of any executor without
    running the steps above again.  ``narrow``: see :func:`narrowed`.
    """
    spark = df.sparkSession
    df = narrowed(df) if narrow else df
    path = table_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Row ids (8 bytes each) up to which a look-up is broadcast; beyond, it is a shuffle join.
BROADCAST_IDS = 500_000


def small_enough(ids: DataFrame, at_most: int | None = None) -> DataFrame:
    """A table of ids, marked for broadcast if its checked size (or a known bound) allows."""
    bound = ids.count() if at_most is None else at_most
    return F.broadcast(ids) if bound <= BROADCAST_IDS else ids.hint("merge")


def without_rows(docs: DataFrame, row: str, dropped: DataFrame, columns: list[str], name: str) -> DataFrame:
    """``columns`` of the rows of ``docs`` whose ``row`` is not in ``dropped`` (one column, ``row``)."""
    gone = small_enough(saved(dropped, name, narrow=True))
    return docs.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in columns])


def numbered(docs: DataFrame, row: str) -> DataFrame:
    """``docs`` with ``row``: a number for each row by its file (in order of name) and place there.

    Two scans give a row the same number however they deal out the files, also when executors were lost or
    joined in between.  What is not a scan of files is written first.
    """
    try:
        return _numbered_scan(docs, row)
    except AnalysisException:  # no file and place
        return _numbered_scan(saved(docs, "numbered"), row)


def _numbered_scan(docs: DataFrame, row: str) -> DataFrame:
    meta, file, place = docs.metadataColumn("_metadata"), unused(docs, "_at_file"), unused(docs, "_at_place")
    placed = docs.select("*", meta["file_path"].alias(file), meta["row_index"].alias(place))
    # one row per file
    files = docs.select(meta["file_path"].alias(file)).distinct()
    files = files.select(file, F.shiftleft(F.row_number().over(Window.orderBy(file)).cast("long"), 40).alias(row))
    return (placed.join(small_enough(files, len(docs.inputFiles())), file)
            .select(*[F.col(f"`{c}`") for c in docs.columns], (F.col(row) + F.col(place)).alias(row)))


def id_and_bytes(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """``(id, data, ...)``: the id as long and the UTF-8 bytes of the text (null: empty).
    No other column of ``docs`` is read, so extra columns cannot clash."""
    return docs.select(F.col(id_col).cast("long").alias("id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("data"), *more)


def unused(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``docs`` starts with."""
    while any(c.lower().startswith(name.lower()) for c in docs.columns):
        name += "_"
    return name


def partition_id() -> int:
    from pyspark import TaskContext

    ctx = TaskContext.get()
    return ctx.partitionId() if ctx is not None else 0


def joined_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary Arrow column as one uint8 array, and n + 1 offsets."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_binary(col.type):
        col = col.cast(pa.large_binary())
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose bytes add up to about ``limit``; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(_MIX1)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(_MIX2)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i in 0..n-1."""
    out = np.full(max(n, 1), np.uint64(base & _M64))
    out[0] = 1
    return np.multiply.accumulate(out)


class SpanHash:
    """64-bit hashes of byte spans of one block, from prefix sums of a polynomial.

    The hash depends on the bytes and the length of a span only, so equal spans
    of different documents, blocks and tasks get equal hashes.
    """

    def __init__(self, data: np.ndarray, seed: int = 0):
        base = (_BASE + 2 * seed * _MIX1) & _M64 | 1
        n = len(data)
        self._inverse = powers(pow(base, -1, 1 << 64), n + 1)
        scrambled = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MIX2) + np.uint64(seed))
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(scrambled[data] * powers(base, n)[:n], out=self._sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self._sums[end] - self._sums[start]) * self._inverse[start]
        return mix(h + (end - start).astype(np.uint64) * np.uint64(_MIX1))


def is_space(data: np.ndarray) -> np.ndarray:
    """Bytes 0x20 and 0x09 to 0x0D."""
    return (data == 32) | ((data >= 9) & (data <= 13))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, end, row)`` of every run of non-space bytes, never across rows."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    ink = ~is_space(data)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = ink[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    before[first] = False
    start = np.flatnonzero(ink & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = ink[1:]
    after[first[first > 0] - 1] = False
    end = np.flatnonzero(ink & ~after) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


#: Fields whose values mostly grow from row to row: packed as differences.
ORDERED_FIELDS = ("id", "doc", "start", "grp")


def packed(table: np.ndarray) -> bytes:
    """A structured array as compressed byte planes, field by field."""
    import zstandard

    parts = [len(table).to_bytes(8, "little")]
    for name in table.dtype.names:
        column = np.ascontiguousarray(table[name])
        if name in ORDERED_FIELDS and len(column):
            column = np.diff(column, prepend=column.dtype.type(0))
        planes = column.view(np.uint8).reshape(len(column), -1).T
        parts.append(np.ascontiguousarray(planes).tobytes())
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def unpacked(data: bytes, dtype: np.dtype) -> np.ndarray:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    n, at = int.from_bytes(raw[:8], "little"), 8
    out = np.empty(n, dtype)
    for name in dtype.names:
        kind = dtype[name]
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        column = np.ascontiguousarray(planes.T).view(kind).reshape(n) if n else np.empty(0, kind)
        out[name] = np.cumsum(column, dtype=kind) if name in ORDERED_FIELDS else column
        at += n * kind.itemsize
    return out
