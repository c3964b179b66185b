"""Versioned tables: a table that readers always find whole.

A folder holds one folder of files per version and a manifest per version:

    <path>/data/<unique name>/part-*.parquet
    <path>/manifests/00000007.json     {"version": 7, "data": ..., "rows": ...}

A version is written to a folder of its own, checked, and becomes visible when its
manifest is renamed into place, which fails if the number was taken.  The current
version is the one with the highest manifest.  A write that fails half-way or whose
check fails leaves the folder of files without a manifest; readers keep the version
before.  Manifests are a few hundred bytes and are written by the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from review_insights.sources import sinks


@dataclass(frozen=True)
class Version:
    """One published version of a table."""
    number: int
    location: str
    rows: int
    fmt: str = "parquet"


class GateError(RuntimeError):
    """A check failed, and the version was not published."""


class _Files:
    """The Hadoop file system of a path, as Spark sees it."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark.sparkContext._jvm
        self._path = lambda p: self._jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        if not self._fs.exists(self._path(folder)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder)))

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()

    def create_whole(self, path: str, text: str) -> bool:
        """A file that appears with its whole content; False if the name is taken."""
        folder, name = path.rsplit("/", 1)
        self._fs.mkdirs(self._path(folder))
        part = f"{folder}/.{name}.{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(part), False)
        stream.write(bytearray(text.encode("utf-8")))
        stream.close()
        if not self._fs.exists(self._path(path)) and self._fs.rename(self._path(part), self._path(path)):
            return True
        self._fs.delete(self._path(part), False)
        return False

    def drop(self, folder: str) -> None:
        self._fs.delete(self._path(folder), True)


def _manifest(path: str, number: int) -> str:
    return f"{path.rstrip('/')}/manifests/{number:08d}.json"


def history(spark: SparkSession, path: str) -> list[Version]:
    """All published versions, the oldest first."""
    files = _Files(spark, path)
    out = []
    for name in files.names(f"{path.rstrip('/')}/manifests"):
        if name.endswith(".json") and not name.startswith("."):
            m = json.loads(files.read(f"{path.rstrip('/')}/manifests/{name}"))
            out.append(Version(m["version"], m["data"], m["rows"], m["format"]))
    return out


def current(spark: SparkSession, path: str) -> Version:
    found = history(spark, path)
    if not found:
        raise FileNotFoundError(f"no published version of {path}")
    return found[-1]


def find(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """The current version, or the one with this number."""
    wanted = current(spark, path) if number is None else next((v for v in history(spark, path) if v.number == number), None)
    if wanted is None:
        raise FileNotFoundError(f"no version {number} of {path}")
    return wanted


def read_version(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The rows of the current version, or of the one with this number."""
    wanted = find(spark, path, number)
    reader = spark.read.format(wanted.fmt)
    return reader.options(**sinks.CSV_WRITE_OPTIONS).load(wanted.location) if wanted.fmt == "csv" else reader.load(wanted.location)


def publish(df: DataFrame, path: str, check: Callable[[DataFrame, int], None] | None = None, fmt: str = "parquet",
            write: Callable[[DataFrame, str], int] | None = None, attempts: int = 20) -> Version:
    """Write ``df`` as the next version of ``path``.

    ``check(table, rows)`` sees the written files before anybody else does and may
    raise.  ``write`` replaces the plain table write (it returns the row count).
    Writers that finish together get numbers one after the other.
    """
    spark = df.sparkSession
    location = f"{path.rstrip('/')}/data/{uuid.uuid4().hex}"
    rows = write(df, location) if write else sinks.write_table(df, location, fmt=fmt)
    if check is not None:
        check(spark.read.format(fmt).load(location), rows)
    files = _Files(spark, path)
    for _ in range(attempts):
        before = history(spark, path)
        number = before[-1].number + 1 if before else 1
        text = json.dumps({"version": number, "data": location, "rows": rows, "format": fmt})
        if files.create_whole(_manifest(path, number), text):
            return Version(number, location, rows, fmt)
    raise RuntimeError(f"{path}: other writers took {attempts} version numbers")


def expire(spark: SparkSession, path: str, keep: int = 2) -> list[Version]:
    """Drop all but the last ``keep`` versions: manifests first, so that no reader finds a version without files."""
    files, gone = _Files(spark, path), history(spark, path)[:-max(keep, 1)]
    for v in gone:
        files.drop(_manifest(path, v.number))
    for v in gone:
        files.drop(v.location)
    return gone
