"""SparkSession construction and the few session-level settings the library relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job of this library assumes.  UTC keeps epoch <-> timestamp
# conversions identical to naive-datetime semantics; AQE re-plans joins and
# coalesces the small shuffles the low-cardinality aggregates produce.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # The keyword classifiers fuse into one generated method larger than the
    # 8 KB HotSpot will JIT by default; without this it runs interpreted (~2x slower).
    "spark.driver.extraJavaOptions": "-XX:-DontCompileHugeMethods",
    "spark.executor.extraJavaOptions": "-XX:-DontCompileHugeMethods",
}


def build_session(master: str = "local[*]", app_name: str = "review-insights",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the library defaults applied."""
    builder = SparkSession.builder.master(master).appName(app_name)
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    sc = spark_context(spark)
    if sc is not None:
        sc.setLogLevel("ERROR")
    return spark


def ensure_utc(spark: SparkSession) -> None:
    """Timestamps are naive in the source data; every conversion assumes UTC."""
    if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def spark_context(spark: SparkSession):
    """The SparkContext, or None for sessions without one (Spark Connect)."""
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 - Connect sessions raise here
        return None


def _is_local(spark: SparkSession) -> bool:
    sc = spark_context(spark)
    master = sc.master if sc is not None else spark.conf.get("spark.master", "")
    return (master or "").startswith("local")


def _local_fallback(spark: SparkSession) -> str:
    """A private folder for local sessions (tests); never used on a cluster,
    where executors on other machines could not read it."""
    if not _is_local(spark):
        raise RuntimeError("spark.checkpoint.dir is not set: point it at shared storage "
                           "(e.g. an HDFS/S3 folder) so intermediate tables survive executor loss")
    return tempfile.mkdtemp(prefix="review-insights-ckpt-")


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    On a cluster the setting points at shared storage and is used as is (and
    a missing setting is an error).  Only when it is unset in a local session
    (tests) is a private temporary folder created.
    """
    sc = spark_context(spark)
    if sc is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            configured = _local_fallback(spark)
            spark.conf.set("spark.checkpoint.dir", configured)
        return configured
    configured = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) \
        or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        configured = _local_fallback(spark)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def shared_path(spark: SparkSession, name: str) -> str:
    """A place for a table that later applications find again: directly under the
    folder the cluster names, not under this application's own part of it."""
    sc = spark_context(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or (sc.getConf().get("spark.checkpoint.dir", None) if sc is not None else None)
    if not base:
        return table_path(spark, name)
    return f"{base.rstrip('/')}/review-insights/{name}"


def table_path(spark: SparkSession, name: str) -> str:
    """A location for an intermediate table under the shared checkpoint folder."""
    base = checkpoint_dir(spark)
    return os.path.join(base, "tables", name) if "://" not in base else f"{base.rstrip('/')}/tables/{name}"


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark_context(spark)
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete one intermediate table; a session without a SparkContext leaves it in the checkpoint folder."""
    if spark_context(spark) is not None:
        _delete(spark, path)


def drop_intermediate(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application, when none of its results is needed any more."""
    if spark_context(spark) is None:
        raise RuntimeError("a session without a SparkContext cannot delete files: drop the checkpoint folder instead")
    _delete(spark, table_path(spark, ""))
