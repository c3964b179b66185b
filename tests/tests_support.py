"""Helpers of the tests: rows read by tasks, from Spark's event log."""

import json
import os


def _log_file(spark):
    folder = spark.conf.get("spark.eventLog.dir").removeprefix("file://")
    name = spark.sparkContext.applicationId
    return next(os.path.join(folder, f) for f in os.listdir(folder) if f.startswith(name))


def _drain(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()


def records_read(spark, run) -> int:
    """Records that tasks read from files while ``run`` runs."""
    _drain(spark)
    path = _log_file(spark)
    at = os.path.getsize(path)
    run()
    _drain(spark)
    total = 0
    with open(path, encoding="utf-8") as f:
        f.seek(at)
        for line in f:
            if '"SparkListenerTaskEnd"' in line:
                metrics = json.loads(line).get("Task Metrics") or {}
                total += metrics.get("Input Metrics", {}).get("Records Read", 0)
    return total
