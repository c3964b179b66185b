"""Quality gate: the checks of a processed review table, taken while it is written.

One ``Observation`` carries the null count of every column, the number of short
reviews and the size of every label, so the checks cost no pass of their own.
Results are rows ``(check, item, value, failed)``:

* ``missing``: a column with nulls fails (one row per such column);
* ``short``: reviews below the least length fail when there are any;
* ``imbalance``: the smallest label that occurs fails below its share of all rows.

Failing checks are reported; those named in ``stop_on`` stop the phase before its
table is published.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from review_insights import constants as K

CHECKS = ("missing", "short", "imbalance")
SCHEMA = "check string, item string, value long, failed boolean"


@dataclass(frozen=True)
class CheckResult:
    check: str
    item: str | None
    value: int
    failed: bool


def observe_checks(df: DataFrame, observation: Observation) -> DataFrame:
    """``df`` with its checks observed when it is written."""
    metrics = [F.count(F.lit(1)).alias("rows")]
    metrics += [F.count_if(F.col(f"`{c}`").isNull()).alias(f"null_{k}") for k, c in enumerate(df.columns)]
    if "review_length" in df.columns:
        metrics.append(F.count_if(F.col("review_length") < K.SHORT_REVIEW_LENGTH).alias("short"))
    if "sentiment_label" in df.columns:
        metrics += [F.count_if(F.col("sentiment_label") == label).alias(f"label_{label}") for label in K.SENTIMENTS]
    return df.observe(observation, *metrics)


def results(columns: list[str], metrics: dict) -> list[CheckResult]:
    """The checks from observed metrics."""
    out = [CheckResult("missing", c, n, True) for k, c in enumerate(columns) if (n := int(metrics.get(f"null_{k}") or 0)) > 0]
    if "short" in metrics:
        out.append(CheckResult("short", None, int(metrics["short"]), int(metrics["short"]) > 0))
    sizes = [(int(n), name.removeprefix("label_")) for name, n in metrics.items() if name.startswith("label_") and int(n) > 0]
    if sizes:
        least, label = min(sizes)
        out.append(CheckResult("imbalance", label, least, least < K.IMBALANCE_SHARE * int(metrics["rows"])))
    return out


def as_frame(spark: SparkSession, found: Iterable[CheckResult]) -> DataFrame:
    return spark.createDataFrame([(r.check, r.item, r.value, r.failed) for r in found], SCHEMA)


def stopping(found: Iterable[CheckResult], stop_on: Iterable[str]) -> list[CheckResult]:
    """The failed checks that stop the phase."""
    unknown = set(stop_on) - set(CHECKS)
    if unknown:
        raise ValueError(f"unknown checks: {sorted(unknown)}")
    return [r for r in found if r.failed and r.check in set(stop_on)]
