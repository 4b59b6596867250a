"""Metric addressing and the regression gate."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.schemas import ITEMS, METRICS, RATES

THRESHOLDS = "metric string, direction string, bound double, note string"


class GateError(ValueError):
    """A thresholds file that can't be graded against."""


def metrics(report: DataFrame, ratios: DataFrame, selective: DataFrame) -> DataFrame:
    """(metric, value) of a run: `accuracy`, `ambiguous.accuracy`, `field.<item>.accuracy`, `ratio.*`, `selective.*`.

    A null value is a metric whose denominator was zero.
    """
    rates = report.unpivot("scope", list(RATES), "rate", "value")
    named = F.when(F.col("scope") == "overall", F.col("rate")).otherwise(F.concat_ws(".", "scope", "rate"))
    parts = [rates.select(named.alias("metric"), "value")]
    for prefix, frame, names in (("ratio.", ratios, ("agreement", "safety")), ("selective.", selective, ("aurc", "coverage", "error_on_answered", "baseline_error"))):
        each = F.array(*(F.struct(F.lit(prefix + n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names))
        parts.append(frame.select(F.explode(each).alias("x")).select("x.metric", "x.value"))
    return parts[0].union(parts[1]).union(parts[2])


def is_metric(name: str) -> bool:
    field, item, rate = (name.split(".", 2) + ["", ""])[:3]
    return name in METRICS or field == "field" and item in ITEMS and rate in RATES


def thresholds(text: str) -> tuple[list[tuple[str, str, float, str]], bool]:
    """Rows of THRESHOLDS, and whether an undefined metric passes. A bare number is a floor; an object has `min` or `max`."""
    try:
        raw = json.loads(text)
        entries = raw["metrics"].items()
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        raise GateError(f"no thresholds: {e}") from e
    rows = []
    for metric, spec in entries:
        if not is_metric(metric):
            raise GateError(f"unknown metric {metric}")
        bounds = {"min": spec} if not isinstance(spec, dict) else {k: spec[k] for k in ("min", "max") if k in spec}
        if len(bounds) != 1:
            raise GateError(f"{metric}: either a floor or a ceiling")
        (direction, bound), = bounds.items()
        if isinstance(bound, bool) or not isinstance(bound, (int, float)):
            raise GateError(f"{metric}: {bound!r} is not a number")
        rows.append((metric, direction, float(bound), spec.get("note", "") if isinstance(spec, dict) else ""))
    if not rows:
        raise GateError("no metrics to grade")
    return rows, bool(raw.get("allow_undefined", False))


def threshold_table(spark: SparkSession, rows: list[tuple[str, str, float, str]]) -> DataFrame:
    return spark.createDataFrame(rows, THRESHOLDS)


def grade(values: DataFrame, limits: DataFrame, allow_undefined: bool = False) -> DataFrame:
    """(metric, direction, bound, note, observed, status, passed): `undefined` passes only where that is allowed."""
    joined = limits.join(values.withColumnRenamed("value", "observed"), "metric", "left")
    holds = F.when(F.col("direction") == "min", F.col("observed") >= F.col("bound")).otherwise(F.col("observed") <= F.col("bound"))
    status = F.when(F.col("observed").isNull(), "undefined").when(holds, "pass").otherwise("fail")
    return joined.withColumn("status", status).withColumn("passed", (F.col("status") == "pass") | (F.lit(allow_undefined) & (F.col("status") == "undefined")))


def passes(checks: DataFrame) -> DataFrame:
    return checks.agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"), F.count_if(~F.col("passed")).alias("failures"))
