"""Scoring of claims as they arrive; an extension, for extractors that run for days.

Each batch is scored against the static labels and appended; reports over the table are batch queries. Claims that repeat a
(doc_id, name) within the watermark are dropped, so replays of a source do not count twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.operators.scoring import with_outcome


def score_stream(claims: DataFrame, golden: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Streaming claims (doc_id, name, value, unit_scale, grounded, confidence, at) with their outcomes."""
    once = claims.withWatermark("at", delay).dropDuplicatesWithinWatermark(["doc_id", "name"])
    actual = once.select("doc_id", "name", (F.col("value") * F.col("unit_scale")).alias("actual"), "grounded", "confidence", "at")
    return with_outcome(actual.join(golden.select("doc_id", "name", "expected", "ambiguous"), ["doc_id", "name"]))


def windowed_outcomes(scored: DataFrame, width: str = "10 minutes") -> DataFrame:
    """Outcomes per tumbling window."""
    return scored.groupBy(F.window("at", width), "outcome").agg(F.count("*").alias("n"))
