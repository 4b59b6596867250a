"""Enumerations, dimensions and declared schemas. Orders are part of the meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values.
ITEMS = ("revenue_ltm", "ebitda_reported", "ebitda_addbacks", "total_debt", "cash", "interest_expense", "principal_repayments", "cfads")
MAGNITUDE_ITEMS = ("interest_expense", "principal_repayments")
OUTCOMES = ("correct", "mismatch", "omission", "hallucination", "correct_abstention", "ungrounded")
RATIOS = ("ltm_revenue", "adjusted_ebitda", "leverage", "dscr")
RATIO_OUTCOMES = ("agree", "disagree", "both_abstained", "extraction_abstained", "golden_abstained")
RATES = ("accuracy", "coverage", "grounding_rate", "hallucination_rate", "omission_rate", "ungrounded_rate", "abstention_precision")
METRICS = (*RATES, *(f"ambiguous.{m}" for m in RATES), "ratio.agreement", "ratio.safety", "selective.aurc", "selective.coverage", "selective.error_on_answered", "selective.baseline_error")

GOLDEN = """doc_id string, source string, pages int, scanned boolean,
    fields array<struct<name: string, value: double, page: int, ambiguous: boolean, note: string>>"""
TEXT = "doc_id string, pages array<string>"
CLAIMS = """fields array<struct<name: string, value: double, unit_scale: double, currency: string, page: int, quote: string, confidence: double>>,
    latency_s double"""
CLAIM_KEYS = ("name", "value", "unit_scale", "currency", "page", "quote", "confidence")
#: One claim per row, as verification and scoring read it.
CLAIM_ROWS = "doc_id string, pos int, name string, value double, unit_scale double, currency string, page int, quote string, confidence double"
#: One document per row, as an extractor gives it: what it claims, and what that took.
EXTRACTIONS = """doc_id string, extractor string, model string, latency_s double, input_tokens bigint, output_tokens bigint, cost_usd double, retries int, error string,
    fields array<struct<pos: int, name: string, value: double, unit_scale: double, currency: string, page: int, quote: string, confidence: double>>"""


def line_items(spark: SparkSession) -> DataFrame:
    """The 8-row dimension of line items."""
    return spark.createDataFrame([(n, i, n in MAGNITUDE_ITEMS) for i, n in enumerate(ITEMS)], "name string, ordinal int, is_magnitude boolean")
