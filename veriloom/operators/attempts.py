"""Attempts of model extractors: what is accepted, and what they cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accept_first(attempts: DataFrame) -> DataFrame:
    """Of admitted claims (doc_id, name, attempt, ...), those of the first attempt that had one."""
    rest = [c for c in attempts.columns if c not in ("doc_id", "name")]
    return attempts.groupBy("doc_id", "name").agg(F.min_by(F.struct(*rest), "attempt").alias("x")).select("doc_id", "name", "x.*")


def totals(attempts: DataFrame, by: str = "doc_id") -> DataFrame:
    """Calls, tokens and cost over all attempts."""
    return attempts.groupBy(by).agg(F.count("*").alias("calls"), *(F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cost_usd")))


def price(input_tokens: int, output_tokens: int, cache_read_tokens: int, cache_write_tokens: int, usd_in: float, usd_out: float) -> float:
    """`cost`, for one document at hand."""
    return (input_tokens * usd_in + output_tokens * usd_out + cache_read_tokens * usd_in * 0.1 + cache_write_tokens * usd_in * 1.25) / 1_000_000


def cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """`calls` with cost_usd; `prices` has model and USD per million tokens in and out. Reading from a cache costs a tenth of
    the input price, writing to it a quarter more. A model without a price costs 0."""
    priced = calls.join(prices.withColumnsRenamed({"input": "_in", "output": "_out"}), "model", "left")
    total = F.col("input_tokens") * F.col("_in") + F.col("output_tokens") * F.col("_out") + F.col("cache_read_tokens") * F.col("_in") * 0.1 + F.col("cache_write_tokens") * F.col("_in") * 1.25
    return priced.withColumn("cost_usd", F.coalesce(total / 1_000_000, F.lit(0.0))).drop("_in", "_out")


def latency(runs: DataFrame, *by: str) -> DataFrame:
    """Median seconds and cost per document; null when there are none."""
    return runs.groupBy(*by).agg(F.median("latency_s").alias("latency_p50"), F.try_divide(F.sum("cost_usd"), F.count("*").cast("double")).alias("cost_per_document"))
