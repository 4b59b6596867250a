"""Scoring: claims against golden labels, the six outcomes, and rates that are undefined on an empty denominator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriloom.functions.columns import numbers_match
from veriloom.schemas import OUTCOMES, RATES

COUNTERS = ("n_fields", "n_answerable", "n_unanswerable", "n_attempted", "n_abstained", "n_attempted_answerable", "n_grounded_true", "n_justified_abstentions")


def first_claims(claims: DataFrame) -> DataFrame:
    """Of a document's claims on one item, the first by `pos`."""
    first = Window.partitionBy("doc_id", "name").orderBy("pos")
    return claims.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")


def outcome(actual: Column, grounded: Column, expected: Column) -> Column:
    """Abstained before ungrounded before hallucinated before right or wrong; an unverified claim is not ungrounded."""
    return (
        F.when(actual.isNull(), F.when(expected.isNull(), "correct_abstention").otherwise("omission"))
        .when(F.coalesce(grounded, F.lit(True)) == F.lit(False), "ungrounded")
        .when(expected.isNull(), "hallucination")
        .when(numbers_match(actual, expected), "correct")
        .otherwise("mismatch")
    )


#: What a scored field carries along for an audit, where its sides have it.
_NOTES, _EVIDENCE = ("note", "pos"), ("value", "unit_scale", "currency", "page", "quote")


def score_fields(golden: DataFrame, claims: DataFrame) -> DataFrame:
    """A row for each golden field (doc_id, name, expected, ambiguous): its first claim, scaled, and the outcome.

    Golden labels drive: claims on other fields are ignored, missing ones are abstentions. `claims` has doc_id, name, pos,
    value, unit_scale, grounded and confidence. The label's note and place and the claim's own value, scale, currency, page and
    quote stay on the row (as raw_value, unit_scale, ...), where there are such columns.
    """
    evidence = [F.col(c).alias("raw_value" if c == "value" else c) for c in _EVIDENCE if c in claims.columns]
    own = first_claims(claims).select("doc_id", "name", (F.col("value") * F.col("unit_scale")).alias("actual"), "grounded", "confidence", *evidence)
    notes = [c for c in _NOTES if c in golden.columns]
    scored = golden.select("doc_id", "name", "expected", "ambiguous", *notes).join(own, ["doc_id", "name"], "left")
    return with_outcome(scored)


def with_outcome(fields: DataFrame) -> DataFrame:
    return fields.withColumn("outcome", outcome(F.col("actual"), F.col("grounded"), F.col("expected")))


def counters() -> list[Column]:
    """The eight counters and the six outcomes, in one pass."""
    answerable, abstained = F.col("expected").isNotNull(), F.col("actual").isNull()
    conditions = {
        "n_fields": F.lit(True), "n_answerable": answerable, "n_unanswerable": ~answerable, "n_attempted": ~abstained, "n_abstained": abstained,
        "n_attempted_answerable": ~abstained & answerable, "n_grounded_true": ~abstained & F.coalesce("grounded", F.lit(False)),
        "n_justified_abstentions": abstained & (~answerable | F.col("ambiguous")),
    }
    return [*(F.count_if(c).alias(n) for n, c in conditions.items()), *(F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES)]


def rates() -> dict[str, Column]:
    """Rates over the counters; null where nothing could be counted."""
    over = {
        "accuracy": ("correct", "n_answerable"), "coverage": ("n_attempted_answerable", "n_answerable"), "grounding_rate": ("n_grounded_true", "n_attempted"),
        "hallucination_rate": ("hallucination", "n_unanswerable"), "omission_rate": ("omission", "n_answerable"), "ungrounded_rate": ("ungrounded", "n_attempted"),
        "abstention_precision": ("n_justified_abstentions", "n_abstained"),
    }
    return {name: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")) for name, (a, b) in over.items()}


def stats(fields: DataFrame, *by: str) -> DataFrame:
    """Counters and rates of all fields, or by some columns."""
    return fields.groupBy(*by).agg(*counters()).withColumns(rates())


def report(fields: DataFrame) -> DataFrame:
    """One row per scope: `overall`, `ambiguous`, and `field.<item>` for each item that has labels; micro-averaged.

    Each field goes to its three scopes and one aggregate does the rest, combining before the shuffle.
    """
    scopes = F.array_compact(F.array(F.lit("overall"), F.when(F.col("ambiguous"), "ambiguous"), F.concat(F.lit("field."), F.col("name"))))
    counted = stats(fields.withColumn("scope", F.explode(scopes)), "scope")
    always = fields.sparkSession.createDataFrame([("overall",), ("ambiguous",)], "scope string")
    missing = always.join(counted.select("scope"), "scope", "left_anti")
    return counted.unionByName(missing.select("scope", *(F.lit(0).cast("bigint").alias(c) for c in (*COUNTERS, *OUTCOMES)), *(F.lit(None).cast("double").alias(r) for r in RATES)))


def taxonomy(fields: DataFrame) -> DataFrame:
    """Each outcome with its count and share, in the fixed order, zeros included."""
    spark = fields.sparkSession
    dimension = spark.createDataFrame(list(enumerate(OUTCOMES)), "ordinal int, outcome string")
    counted = fields.groupBy("outcome").agg(F.count("*").alias("n"))
    total = fields.agg(F.count("*").alias("total"))
    joined = dimension.join(counted, "outcome", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint"))).crossJoin(F.broadcast(total))
    return joined.withColumn("share", F.try_divide(F.col("n").cast("double"), F.col("total").cast("double")))


def by_document(fields: DataFrame) -> DataFrame:
    return fields.groupBy("doc_id").agg(F.count("*").alias("n_fields"), *(F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES))


def document_grounding(fields: DataFrame) -> DataFrame:
    """Share of a document's claims that are grounded; 0 where nothing is claimed."""
    claimed = F.col("actual").isNotNull()
    share = F.try_divide(F.count_if(claimed & F.col("grounded")).cast("double"), F.count_if(claimed).cast("double"))
    return fields.groupBy("doc_id").agg(F.coalesce(share, F.lit(0.0)).alias("grounding_rate"))


def totals(extractions: DataFrame) -> DataFrame:
    """One row: documents, and what they took in all."""
    zero = lambda c, t: F.coalesce(F.sum(c), F.lit(0).cast(t)).alias(f"total_{c}")
    return extractions.agg(
        F.count("*").alias("n_documents"), zero("cost_usd", "double"), zero("latency_s", "double"), zero("input_tokens", "bigint"), zero("output_tokens", "bigint"), zero("retries", "bigint"))
