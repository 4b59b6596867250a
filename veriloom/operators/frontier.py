"""Which configurations are worth their cost. A configuration is a row with `accuracy` and `cost`."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriloom.operators.scoring import stats
from veriloom.schemas import RATES


def pareto(rows: DataFrame, *by: str) -> DataFrame:
    """Rows that no other row of their group beats on both: as accurate and no dearer, and better in one. Rows without an
    accuracy or a cost are left out, equal rows stay together.

    A skyline by one sort instead of a self-join: in order of cost, a row stays if it is the most accurate of its cost and
    more accurate than everything cheaper. Distinct (cost, accuracy) pairs are enough for that, and of those what lies behind
    some cheaper one of its own range of costs is gone before a group's pairs are sorted together.
    """
    known = rows.where("accuracy is not null and cost is not null")
    kept = _rising(_rising(known.groupBy(*by, "cost").agg(F.max("accuracy").alias("accuracy")), "_range", *by), None, *by)
    return known.join(kept, [*by, "cost", "accuracy"], "left_semi")


def _rising(best: DataFrame, part: str | None, *by: str) -> DataFrame:
    """Pairs that are more accurate than every cheaper one of their group, or of their part of it."""
    if part:  # costs of like size: some 100 parts a factor of ten, whatever their number
        best = best.withColumn(part, F.when(F.col("cost") > 0, F.floor(F.log10("cost") * 100)).otherwise(F.lit(-(2**31))))
    cheaper = Window.partitionBy(*by, *([part] if part else [])).orderBy("cost").rowsBetween(Window.unboundedPreceding, -1)
    return best.withColumn("_top", F.max("accuracy").over(cheaper)).where("_top is null or accuracy > _top").drop("_top", *([part] if part else []))


def best(rows: DataFrame) -> DataFrame:
    """The most accurate row, of equals the one with the smallest label; none of rows without an accuracy."""
    return rows.where("accuracy is not null").orderBy(F.desc("accuracy"), "label").limit(1)


def near_best(rows: DataFrame, share: float = 0.9, cost_share: float = 0.5) -> DataFrame:
    """Rows that reach `share` of the best accuracy at `cost_share` of its cost: label, best, accuracy_share, cost_share."""
    top = best(rows).select(F.struct("label", "accuracy", "cost").alias("top"))
    pairs = rows.crossJoin(F.broadcast(top)).where((F.col("label") != F.col("top.label")) & (F.col("cost") != 0) & (F.col("top.cost") != 0))
    shares = pairs.select("label", F.col("top.label").alias("best"), F.coalesce(F.try_divide("accuracy", "top.accuracy"), F.lit(0.0)).alias("accuracy_share"), (F.col("cost") / F.col("top.cost")).alias("cost_share"))
    return shares.where((F.col("accuracy_share") >= share) & (F.col("cost_share") <= cost_share))


def sweep(fields: DataFrame, runs: DataFrame, by: str = "label") -> DataFrame:
    """A row for each configuration: its rates over `fields` (scored, with the configuration in `by`), and from `runs` (a row a
    document) the cost of a document, the median latency and the retries; and whether it is on the frontier."""
    rates = stats(fields, by)
    took = runs.groupBy(by).agg(
        F.count("*").alias("n_documents"), F.try_divide(F.sum("cost_usd"), F.count("*").cast("double")).alias("cost"), F.median("latency_s").alias("latency_p50"), F.sum("retries").alias("retries"))
    rows = rates.select(F.col(by).alias("label"), "n_fields", *RATES).join(took.withColumnRenamed(by, "label"), "label", "left")
    edge = pareto(rows).select("label", F.lit(True).alias("on_frontier"))
    return rows.join(edge, "label", "left").withColumn("on_frontier", F.coalesce("on_frontier", F.lit(False)))
