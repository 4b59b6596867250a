"""Selective answering: split-conformal thresholds, risk-coverage curves and their area.

Everything global is over distinct confidences or documents, aggregated before it meets in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Above every confidence: nothing is answered.
IMPOSSIBLE = 1.0 + 1e-9


def scored_items(fields: DataFrame) -> DataFrame:
    """Attempted fields as (doc_id, confidence, correct)."""
    return fields.where(F.col("actual").isNotNull()).select("doc_id", "confidence", (F.col("outcome") == "correct").alias("correct"))


def split_documents(documents: DataFrame, buckets: int = 200) -> DataFrame:
    """(doc_id, half): every other document, in order of id, calibrates (0) or tests (1).

    Positions are ranks within ranges of ids plus what lies in the ranges before, so the sort is not in one task. The ranges'
    edges come from a sample of some 20 ids each; which edges they are changes how even the tasks are, not the result.
    """
    ids = documents.select("doc_id").where("doc_id is not null").distinct()
    step = max(1, ids.count() // (20 * buckets))
    sample = sorted(r["doc_id"] for r in ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0).collect())
    edges = F.array(*map(F.lit, sample[19::20])) if len(sample) > 19 else None
    bucket = F.lit(0) if edges is None else F.size(F.filter(edges, lambda e: e <= F.col("doc_id")))
    ranged = ids.withColumn("bucket", bucket)
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("bucket").agg(F.count("*").alias("n")).select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    ranked = ranged.withColumn("k", F.row_number().over(Window.partitionBy("bucket").orderBy("doc_id")) - 1)
    return ranked.join(F.broadcast(offsets), "bucket").select("doc_id", ((F.col("k") + F.col("offset")) % 2).cast("int").alias("half"))


def _by_confidence(items: DataFrame, *by: str) -> DataFrame:
    """Items and wrong ones per confidence: all that the operators below need of them."""
    return items.groupBy(*by, "confidence").agg(F.count("*").alias("n"), F.count_if(~F.col("correct")).alias("wrong"))


def _share(a: str, b: str):
    return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))


def running(rows: DataFrame, order: str, sums: dict[str, str], down: bool = False, buckets: int = 64) -> DataFrame:
    """`rows` with running sums by `order`: each name in `sums` is the sum of a column up to and with the row.

    Rows are sorted and summed within ranges of `order`, and what lies in the ranges before is added, so no task holds them all
    unless all have one value. The ranges' edges are quantiles; which they are changes how even the tasks are, not the sums.
    """
    edges = rows.agg(F.percentile_approx(order, [i / buckets for i in range(1, buckets)], 10_000)).first()[0]
    edges = F.array(*map(F.lit, sorted(set(edges)))) if edges else None
    bucket = F.lit(0) if edges is None else F.size(F.filter(edges, lambda e: e <= F.col(order)))
    ranged = rows.withColumn("_bucket", -bucket if down else bucket)
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # over the ranges
    totals = ranged.groupBy("_bucket").agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    offsets = totals.select("_bucket", *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums))
    upto = Window.partitionBy("_bucket").orderBy(F.desc(order) if down else F.asc(order)).rowsBetween(Window.unboundedPreceding, 0)
    within = ranged.withColumns({n: F.sum(c).over(upto) for n, c in sums.items()})
    return within.join(F.broadcast(offsets), "_bucket").withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop("_bucket", *(f"_{n}" for n in sums))


def _curve(counts: DataFrame) -> DataFrame:
    answered = F.col("n_answered").cast("double")
    total = counts.agg(F.sum("n").alias("total"))
    summed = running(counts, "confidence", {"n_answered": "n", "errors": "wrong"}, down=True).crossJoin(F.broadcast(total))
    return summed.select("confidence", "n", "wrong", "n_answered", (answered / F.col("total")).alias("coverage"), (F.col("errors") / answered).alias("risk"), "errors", "total")


def _area(counts: DataFrame) -> DataFrame:
    """Trapezoids between neighbours on the curve; a row knows the point before it from its own counts."""
    before, errors = F.col("n_answered") - F.col("n"), F.col("errors") - F.col("wrong")
    width, height = F.col("n") / F.col("total").cast("double"), (F.col("risk") + errors / before.cast("double")) / 2
    return _curve(counts).agg(F.coalesce(F.sum(F.when(before > 0, width * height)), F.lit(0.0)).alias("aurc"))


def _threshold(counts: DataFrame, alpha: float) -> DataFrame:
    if not 0.0 < alpha < 1.0:
        raise ValueError(f"alpha must lie between 0 and 1, not {alpha!r}")
    scores = counts.where("n > wrong").groupBy((F.lit(1.0) - F.col("confidence")).alias("score")).agg(F.sum(F.col("n") - F.col("wrong")).alias("m"))
    reached = running(scores, "score", {"upto": "m"})
    n = scores.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n_correct")).withColumn("k", F.ceil((F.col("n_correct") + 1) * (F.lit(1.0) - F.lit(alpha))).cast("bigint"))
    at = n.join(reached, F.col("upto") >= F.col("k"), "left").groupBy("n_correct", "k").agg(F.min("score").alias("score"))
    return at.select("n_correct", "k", F.coalesce(F.lit(1.0) - F.col("score"), F.lit(IMPOSSIBLE)).alias("threshold"))


def _evaluate(counts: DataFrame, cut: DataFrame, alpha: float) -> DataFrame:
    above = F.col("confidence") >= F.col("threshold")
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    summed = cut.select("threshold").join(counts, F.lit(True), "left").groupBy("threshold").agg(
        total(F.col("n")).alias("n_total"), total(F.when(above, F.col("n"))).alias("n_answered"), total(F.when(above, F.col("wrong"))).alias("errors"))
    rated = summed.withColumns({"coverage": _share("n_answered", "n_total"), "error_on_answered": _share("errors", "n_answered")})
    return rated.withColumn("guarantee_held", F.col("error_on_answered") <= alpha)


def risk_coverage(items: DataFrame) -> DataFrame:
    """(confidence, n_answered, coverage, risk) for each distinct confidence, answering it and everything above."""
    return _curve(_by_confidence(items)).select("confidence", "n_answered", "coverage", "risk")


def aurc(items: DataFrame) -> DataFrame:
    """The area under the curve by trapezoids; 0 for fewer than two points."""
    return _area(_by_confidence(items))


def threshold(calibration: DataFrame, alpha: float = 0.1) -> DataFrame:
    """(n_correct, k, threshold): 1 minus the k-th smallest of 1 - confidence over correct items, k = ceil((n+1)(1-alpha)).

    The k-th value comes from running counts over distinct confidences.
    """
    return _threshold(_by_confidence(calibration), alpha)


def evaluate(test: DataFrame, cut: DataFrame, alpha: float = 0.1) -> DataFrame:
    """(n_total, n_answered, coverage, error_on_answered, guarantee_held) at the one threshold of `cut`; zeros when empty."""
    return _evaluate(_by_confidence(test), cut, alpha)


def summarise(fields: DataFrame, alpha: float = 0.1) -> DataFrame:
    """One row: sizes, threshold, operating point on the test half, area and baseline error over all items.

    Items are read once, into counts per half and confidence, which are kept: the rest reads only those.
    """
    counts = _by_confidence(scored_items(fields).join(split_documents(fields), "doc_id"), "half").persist()
    whole = counts.groupBy("confidence").agg(F.sum("n").alias("n"), F.sum("wrong").alias("wrong"))
    cut = _threshold(counts.where("half = 0"), alpha)
    point = _evaluate(counts.where("half = 1"), cut, alpha).select("coverage", "error_on_answered", "guarantee_held", F.col("n_total").alias("n_test"))
    base = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_items"), F.coalesce(F.sum("wrong"), F.lit(0)).alias("n_wrong"), F.count_distinct("confidence").alias("n_distinct_confidences"),
        F.coalesce(F.sum(F.when(F.col("half") == 0, F.col("n"))), F.lit(0)).alias("n_calibration"))
    base = base.withColumn("baseline_error", _share("n_wrong", "n_items")).drop("n_wrong")
    joined = base.crossJoin(cut.select(F.col("n_correct").alias("n_calibration_correct"), "threshold")).crossJoin(point).crossJoin(_area(whole))
    return joined.withColumns({"threshold_supported": F.col("threshold") < IMPOSSIBLE, "aurc_is_informative": F.col("n_distinct_confidences") >= 4, "alpha": F.lit(alpha)})


def least_calibration(alpha: Column) -> Column:
    """The fewest correct calibration items that can carry `alpha`."""
    return F.greatest(F.lit(1), F.ceil((F.lit(1.0) - alpha) / alpha)).cast("bigint")
