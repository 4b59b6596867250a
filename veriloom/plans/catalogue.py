"""The engine's operators on the standard tables, each as a query and as the SQL that must give the same rows.

Claims over `events`: of each (user, event type) the first event; its value is the truth unless the id says otherwise, and
the claim is off, absent or unverified by the id. Ratios over `customer` and `orders`: eight line items per customer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.functions import columns as C
from veriloom.functions import kernels
from veriloom.operators import attempts, containment, frontier, gate, ratios, scoring, selective, verify
from veriloom.operators.extract import Heuristic
from veriloom.schemas import ITEMS, OUTCOMES, RATES, RATIO_OUTCOMES
from veriloom.sources import corpus, imports, writers
from veriloom.sources.scratch import scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL where there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _r(x: Column) -> Column:
    return F.round(x, 9)


# claims over events

CLAIMS = """
    e AS (SELECT user_id, event_type, event_id, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
                 row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events),
    c AS (SELECT user_id AS doc_id, event_type AS name, event_id, k, CASE WHEN event_id % 6 = 0 THEN NULL ELSE value * 1000 END AS expected,
                 event_id % 7 = 0 AS ambiguous,
                 CASE WHEN event_id % 5 = 0 THEN NULL ELSE value * 1000 * (1 + ((event_id % 5) - 2) * CAST(0.006 AS DOUBLE)) END AS actual,
                 CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 11 <> 0 END AS grounded, CAST(k AS DOUBLE) / 100 AS confidence
          FROM e WHERE rn = 1),
    s AS (SELECT *, CASE WHEN actual IS NULL THEN CASE WHEN expected IS NULL THEN 'correct_abstention' ELSE 'omission' END
                         WHEN grounded = FALSE THEN 'ungrounded' WHEN expected IS NULL THEN 'hallucination'
                         WHEN abs(actual - expected) <= 1 OR abs(actual - expected) <= CAST(0.01 AS DOUBLE) * greatest(abs(actual), abs(expected)) THEN 'correct'
                         ELSE 'mismatch' END AS outcome FROM c)"""
ITEMS_SQL = "i AS (SELECT doc_id, confidence, outcome = 'correct' AS correct FROM s WHERE actual IS NOT NULL)"
HALVES_SQL = """
    d AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) % 2 AS half FROM (SELECT DISTINCT doc_id FROM s)),
    h AS (SELECT i.*, d.half FROM i JOIN d USING (doc_id))"""
CUT_SQL = """
    o AS (SELECT CAST(1 AS DOUBLE) - confidence AS score, row_number() OVER (ORDER BY CAST(1 AS DOUBLE) - confidence) AS place FROM h WHERE half = 0 AND correct),
    n AS (SELECT count(*) AS n_correct, CAST(ceil((count(*) + 1) * (CAST(1 AS DOUBLE) - CAST(0.1 AS DOUBLE))) AS BIGINT) AS k FROM o),
    t AS (SELECT n_correct, k, coalesce(CAST(1 AS DOUBLE) - (SELECT score FROM o WHERE place = k), CAST(1.000000001 AS DOUBLE)) AS threshold FROM n)"""
CURVE_SQL = """
    g AS (SELECT confidence, count(*) AS n, count(*) FILTER (NOT correct) AS wrong FROM i GROUP BY 1),
    r AS (SELECT confidence, CAST(sum(n) OVER w AS BIGINT) AS n_answered, CAST(sum(wrong) OVER w AS DOUBLE) AS errors, CAST(sum(n) OVER () AS DOUBLE) AS total
          FROM g WINDOW w AS (ORDER BY confidence DESC ROWS UNBOUNDED PRECEDING)),
    v AS (SELECT confidence, n_answered, n_answered / total AS coverage, errors / n_answered AS risk FROM r),
    z AS (SELECT coverage, risk, lag(coverage) OVER (ORDER BY coverage) AS c0, lag(risk) OVER (ORDER BY coverage) AS r0 FROM v),
    a AS (SELECT coalesce(sum((coverage - c0) * (risk + r0) / 2), 0) AS aurc FROM z)"""
_COUNTS = {
    "n_fields": "TRUE", "n_answerable": "expected IS NOT NULL", "n_unanswerable": "expected IS NULL", "n_attempted": "actual IS NOT NULL", "n_abstained": "actual IS NULL",
    "n_attempted_answerable": "actual IS NOT NULL AND expected IS NOT NULL", "n_grounded_true": "actual IS NOT NULL AND grounded",
    "n_justified_abstentions": "actual IS NULL AND (expected IS NULL OR ambiguous)",
}
COUNT_SQL = ", ".join([*(f"count(*) FILTER ({c}) AS {n}" for n, c in _COUNTS.items()), *(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in OUTCOMES)])
RATE_SQL = ", ".join(
    f"round(CAST({a} AS DOUBLE) / nullif({b}, 0), 9) AS {n}" for n, a, b in (
        ("accuracy", "correct", "n_answerable"), ("coverage", "n_attempted_answerable", "n_answerable"), ("grounding_rate", "n_grounded_true", "n_attempted"),
        ("hallucination_rate", "hallucination", "n_unanswerable"), ("omission_rate", "omission", "n_answerable"), ("ungrounded_rate", "ungrounded", "n_attempted"),
        ("abstention_precision", "n_justified_abstentions", "n_abstained")))
REPORT_SQL = f"""
    p AS (SELECT 'overall' AS scope, * FROM s UNION ALL SELECT 'ambiguous', * FROM s WHERE ambiguous UNION ALL SELECT 'field.' || name, * FROM s),
    rc AS (SELECT scope, {COUNT_SQL} FROM p GROUP BY scope)"""


def _events(spark: SparkSession, sf: str) -> DataFrame:
    rows = _table(spark, sf, "events").select("user_id", "event_type", "event_id", "value", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    first = rows.groupBy("user_id", "event_type").agg(F.min(F.struct("event_id", "value", "k")).alias("e")).select("user_id", "event_type", "e.*")
    i, v = F.col("event_id"), F.col("value") * 1000
    return first.select(
        F.col("user_id").alias("doc_id"), F.col("event_type").alias("name"), i.alias("event_id"), "k", F.when(i % 6 != 0, v).alias("expected"), (i % 7 == 0).alias("ambiguous"),
        F.when(i % 5 != 0, v * (1 + ((i % 5) - 2) * F.lit(0.006))).alias("actual"), F.when(i % 5 != 0, i % 11 != 0).alias("grounded"), (F.col("k").cast("double") / 100).alias("confidence"))


def _fields(spark: SparkSession, sf: str) -> DataFrame:
    """Golden labels joined to claims, as in a run."""
    e = _events(spark, sf)
    return scoring.with_outcome(e)


@query(f"""WITH {CLAIMS} SELECT doc_id, name, round(expected, 6) AS expected, ambiguous, round(actual, 6) AS actual, grounded, confidence, outcome, 'note ' || event_id AS note,
    round(actual / CASE WHEN event_id % 2 = 0 THEN 1000 ELSE 1 END, 6) AS raw_value, CASE WHEN event_id % 2 = 0 THEN 1000::DOUBLE ELSE 1::DOUBLE END AS unit_scale, CAST(event_id % 4 AS INTEGER) AS page, 'quote ' || k AS quote FROM s""")
def field_scores(spark, sf):
    """Every other claim is in thousands; notes, pages and quotes stay on the row."""
    e = _events(spark, sf)
    i = F.col("event_id")
    golden = e.select("doc_id", "name", "expected", "ambiguous", F.concat(F.lit("note "), i.cast("string")).alias("note"))
    scale = F.when(i % 2 == 0, F.lit(1000.0)).otherwise(F.lit(1.0))
    claims = e.select(
        "doc_id", "name", F.lit(0).alias("pos"), (F.col("actual") / scale).alias("value"), scale.alias("unit_scale"), "grounded", "confidence", (i % 4).cast("int").alias("page"), F.concat(F.lit("quote "), F.col("k").cast("string")).alias("quote"))
    return scoring.score_fields(golden, claims).select(
        "doc_id", "name", F.round("expected", 6).alias("expected"), "ambiguous", F.round("actual", 6).alias("actual"), "grounded", "confidence", "outcome", "note", F.round("raw_value", 6).alias("raw_value"), "unit_scale", "page", "quote")


@query(f"WITH {CLAIMS} SELECT outcome, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM s) AS DOUBLE), 9) AS share FROM s GROUP BY outcome")
def taxonomy_counts(spark, sf):
    return scoring.taxonomy(_fields(spark, sf)).select("outcome", "n", _r(F.col("share")).alias("share"))


@query(f"WITH {CLAIMS}, k AS (SELECT {COUNT_SQL} FROM s) SELECT *, {RATE_SQL} FROM k")
def run_stats(spark, sf):
    return scoring.stats(_fields(spark, sf)).withColumns({r: _r(F.col(r)) for r in RATES})


@query(f"WITH {CLAIMS} SELECT doc_id, count(*) AS n_fields, {', '.join(f'''count(*) FILTER (outcome = '{o}') AS {o}''' for o in OUTCOMES)} FROM s GROUP BY doc_id")
def document_scores(spark, sf):
    return scoring.by_document(_fields(spark, sf))


@query(f"WITH {CLAIMS}, {REPORT_SQL} SELECT *, {RATE_SQL} FROM rc")
def report_grouping_sets(spark, sf):
    return scoring.report(_fields(spark, sf)).withColumns({r: _r(F.col(r)) for r in RATES})


@query(f"WITH {CLAIMS} SELECT doc_id, name, outcome FROM s WHERE outcome NOT IN ('correct', 'correct_abstention')")
def non_correct_fields(spark, sf):
    return _fields(spark, sf).where(~F.col("outcome").isin("correct", "correct_abstention")).select("doc_id", "name", "outcome")


@query(f"""WITH {CLAIMS} SELECT doc_id, name, coalesce(abs(actual - expected) <= 1 OR abs(actual - expected) <= CAST(0.01 AS DOUBLE) * greatest(abs(actual), abs(expected)), FALSE) AS scored,
    coalesce(abs(actual - expected) <= CAST(0.01 AS DOUBLE) * greatest(abs(actual), abs(expected)), FALSE) AS relative FROM s""")
def numbers_match(spark, sf):
    a, b = F.col("actual"), F.col("expected")
    return _events(spark, sf).select("doc_id", "name", C.numbers_match(a, b).alias("scored"), C.numbers_match(a, b, absolute=0.0).alias("relative"))


@query(f"WITH {CLAIMS} SELECT doc_id, round(coalesce(CAST(count(*) FILTER (actual IS NOT NULL AND grounded) AS DOUBLE) / nullif(count(actual), 0), 0), 9) AS grounding_rate FROM s GROUP BY doc_id")
def doc_grounding_rate(spark, sf):
    return scoring.document_grounding(_fields(spark, sf)).withColumn("grounding_rate", _r(F.col("grounding_rate")))


@query("""WITH e AS (SELECT user_id AS doc_id, event_type AS name, event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events)
    SELECT doc_id, name, event_id AS pos, round(value, 9) AS value FROM e WHERE rn = 1""")
def first_claim(spark, sf):
    rows = _table(spark, sf, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("name"), F.col("event_id").alias("pos"), "value")
    return scoring.first_claims(rows).select("doc_id", "name", "pos", _r(F.col("value")).alias("value"))


@query(f"WITH {CLAIMS}, {ITEMS_SQL}, {HALVES_SQL} SELECT doc_id, CAST(half AS INTEGER) AS half FROM d")
def doc_split(spark, sf):
    return selective.split_documents(_fields(spark, sf))


@query(f"WITH {CLAIMS}, {ITEMS_SQL}, {HALVES_SQL}, {CUT_SQL} SELECT n_correct, k, round(threshold, 12) AS threshold FROM t")
def conformal_threshold(spark, sf):
    fields = _fields(spark, sf)
    halves = selective.scored_items(fields).join(selective.split_documents(fields), "doc_id")
    return selective.threshold(halves.where("half = 0")).withColumn("threshold", F.round("threshold", 12))


@query(f"""WITH {CLAIMS}, {ITEMS_SQL}, {HALVES_SQL}, {CUT_SQL}, p AS (
    SELECT count(*) AS n_total, count(*) FILTER (confidence >= threshold) AS n_answered, count(*) FILTER (confidence >= threshold AND NOT correct) AS errors FROM h, t WHERE half = 1)
    SELECT n_total, n_answered, round(coalesce(n_answered / nullif(CAST(n_total AS DOUBLE), 0), 0), 9) AS coverage,
    round(coalesce(errors / nullif(CAST(n_answered AS DOUBLE), 0), 0), 9) AS error_on_answered, coalesce(errors / nullif(CAST(n_answered AS DOUBLE), 0), 0) <= CAST(0.1 AS DOUBLE) AS guarantee_held FROM p""")
def conformal_evaluate(spark, sf):
    fields = _fields(spark, sf)
    halves = selective.scored_items(fields).join(selective.split_documents(fields), "doc_id")
    point = selective.evaluate(halves.where("half = 1"), selective.threshold(halves.where("half = 0")))
    return point.select("n_total", "n_answered", _r(F.col("coverage")).alias("coverage"), _r(F.col("error_on_answered")).alias("error_on_answered"), "guarantee_held")


@query(f"WITH {CLAIMS}, {ITEMS_SQL}, {CURVE_SQL} SELECT confidence, n_answered, round(coverage, 9) AS coverage, round(risk, 9) AS risk FROM v")
def risk_coverage_curve(spark, sf):
    return selective.risk_coverage(selective.scored_items(_fields(spark, sf))).withColumns({"coverage": _r(F.col("coverage")), "risk": _r(F.col("risk"))})


@query(f"WITH {CLAIMS}, {ITEMS_SQL}, {CURVE_SQL} SELECT round(aurc, 9) AS aurc FROM a")
def aurc(spark, sf):
    return selective.aurc(selective.scored_items(_fields(spark, sf))).select(_r(F.col("aurc")).alias("aurc"))


@query(f"""WITH {CLAIMS}, {ITEMS_SQL}, {HALVES_SQL}, {CUT_SQL}, {CURVE_SQL}, p AS (
    SELECT count(*) AS n_test, count(*) FILTER (confidence >= threshold) AS n_answered, count(*) FILTER (confidence >= threshold AND NOT correct) AS errors FROM h, t WHERE half = 1),
    b AS (SELECT count(*) AS n_items, count(*) FILTER (NOT correct) / CAST(count(*) AS DOUBLE) AS baseline_error, count(DISTINCT confidence) AS n_distinct_confidences FROM i)
    SELECT n_items, (SELECT count(*) FROM h WHERE half = 0) AS n_calibration, n_correct AS n_calibration_correct, n_test, round(threshold, 12) AS threshold,
    round(coalesce(n_answered / nullif(CAST(n_test AS DOUBLE), 0), 0), 9) AS coverage, round(coalesce(errors / nullif(CAST(n_answered AS DOUBLE), 0), 0), 9) AS error_on_answered,
    round(baseline_error, 9) AS baseline_error, round(aurc, 9) AS aurc, n_distinct_confidences, n_distinct_confidences >= 4 AS aurc_is_informative,
    threshold < 1.000000001 AS threshold_supported FROM t, p, b, a""")
def selective_summary(spark, sf):
    s = selective.summarise(_fields(spark, sf))
    rounded = {c: _r(F.col(c)) for c in ("coverage", "error_on_answered", "baseline_error", "aurc")}
    return s.withColumns(rounded).withColumn("threshold", F.round("threshold", 12)).drop("alpha", "guarantee_held")


@query("SELECT a / 100.0::DOUBLE AS alpha, CAST(greatest(1, ceil((CAST(1 AS DOUBLE) - a / 100.0::DOUBLE) / (a / 100.0::DOUBLE))) AS BIGINT) AS least FROM range(1, 100) t(a)")
def min_calibration(spark, sf):
    alpha = F.col("id") / F.lit(100.0)
    return spark.range(1, 100).select(alpha.alias("alpha"), selective.least_calibration(alpha).alias("least"))


# ratios over customers

_M = "(1 + ((c_custkey % 4) - 1) * CAST(0.008 AS DOUBLE))"
RATIO_SQL = f"""
    cu AS (SELECT c_custkey AS doc_id, c_custkey AS c_custkey, c_acctbal AS ab, CAST(sum(o_totalprice) AS DOUBLE) AS r FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2, 3),
    gi AS (SELECT doc_id, 'golden' AS side, r AS revenue, CASE WHEN c_custkey % 7 <> 0 THEN 10 * ab END AS ebitda, CASE WHEN c_custkey % 3 <> 0 THEN CAST(500 AS DOUBLE) END AS addbacks,
                  CASE WHEN c_custkey % 11 <> 0 THEN 0.5::DOUBLE * r END AS debt, CASE WHEN c_custkey % 4 <> 0 THEN abs(ab) END AS cash, CASE WHEN c_custkey % 13 <> 0 THEN 0.02::DOUBLE * r END AS interest,
                  CASE WHEN c_custkey % 5 <> 0 THEN 0.03::DOUBLE * r END AS principal, CASE WHEN c_custkey % 2 <> 0 THEN 0.1::DOUBLE * r END AS cfads, FALSE AS debt_bad, FALSE AS cfads_bad FROM cu),
    xi AS (SELECT doc_id, 'extracted', r * {_M}, CASE WHEN c_custkey % 6 <> 0 THEN 10 * ab * {_M} END, CASE WHEN c_custkey % 3 <> 0 THEN CAST(500 AS DOUBLE) END,
                  CASE WHEN c_custkey % 10 <> 0 THEN 0.5::DOUBLE * r END, CASE WHEN c_custkey % 4 <> 0 THEN abs(ab) END,
                  CASE WHEN c_custkey % 13 <> 0 THEN 0.02::DOUBLE * r * CASE WHEN c_custkey % 23 = 0 THEN -1 ELSE 1 END END, CASE WHEN c_custkey % 5 <> 0 THEN 0.03::DOUBLE * r END,
                  CASE WHEN c_custkey % 2 <> 0 THEN 0.1::DOUBLE * r * {_M} END, c_custkey % 17 = 0, c_custkey % 19 = 0 FROM cu),
    al AS (SELECT * FROM gi UNION ALL SELECT * FROM xi),
    ae AS (SELECT *, ebitda + coalesce(addbacks, 0) AS adj FROM al),
    rv AS (SELECT doc_id, side, 'ltm_revenue' AS ratio, revenue AS value FROM ae
           UNION ALL SELECT doc_id, side, 'adjusted_ebitda', adj FROM ae
           UNION ALL SELECT doc_id, side, 'leverage', CASE WHEN NOT debt_bad AND adj > 0 THEN (debt - coalesce(cash, 0)) / adj END FROM ae
           UNION ALL SELECT doc_id, side, 'dscr', CASE WHEN NOT cfads_bad AND interest >= 0 AND principal >= 0 AND interest + principal > 0 THEN coalesce(cfads, adj) / (interest + principal) END FROM ae),
    cm AS (SELECT x.doc_id, x.ratio, x.value AS extracted, g.value AS expected,
                  CASE WHEN x.value IS NULL AND g.value IS NULL THEN 'both_abstained' WHEN x.value IS NULL THEN 'extraction_abstained' WHEN g.value IS NULL THEN 'golden_abstained'
                       WHEN abs(x.value - g.value) <= CAST(0.01 AS DOUBLE) * greatest(abs(x.value), abs(g.value)) THEN 'agree' ELSE 'disagree' END AS outcome
           FROM rv x JOIN rv g ON x.doc_id = g.doc_id AND x.ratio = g.ratio AND x.side = 'extracted' AND g.side = 'golden')"""


def _ratio_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Wide inputs of both sides: extracted and golden."""
    spent = _table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.sum("o_totalprice").alias("r"))
    base = _table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_acctbal").alias("ab")).join(spent, "doc_id", "left")
    k, r, ab = F.col("doc_id"), F.col("r"), F.col("ab")
    m = 1 + ((k % 4) - 1) * F.lit(0.008)
    but = lambda n, v: F.when(k % n != 0, v)
    common = {"ebitda_addbacks": but(3, F.lit(500.0)), "cash": but(4, F.abs(ab)), "principal_repayments": but(5, 0.03 * r)}
    golden = {"revenue_ltm": r, "ebitda_reported": but(7, 10 * ab), "total_debt": but(11, 0.5 * r), "interest_expense": but(13, 0.02 * r), "cfads": but(2, 0.1 * r)}
    extracted = {
        "revenue_ltm": r * m, "ebitda_reported": but(6, 10 * ab * m), "total_debt": but(10, 0.5 * r),
        "interest_expense": but(13, 0.02 * r * F.when(k % 23 == 0, -1).otherwise(1)), "cfads": but(2, 0.1 * r * m)}
    bad = {"total_debt": k % 17 == 0, "cfads": k % 19 == 0}
    sides = []
    for values, rejected in ((extracted | common, bad), (golden | common, {})):
        wide = base.select("doc_id", *(values[i].alias(i) for i in ITEMS))
        sides.append(wide.withColumns({f"{i}_status": ratios.status(F.col(i), rejected.get(i, F.lit(False))) for i in ITEMS}))
    return sides[0], sides[1]


_LEG = "CASE WHEN interest IS NULL THEN 'INTEREST_EXPENSE' END, CASE WHEN principal IS NULL THEN 'PRINCIPAL_REPAYMENTS' END"
_NEG = "CASE WHEN interest < 0 THEN 'INTEREST_EXPENSE' END, CASE WHEN principal < 0 THEN 'PRINCIPAL_REPAYMENTS' END"
REASON_SQL = f"""
    rs AS (SELECT *, CASE WHEN ebitda IS NULL THEN 'EBITDA_REPORTED is missing or abstained' WHEN addbacks IS NULL THEN 'EBITDA_ADDBACKS not disclosed; treated as 0' ELSE '' END AS why FROM ae),
    rn AS (SELECT doc_id, side, 'ltm_revenue' AS ratio, CASE WHEN revenue IS NULL THEN 'REVENUE_LTM is missing or abstained' ELSE '' END AS reason, CASE WHEN revenue IS NULL THEN '' ELSE 'revenue_ltm' END AS inputs FROM rs
        UNION ALL SELECT doc_id, side, 'adjusted_ebitda', why, CASE WHEN ebitda IS NULL THEN '' WHEN addbacks IS NULL THEN 'ebitda_reported' ELSE 'ebitda_reported,ebitda_addbacks' END FROM rs
        UNION ALL SELECT doc_id, side, 'leverage', CASE WHEN debt_bad THEN 'TOTAL_DEBT failed evidence verification (grounded=False) and is unusable' WHEN debt IS NULL THEN 'TOTAL_DEBT is missing or abstained'
            WHEN ebitda IS NULL THEN 'adjusted EBITDA unavailable: ' || why WHEN adj <= 0 THEN 'adjusted EBITDA is non-positive'
            ELSE concat_ws('; ', CASE WHEN cash IS NULL THEN 'CASH not disclosed; treated as 0' END, nullif(why, '')) END,
            CASE WHEN debt_bad OR debt IS NULL OR ebitda IS NULL OR adj <= 0 THEN '' ELSE concat_ws(',', 'total_debt', CASE WHEN cash IS NOT NULL THEN 'cash' END, 'ebitda_reported', CASE WHEN addbacks IS NOT NULL THEN 'ebitda_addbacks' END) END FROM rs
        UNION ALL SELECT doc_id, side, 'dscr', CASE WHEN cfads_bad THEN 'CFADS failed evidence verification (grounded=False) and is unusable'
            WHEN cfads IS NULL AND ebitda IS NULL THEN 'CFADS not disclosed and adjusted EBITDA proxy unavailable: ' || why
            WHEN interest IS NULL OR principal IS NULL THEN 'debt service not disclosed (' || concat_ws(', ', {_LEG}) || ' missing); assuming zero would overstate DSCR'
            WHEN interest < 0 OR principal < 0 THEN concat_ws(', ', {_NEG}) || ' is negative; debt service is stored as a positive magnitude, so this input cannot be netted into a ratio'
            WHEN interest + principal <= 0 THEN 'debt service is non-positive'
            WHEN cfads IS NULL THEN concat_ws('; ', 'CFADS not disclosed; adjusted EBITDA used as proxy', nullif(why, '')) ELSE '' END,
            CASE WHEN cfads_bad OR cfads IS NULL AND ebitda IS NULL OR interest IS NULL OR principal IS NULL OR interest < 0 OR principal < 0 OR interest + principal <= 0 THEN ''
            WHEN cfads IS NULL THEN concat_ws(',', 'ebitda_reported', CASE WHEN addbacks IS NOT NULL THEN 'ebitda_addbacks' END, 'interest_expense', 'principal_repayments') ELSE 'cfads,interest_expense,principal_repayments' END FROM rs)"""


@query(f"WITH {RATIO_SQL}, {REASON_SQL} SELECT rv.doc_id, side, ratio, round(value, 6) AS value, value IS NULL AS abstained, reason, inputs FROM rv JOIN rn USING (doc_id, side, ratio)")
def ratio_values(spark, sf):
    """The number that a refusal prints is left out here, as `%g` has no like in the SQL."""
    extracted, golden = _ratio_inputs(spark, sf)
    both = ratios.ratio_rows(extracted).withColumn("side", F.lit("extracted")).union(ratios.ratio_rows(golden).withColumn("side", F.lit("golden")))
    reason = F.regexp_replace("reason", r" \([-+.0-9e]+\); .*", "")
    return both.select("doc_id", "side", "ratio", F.round("value", 6).alias("value"), "abstained", reason.alias("reason"), F.array_join("inputs", ",").alias("inputs"))


@query(f"WITH {RATIO_SQL} SELECT doc_id, ratio, round(extracted, 6) AS extracted, round(expected, 6) AS expected, outcome FROM cm")
def ratio_comparison(spark, sf):
    rows = ratios.compare(*_ratio_inputs(spark, sf))
    return rows.select("doc_id", "ratio", F.round("extracted", 6).alias("extracted"), F.round("expected", 6).alias("expected"), "outcome")


_RATIO_COUNTS = ", ".join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in RATIO_OUTCOMES)


@query(f"""WITH {RATIO_SQL} SELECT ratio, count(*) AS n_ratios, {_RATIO_COUNTS}, round(count(*) FILTER (outcome IN ('agree', 'both_abstained')) / CAST(count(*) AS DOUBLE), 9) AS agreement,
    round(count(*) FILTER (outcome IN ('agree', 'both_abstained', 'extraction_abstained')) / CAST(count(*) AS DOUBLE), 9) AS safety FROM cm GROUP BY ratio""")
def ratio_summary(spark, sf):
    return ratios.summary(ratios.compare(*_ratio_inputs(spark, sf)), "ratio").withColumns({c: _r(F.col(c)) for c in ("agreement", "safety")})


@query(f"WITH {RATIO_SQL} SELECT doc_id, ratio, outcome IN ('agree', 'both_abstained', 'extraction_abstained') AS safe FROM cm")
def ratio_safety(spark, sf):
    return ratios.compare(*_ratio_inputs(spark, sf)).select("doc_id", "ratio", F.col("outcome").isin("agree", "both_abstained", "extraction_abstained").alias("safe"))


@query("""SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 2 = 0 THEN 'interest_expense' ELSE 'cash' END AS name,
    CASE WHEN c_custkey % 2 = 0 THEN abs(c_acctbal) ELSE c_acctbal END AS value, CASE WHEN c_custkey % 5 - 1 > 0 THEN CAST(c_custkey % 5 - 1 AS DOUBLE) ELSE 1 END AS unit_scale FROM customer""")
def magnitude_normalise(spark, sf):
    k = F.col("c_custkey")
    rows = _table(spark, sf, "customer").select(k.alias("doc_id"), F.when(k % 2 == 0, "interest_expense").otherwise("cash").alias("name"), "c_acctbal", (k % 5 - 1).cast("double").alias("s"))
    return rows.select("doc_id", "name", C.magnitude(F.col("name"), F.col("c_acctbal")).alias("value"), C.positive_scale(F.col("s")).alias("unit_scale"))


# metrics, gate, cost

METRIC_SQL = f"""
    {REPORT_SQL}, rr AS (SELECT scope, {RATE_SQL} FROM rc),
    u AS (UNPIVOT rr ON {', '.join(RATES)} INTO NAME rate VALUE value),
    gr AS (SELECT scope, unnest([{', '.join(f"'{r}'" for r in RATES)}]) AS rate FROM rr),
    m1 AS (SELECT CASE WHEN gr.scope = 'overall' THEN gr.rate ELSE gr.scope || '.' || gr.rate END AS metric, u.value FROM gr LEFT JOIN u ON u.scope = gr.scope AND u.rate = gr.rate),
    cs AS (SELECT count(*) AS n, count(*) FILTER (outcome IN ('agree', 'both_abstained')) AS ag, count(*) FILTER (outcome IN ('agree', 'both_abstained', 'extraction_abstained')) AS sa FROM cm),
    ps AS (SELECT count(*) AS n_test, count(*) FILTER (confidence >= threshold) AS n_answered, count(*) FILTER (confidence >= threshold AND NOT correct) AS errors FROM h, t WHERE half = 1),
    m AS (SELECT metric, value FROM m1 UNION ALL SELECT 'ratio.agreement', round(ag / CAST(n AS DOUBLE), 9) FROM cs UNION ALL SELECT 'ratio.safety', round(sa / CAST(n AS DOUBLE), 9) FROM cs
          UNION ALL SELECT 'selective.aurc', round(aurc, 9) FROM a UNION ALL SELECT 'selective.coverage', round(coalesce(n_answered / nullif(CAST(n_test AS DOUBLE), 0), 0), 9) FROM ps
          UNION ALL SELECT 'selective.error_on_answered', round(coalesce(errors / nullif(CAST(n_answered AS DOUBLE), 0), 0), 9) FROM ps
          UNION ALL SELECT 'selective.baseline_error', round(count(*) FILTER (NOT correct) / CAST(count(*) AS DOUBLE), 9) FROM i)"""
_ALL_SQL = f"WITH {CLAIMS}, {ITEMS_SQL}, {HALVES_SQL}, {CUT_SQL}, {CURVE_SQL}, {RATIO_SQL}, {METRIC_SQL}"
LIMITS = [("accuracy", "min", 0.5), ("coverage", "min", 0.99), ("hallucination_rate", "max", 0.9), ("ambiguous.accuracy", "min", 0.1), ("ratio.safety", "min", 0.5), ("selective.aurc", "max", 0.1), ("field.cash.accuracy", "min", 0.5)]


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    fields = _fields(spark, sf).persist()
    values = gate.metrics(scoring.report(fields), ratios.summary(ratios.compare(*_ratio_inputs(spark, sf))), selective.summarise(fields))
    return values.withColumn("value", _r(F.col("value")))


@query(f"{_ALL_SQL} SELECT metric, value FROM m")
def metric_lookup(spark, sf):
    return _metrics(spark, sf)


@query(f"""{_ALL_SQL}, l(metric, direction, bound) AS (VALUES {', '.join(f"('{a}', '{b}', CAST({c} AS DOUBLE))" for a, b, c in LIMITS)}),
    q AS (SELECT l.*, m.value AS observed, CASE WHEN m.value IS NULL THEN 'undefined' WHEN CASE WHEN direction = 'min' THEN m.value >= bound ELSE m.value <= bound END THEN 'pass' ELSE 'fail' END AS status
          FROM l LEFT JOIN m USING (metric)) SELECT *, status = 'pass' AS passed FROM q""")
def gate_checks(spark, sf):
    limits = gate.threshold_table(spark, [(*x, "") for x in LIMITS])
    return gate.grade(_metrics(spark, sf), limits).select("metric", "direction", "bound", "observed", "status", "passed")


@query("SELECT event_type, median(value) AS latency_p50, sum(value) / count(*) AS cost_per_document FROM events GROUP BY event_type".replace("median(value)", "round(median(value), 9)").replace("sum(value) / count(*)", "round(sum(value) / count(*), 6)"))
def latency_p50(spark, sf):
    rows = _table(spark, sf, "events").select("event_type", F.col("value").alias("latency_s"), F.col("value").alias("cost_usd"))
    return attempts.latency(rows, "event_type").select("event_type", _r(F.col("latency_p50")).alias("latency_p50"), F.round("cost_per_document", 6).alias("cost_per_document"))


PRICES = [("click", 5.0, 25.0), ("view", 3.0, 15.0), ("purchase", 1.0, 5.0), ("scroll", 10.0, 50.0)]


@query(f"""WITH p(model, i, o) AS (VALUES {', '.join(f"('{m}', CAST({i} AS DOUBLE), CAST({o} AS DOUBLE))" for m, i, o in PRICES)})
    SELECT event_id, round(coalesce((event_id % 1000 * i + event_id % 300 * o + event_id % 50 * i * 0.1::DOUBLE + event_id % 20 * i * 1.25::DOUBLE) / 1000000, 0), 12) AS cost_usd
    FROM events LEFT JOIN p ON model = event_type""")
def estimate_cost(spark, sf):
    i = F.col("event_id")
    calls = _table(spark, sf, "events").select("event_id", F.col("event_type").alias("model"), (i % 1000).alias("input_tokens"), (i % 300).alias("output_tokens"), (i % 50).alias("cache_read_tokens"), (i % 20).alias("cache_write_tokens"))
    return attempts.cost(calls, spark.createDataFrame(PRICES, "model string, input double, output double")).select("event_id", F.round("cost_usd", 12).alias("cost_usd"))


@query("SELECT user_id AS doc_id, count(*) AS calls, CAST(sum(event_id % 1000) AS BIGINT) AS input_tokens, CAST(sum(event_id % 300) AS BIGINT) AS output_tokens, round(sum(value), 6) AS cost_usd FROM events GROUP BY 1")
def attempt_totals(spark, sf):
    i = F.col("event_id")
    rows = _table(spark, sf, "events").select(F.col("user_id").alias("doc_id"), (i % 1000).alias("input_tokens"), (i % 300).alias("output_tokens"), F.col("value").alias("cost_usd"))
    return attempts.totals(rows).withColumn("cost_usd", F.round("cost_usd", 6))


@query("""SELECT user_id AS doc_id, event_type AS name, min(event_id) AS attempt, round(arg_min(value, event_id), 9) AS value FROM events WHERE event_id % 3 <> 0 GROUP BY 1, 2""")
def retry_accept_first(spark, sf):
    rows = _table(spark, sf, "events").where("event_id % 3 <> 0").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("name"), F.col("event_id").alias("attempt"), "value")
    return attempts.accept_first(rows).withColumn("value", _r(F.col("value")))


_SWEEP_SQL = f"""{CLAIMS}, w0 AS (SELECT event_id % 8 AS label, {COUNT_SQL} FROM s GROUP BY 1), w AS (SELECT label, n_fields, {RATE_SQL} FROM w0),
    k AS (SELECT event_id % 8 AS label, sum(k) / CAST(count(*) AS DOUBLE) AS cost, median(CAST(k AS DOUBLE)) AS latency_p50, CAST(sum(event_id % 3) AS BIGINT) AS retries, count(*) AS n_documents FROM s GROUP BY 1),
    j AS (SELECT * FROM w JOIN k USING (label)),
    f AS (SELECT label FROM j a WHERE accuracy IS NOT NULL AND cost IS NOT NULL AND NOT EXISTS (
        SELECT 1 FROM j b WHERE b.accuracy >= a.accuracy AND b.cost <= a.cost AND (b.accuracy > a.accuracy OR b.cost < a.cost)))"""


def _sweep(spark: SparkSession, sf: str) -> DataFrame:
    fields = _fields(spark, sf).withColumn("label", F.col("event_id") % 8)
    runs = fields.select("label", F.col("k").cast("double").alias("cost_usd"), F.col("k").cast("double").alias("latency_s"), (F.col("event_id") % 3).alias("retries"))
    return frontier.sweep(fields, runs)


@query(f"""WITH {_SWEEP_SQL} SELECT label, n_fields, {', '.join(RATES)}, n_documents, round(cost, 9) AS cost, round(latency_p50, 9) AS latency_p50, retries,
    label IN (SELECT label FROM f) AS on_frontier FROM j""")
def sweep_rows(spark, sf):
    return _sweep(spark, sf).withColumns({c: _r(F.col(c)) for c in (*RATES, "cost", "latency_p50")})


@query(f"WITH {_SWEEP_SQL} SELECT label, accuracy FROM w ORDER BY accuracy DESC, label LIMIT 1")
def top_accuracy(spark, sf):
    return frontier.best(_sweep(spark, sf)).select("label", _r(F.col("accuracy")).alias("accuracy"))


@query("""WITH b AS (SELECT p_partkey AS label, CAST(p_size AS DOUBLE) AS accuracy, p_retailprice AS cost FROM part),
    t AS (SELECT * FROM b ORDER BY accuracy DESC, label LIMIT 1)
    SELECT b.label, t.label AS best, round(b.accuracy / t.accuracy, 9) AS accuracy_share, round(b.cost / t.cost, 9) AS cost_share FROM b, t
    WHERE b.label <> t.label AND b.accuracy / t.accuracy >= 0.9::DOUBLE AND b.cost / t.cost <= 1.2::DOUBLE""")
def near_best(spark, sf):
    rows = _table(spark, sf, "part").select(F.col("p_partkey").alias("label"), F.col("p_size").cast("double").alias("accuracy"), F.col("p_retailprice").alias("cost"))
    return frontier.near_best(rows, cost_share=1.2).withColumns({c: _r(F.col(c)) for c in ("accuracy_share", "cost_share")})


@query("""SELECT p_brand, p_partkey, p_size AS accuracy, p_retailprice AS cost FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE a.p_brand = b.p_brand AND b.p_size >= a.p_size
    AND b.p_retailprice <= a.p_retailprice AND (b.p_size > a.p_size OR b.p_retailprice < a.p_retailprice))""")
def pareto_frontier(spark, sf):
    rows = _table(spark, sf, "part").select("p_brand", "p_partkey", F.col("p_size").alias("accuracy"), F.col("p_retailprice").alias("cost"))
    return frontier.pareto(rows, "p_brand").select("p_brand", "p_partkey", "accuracy", "cost")


# text: lines with labels and figures, built from the documents and their ids so that SQL knows what they hold

PHRASES = [(item, conf, phrase) for item, conf, phrase, _ in kernels.vocabulary()]
VOCAB_SQL = "vo(item, conf, phrase, ord) AS (VALUES " + ", ".join(f"('{i}', {c}::DOUBLE, '{p}', {n})" for n, (i, c, p) in enumerate(PHRASES)) + ")"
#: Documents' own lines, with two labels behind every fourth of them and a figure behind every third.
LINES_SQL = f"""{VOCAB_SQL}, ar AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents),
    l0 AS (SELECT doc_id, unnest(a) AS line, CAST(generate_subscripts(a, 1) - 1 AS INTEGER) AS line_no FROM ar),
    li AS (SELECT doc_id, line_no, line || CASE WHEN (doc_id + line_no) % 4 = 0 THEN '. ' || upper(p.phrase) || ' ' || q.phrase ELSE '' END || CASE WHEN (doc_id + line_no) % 3 = 0 THEN ' 1,25' || (doc_id % 10) ELSE '' END AS line
           FROM l0 JOIN vo p ON p.ord = doc_id % {len(PHRASES)} JOIN vo q ON q.ord = (doc_id * 7 + line_no) % {len(PHRASES)})"""
HITS_SQL = f"""{LINES_SQL}, le AS (SELECT doc_id, line_no, line FROM li WHERE (doc_id + line_no) % 4 = 0),
    hi AS (SELECT doc_id, line_no, item, conf, phrase, ord, length(phrase) AS span FROM le, vo WHERE regexp_matches(line, '(?i)\\b' || phrase || '\\b')),
    be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY span DESC, ord) AS rn FROM hi) WHERE rn = 1)"""


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines in reading order, without a shuffle."""
    own = _table(spark, sf, "documents").select("doc_id", F.posexplode(C.lines(F.col("text"))).alias("line_no", "line"))
    k, n = F.col("doc_id"), len(PHRASES)
    phrases = F.array(*(F.lit(p) for _, _, p in PHRASES))
    labels = F.concat(F.lit(". "), F.upper(F.get(phrases, (k % n).cast("int"))), F.lit(" "), F.get(phrases, ((k * 7 + F.col("line_no")) % n).cast("int")))
    labelled = F.when((k + F.col("line_no")) % 4 == 0, labels).otherwise("")
    figure = F.when((k + F.col("line_no")) % 3 == 0, F.concat(F.lit(" 1,25"), (k % 10).cast("string"))).otherwise("")
    return own.select("doc_id", "line_no", F.concat("line", labelled, figure).alias("line"))


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    """The same lines as pages of ten."""
    lines = _lines(spark, sf).withColumn("page", F.floor(F.col("line_no") / 10).cast("int"))
    return lines.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))


@query(f"WITH {LINES_SQL} SELECT doc_id, line_no, line FROM li WHERE trim(line) <> ''")
def page_lines(spark, sf):
    return _lines(spark, sf).where("trim(line) <> ''").select("doc_id", "line_no", "line")


@query(f"WITH {HITS_SQL} SELECT doc_id, line_no, item, phrase, conf AS confidence FROM hi")
def label_hits(spark, sf):
    return _lines(spark, sf).select("doc_id", "line_no", F.explode(C.label_hits("line")).alias("h")).select("doc_id", "line_no", "h.item", "h.phrase", "h.confidence")


@query(f"WITH {HITS_SQL} SELECT doc_id, line_no, item, phrase FROM be")
def best_label(spark, sf):
    return _lines(spark, sf).withColumn("h", C.best_label("line")).where("h.item is not null").select("doc_id", "line_no", "h.item", "h.phrase")


#: Labelled lines with a figure: their own, behind the label, or that of the page's next line if it has no label. Documents
#: with digits of their own are left out on both sides.
_FIGURES_SQL = f"""{HITS_SQL}, nd AS (SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '[0-9]')),
    ne AS (SELECT li.doc_id, li.line_no, li.line, be.item, be.conf, lead(li.line) OVER w AS below, lead(be.item) OVER w AS below_item, CAST(li.line_no // 10 AS INTEGER) AS page
           FROM li JOIN nd USING (doc_id) LEFT JOIN be USING (doc_id, line_no) WINDOW w AS (PARTITION BY li.doc_id, li.line_no // 10 ORDER BY li.line_no)),
    ca AS (SELECT *, NOT regexp_matches(line, '[0-9]') AS wrapped, CAST(1250 + doc_id % 10 AS DOUBLE) AS value FROM ne
           WHERE item IS NOT NULL AND (regexp_matches(line, '[0-9]') OR below_item IS NULL AND regexp_matches(below, '[0-9]')))"""


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    plain = _table(spark, sf, "documents").where(~F.col("text").rlike("[0-9]")).select("doc_id")
    found = _pages(spark, sf).join(plain, "doc_id", "left_semi").select("doc_id", "page", F.explode(C.page_candidates("text")).alias("c"))
    return found.select("doc_id", "page", (F.col("page") * 10 + F.col("c.line_no")).alias("line_no"), "c.item", "c.confidence", "c.value", "c.quote", "c.wrapped")


@query(f"WITH {_FIGURES_SQL} SELECT doc_id, page, item, CAST(min(line_no) AS INTEGER) AS line_no, arg_min(value, line_no) AS value FROM ca GROUP BY 1, 2, 3")
def first_hit(spark, sf):
    """Of each page and item the first line with a figure."""
    return _candidates(spark, sf).groupBy("doc_id", "page", "item").agg(F.min("line_no").alias("line_no"), F.min_by("value", "line_no").alias("value"))


@query(f"WITH {_FIGURES_SQL} SELECT doc_id, line_no, item, round(greatest(0, conf - 0.1::DOUBLE), 9) AS confidence, md5(line || chr(10) || below) AS quote FROM ca WHERE wrapped")
def wrapped_rows(spark, sf):
    return _candidates(spark, sf).where("wrapped").select("doc_id", "line_no", "item", _r(F.col("confidence")).alias("confidence"), F.md5("quote").alias("quote"))


def _quoted_sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _earliest_sql(text: str, choices: list[tuple[str, str]]) -> str:
    """The choice whose pattern matches first in a text; of equal places the earlier choice."""
    rows = " UNION ALL ".join(f"SELECT {n} AS n, '{v}' AS v, regexp_extract({text}, {_quoted_sql(f'(?s)^(.*?)(?:{p})')}, 1) AS pre, regexp_matches({text}, {_quoted_sql(p)}) AS hit" for n, (v, p) in enumerate(choices))
    return f"(SELECT v FROM ({rows}) WHERE hit ORDER BY length(pre), n LIMIT 1)"


DECLARED = ["(in thousands) then in millions", "figures A$m, US$'000", "$ '000 and €", "all in  billions", "AUD, not USD", "S$ or NZ$", "£", "no units"]
DECLARED_SQL = f"SELECT doc_id, substr(text, 1, doc_id % 50) || ' ' || [{', '.join(map(_quoted_sql, DECLARED))}][doc_id % {len(DECLARED)} + 1] || ' ' || text AS t FROM documents"


def _declared(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a declaration of units or currency somewhere near their start."""
    note = F.get(F.array(*map(F.lit, DECLARED)), (F.col("doc_id") % len(DECLARED)).cast("int"))
    return _table(spark, sf, "documents").select("doc_id", F.concat(F.substr("text", F.lit(1), (F.col("doc_id") % 50).cast("int")), F.lit(" "), note, F.lit(" "), F.col("text")).alias("t"))


@query(f"WITH d AS ({DECLARED_SQL}) SELECT doc_id, coalesce(CAST({_earliest_sql('t', [(str(v), f'(?i:{p})') for v, p in kernels.UNITS])} AS DOUBLE), 1) AS scale FROM d")
def unit_scale(spark, sf):
    return _declared(spark, sf).select("doc_id", C.unit_scale("t").alias("scale"))


@query(f"WITH d AS ({DECLARED_SQL}) SELECT doc_id, {_earliest_sql('t', [(v, p.replace('(?i)', '(?i:') + ')' if p.startswith('(?i)') else p) for v, p in kernels.CURRENCIES])} AS currency FROM d")
def currency(spark, sf):
    return _declared(spark, sf).select("doc_id", C.currency("t").alias("currency"))


def _asked_sql(most: int) -> str:
    """What a model is asked about a document whose lines are its pages."""
    asked = C.ASKED.replace("\n", "' || chr(10) || '")
    return f"""array_to_string(list_transform(string_split(text, chr(10))[1:{most}], lambda p, i: '<page number="' || i || '">' || chr(10) || p || chr(10) || '</page>'), chr(10)) || '{asked}'"""


@query(f"SELECT doc_id, CAST(least(len(string_split(text, chr(10))), 3) AS INTEGER) AS kept, md5({_asked_sql(3)}) AS digest FROM documents")
def page_truncate(spark, sf):
    asked = _table(spark, sf, "documents").select("doc_id", C.prompt(C.lines(F.col("text")), most_pages=3).alias("p"))
    return asked.select("doc_id", F.size(F.regexp_extract_all("p", F.lit("<page number="), F.lit(0))).alias("kept"), F.md5("p").alias("digest"))


#: `columns.normalise`, for what the tables hold.
def _plain_sql(text: str) -> str:
    return rf"trim(regexp_replace(replace(lower(nfc_normalize({text})), 'ß', 'ss'), '\s+', ' ', 'g'))"


@query(f"""WITH b AS (SELECT text AS quote, row_number() OVER (ORDER BY item_id) - 1 AS k, count(*) OVER () AS n FROM benchmark),
    p AS (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN quote WHEN 1 THEN substr(text, doc_id % 40 + 1, 60) ELSE replace(substr(text, doc_id % 40 + 1, 60), ' ', '') END AS quote FROM documents JOIN b ON k = doc_id % n),
    q AS (SELECT doc_id, {_plain_sql('text')} AS t, {_plain_sql('quote')} AS q FROM p)
    SELECT doc_id, q <> '' AND (contains(t, q) OR contains(replace(t, ' ', ''), replace(q, ' ', ''))) AS quoted FROM q""")
def quote_on_page(spark, sf):
    """A third of the documents are asked for a passage of the benchmark, a third for words of their own, a third for those
    without their blanks, which only the comparison without white space finds."""
    passages = imports.positioned(_table(spark, sf, "benchmark"), "item_id").select(F.col("position").alias("k"), F.col("text").alias("passage"))
    docs = _table(spark, sf, "documents").select("doc_id", "text", (F.col("doc_id") % passages.count()).alias("k")).join(F.broadcast(passages), "k")  # the benchmark is small by its nature
    own = F.substr("text", (F.col("doc_id") % 40 + 1).cast("int"), F.lit(60))
    quote = F.when(F.col("doc_id") % 3 == 0, F.col("passage")).when(F.col("doc_id") % 3 == 1, own).otherwise(F.replace(own, F.lit(" "), F.lit("")))
    return docs.select("doc_id", C.quote_on_page(quote, F.col("text")).alias("quoted"))


_FLAT = "trim(regexp_replace(lower(text), '[ \\n\\t\\r]+', ' ', 'g'))"


@query(f"""WITH q AS (SELECT item_id, {_FLAT} AS q FROM benchmark UNION ALL SELECT -event_id, event_type FROM events WHERE event_id < 3), d AS (SELECT doc_id, {_FLAT} AS p FROM documents)
    SELECT item_id, doc_id FROM q JOIN d ON contains(p, q) WHERE q <> ''""")
def passages_in_documents(spark, sf):
    """Passages of the benchmark, and a few words, wherever documents hold them."""
    words = _table(spark, sf, "events").where("event_id < 3").select((-F.col("event_id")).alias("item_id"), F.col("event_type").alias("text"))
    passages = _table(spark, sf, "benchmark").select("item_id", "text").union(words)
    return containment.contained(passages.select(F.col("item_id").alias("passage_id"), "text"), _table(spark, sf, "documents")).select(F.col("passage_id").alias("item_id"), "doc_id")


CITED_SQL = """
    b AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
    cl AS (SELECT event_id, k, CASE WHEN event_id % 11 <> 0 THEN k + CASE WHEN event_id % 3 = 0 THEN 5000 ELSE 0 END END AS value, CASE WHEN event_id % 13 <> 0 THEN event_id % 4 END AS page,
                  event_id % 7 <> 0 AS quoted, event_id % 5 <> 0 AS verbatim FROM b)"""


def _cited(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Claims and two-page documents, one of each per event: some claims lack a page or a quote, or cite what is not there."""
    rows = _table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    i, k = F.col("event_id"), F.col("k").cast("string")
    first, second = F.concat(F.lit("Total  debt "), k), F.concat(F.lit("Net Cash\n"), k)
    documents = rows.select(i.cast("string").alias("doc_id"), F.array(first, second).alias("pages"))
    quote = F.when(i % 5 == 0, "Total debt x").when(i % 4 == 2, F.concat(F.lit("net cash "), k)).otherwise(F.concat(F.lit("Total debt "), k))
    claims = rows.select(
        i.cast("string").alias("doc_id"), F.lit(0).alias("pos"), F.lit("total_debt").alias("name"), F.when(i % 11 != 0, F.col("k") + F.when(i % 3 == 0, 5000).otherwise(0)).cast("double").alias("value"),
        F.lit(1.0).alias("unit_scale"), F.lit(None).cast("string").alias("currency"), F.when(i % 13 != 0, i % 4).cast("int").alias("page"), F.when(i % 7 != 0, quote).alias("quote"), F.lit(0.5).alias("confidence"))
    return claims, documents


@query(f"WITH {CITED_SQL} SELECT event_id, CASE WHEN value IS NOT NULL THEN coalesce(page BETWEEN 1 AND 2 AND quoted AND verbatim AND value = k, FALSE) END AS grounded FROM cl")
def verify_claims(spark, sf):
    return verify.verify(*_cited(spark, sf)).select(F.col("doc_id").cast("bigint").alias("event_id"), "grounded")


@query(f"""WITH {CITED_SQL}, p AS (SELECT event_id, CASE WHEN value IS NULL THEN NULL WHEN page IS NULL OR NOT quoted THEN 'total_debt: a value without a page or a quote; cite both, or abstain'
    WHEN page NOT BETWEEN 1 AND 2 THEN 'total_debt: cites page ' || page || ' of 2' WHEN NOT verbatim THEN 'total_debt: the quote is not on page ' || page
    WHEN value <> k THEN 'total_debt: the figure is not in the quote' END AS problem FROM cl) SELECT event_id, problem IS NULL AS accepted, problem FROM p""")
def claim_admission(spark, sf):
    return verify.admit(*_cited(spark, sf)).select(F.col("doc_id").cast("bigint").alias("event_id"), F.col("problem").isNull().alias("accepted"), "problem")


@query(f"""WITH b AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) + 1 AS k FROM events), n(name) AS (VALUES {', '.join(f"('{i}')" for i in ITEMS)})
    SELECT event_id, name, CASE name WHEN 'total_debt' THEN CAST(k + 2100 AS DOUBLE) WHEN 'cash' THEN -CAST(k AS DOUBLE) WHEN 'interest_expense' THEN CAST(k AS DOUBLE) END AS value,
    CASE WHEN name IN ('total_debt', 'cash') THEN 1000::DOUBLE ELSE 1::DOUBLE END AS unit_scale, CASE WHEN name IN ('total_debt', 'cash') THEN 'AUD' END AS currency,
    CASE WHEN name IN ('total_debt', 'cash') THEN 1 WHEN name = 'interest_expense' THEN 2 END AS page, CASE name WHEN 'total_debt' THEN 0.6::DOUBLE WHEN 'interest_expense' THEN 0.6::DOUBLE WHEN 'cash' THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS confidence,
    CASE name WHEN 'total_debt' THEN 'Total debt ' || (k + 2100) || ' ' || k WHEN 'cash' THEN 'Cash at bank' || chr(10) || '(' || k || ')' WHEN 'interest_expense' THEN 'Finance costs 12% 2023 (' || k || ')' END AS quote FROM b, n""")
def heuristic_claims(spark, sf):
    rows = _table(spark, sf, "events").select("event_id", (F.get_json_object("props", "$.k").cast("bigint") + 1).alias("n")).withColumn("k", F.col("n").cast("string"))
    first = F.concat(F.lit("All figures in A$'000\nTotal debt "), (F.col("n") + 2100).cast("string"), F.lit(" "), F.col("k"), F.lit("\nCash at bank\n("), F.col("k"), F.lit(")\nDebt 7"))
    second = F.concat(F.lit("Notes\nFinance costs 12% 2023 ("), F.col("k"), F.lit(")\nCash 9"))
    claims = Heuristic().claims(rows.select(F.col("event_id").cast("string").alias("doc_id"), F.array(first, second).alias("pages")))
    return claims.select(F.col("doc_id").cast("bigint").alias("event_id"), "name", "value", "unit_scale", "currency", "page", "confidence", "quote")


# numbers: figures as they are printed, by ids, so that SQL knows their values

_FIGURES = {  # what is printed, and the values in it, of n = 1000 + event_id % 9000
    0: ("Revenue {c} (note 3) against ({c}) in 2023", "[n, 3, -n, 2023]"), 1: ("v1.2 and note3 but $'000", "[]"), 2: ("US$ {n}.5 million or {n}-", "[(n + 0.5) * 1000000, -n]"),
    3: ("£{n}k, - {n} and (£{c}m", "[n * 1000, -n, n * 1000000]"), 4: ("x{n} {n}% {n}bn", "[n, n * 1000000000]"), 5: ("({n} tn) {n} t", "[-n * 1000000000000, n * 1000000000000]"),
}
_AMOUNTS = {  # what is printed, its first plausible amount, and that one's own scale
    0: ("2023 {c}", "n", "1"), 1: ("Note 12 ({c})", "-n", "1"), 2: ("A$'000 {n} m", "n", "1000000"), 3: ("5% - {n}", "CASE WHEN n < 1900 OR n > 2099 THEN -n END", "1"), 4: ("$2019 and {n}", "2019", "1"), 5: ("000 2001 nothing", "NULL", "1"), 6: ("{n}.25 bln", "n + 0.25", "1000000000"), 7: ("{n} tn", "n", "1"),
}


def _printed(spark: SparkSession, sf: str, forms: dict) -> DataFrame:
    """(event_id, text): the form that an id calls for, `{n}` as digits and `{c}` with separators."""
    i = F.col("event_id")
    n = 1000 + i % 9000
    text = F.get(F.array(*(F.lit(t) for t, *_ in forms.values())), (i % len(forms)).cast("int"))
    filled = F.replace(F.replace(text, F.lit("{n}"), n.cast("string")), F.lit("{c}"), F.concat(F.substring(n.cast("string"), 1, 1), F.lit(","), F.substring(n.cast("string"), 2, 3)))
    return _table(spark, sf, "events").select("event_id", filled.alias("text"))


def _by_form(forms: dict, part: int) -> str:
    return f"CASE event_id % {len(forms)} " + " ".join(f"WHEN {k} THEN {v[part]}" for k, v in forms.items()) + " END"


_PRINTED_SQL = "nu AS (SELECT event_id, CAST(1000 + event_id % 9000 AS DOUBLE) AS n FROM events)"


@query(f"""WITH {_PRINTED_SQL}, vs AS (SELECT event_id, CAST({_by_form(_FIGURES, 1)} AS DOUBLE[]) AS v FROM nu)
    SELECT event_id, unnest(v) AS value, CAST(unnest(range(len(v))) AS INTEGER) AS place FROM vs""")
def numbers_in_text(spark, sf):
    return _printed(spark, sf, _FIGURES).select("event_id", F.posexplode(C.numbers_in_text("text")).alias("place", "value"))


@query(f"WITH {_PRINTED_SQL} SELECT event_id, CAST({_by_form(_AMOUNTS, 1)} AS DOUBLE) AS value FROM nu")
def plausible_number(spark, sf):
    return _printed(spark, sf, _AMOUNTS).withColumn("found", C.plausible_number("text")).select("event_id", "found.value")


@query(f"""WITH {_PRINTED_SQL}, v AS (SELECT event_id, CAST({_by_form(_AMOUNTS, 1)} AS DOUBLE) AS value, {_by_form(_AMOUNTS, 2)} AS own, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 1000 END AS units FROM nu)
    SELECT event_id, value, CAST(CASE WHEN own <> 1 THEN own ELSE units END AS DOUBLE) AS unit_scale, value * CASE WHEN own <> 1 THEN own ELSE units END AS scaled FROM v WHERE value IS NOT NULL""")
def scaled_numbers(spark, sf):
    """A claim's scale is the figure's own, or else its page's."""
    units = F.when(F.col("event_id") % 3 == 0, F.lit("Accounts")).otherwise(F.lit("Accounts in thousands"))
    pages = F.array(F.concat(units, F.lit("\nTurnover "), F.col("text")))
    claims = Heuristic().claims(_printed(spark, sf, _AMOUNTS).select(F.col("event_id").cast("string").alias("doc_id"), pages.alias("pages")))
    own = claims.where("name = 'revenue_ltm' and value is not null")
    return own.select(F.col("doc_id").cast("bigint").alias("event_id"), "value", "unit_scale", (F.col("value") * F.col("unit_scale")).alias("scaled"))


_NUMBER = r"(?:^|[^\w.'])(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)"
_NUMBERS_SQL = f"nu AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_NUMBER.replace(chr(39), chr(39) * 2)}', 1)) AS n FROM documents), nv AS (SELECT doc_id, n, try_cast(replace(n, ',', '') AS DOUBLE) AS value FROM nu)"


@query(f"""WITH {_NUMBERS_SQL}, g AS (SELECT doc_id, list(value) AS vs, max(value) AS top FROM nv GROUP BY doc_id), w AS (SELECT *, top * CASE WHEN doc_id % 3 = 0 THEN 1.004::DOUBLE WHEN doc_id % 3 = 1 THEN 1.5::DOUBLE ELSE 0.001::DOUBLE END AS want FROM g)
    SELECT doc_id, len(list_filter(vs, lambda n: abs(n - want) <= 0.01::DOUBLE * abs(want) OR abs(n - want * 1000) <= 0.01::DOUBLE * abs(want * 1000))) > 0 AS quoted FROM w""")
def value_in_quote(spark, sf):
    quotes = _table(spark, sf, "documents").select("doc_id", F.transform(F.regexp_extract_all("text", F.lit(_NUMBER), F.lit(1)), lambda n: F.replace(n, F.lit(","), F.lit("")).try_cast("double")).alias("vs")).where(F.size("vs") > 0)
    k = F.col("doc_id") % 3
    want = F.array_max("vs") * F.when(k == 0, 1.004).when(k == 1, 1.5).otherwise(0.001)
    return quotes.select("doc_id", C.value_in_numbers(want, F.lit(1000.0), F.lit(False), F.col("vs")).alias("quoted"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN -round(o_totalprice, 2) WHEN o_orderkey % 5 = 2 THEN round(o_totalprice, 2) * 1000 ELSE round(o_totalprice, 2) END AS value FROM orders""")
def parse_number(spark, sf):
    k, money = F.col("o_orderkey") % 5, F.format_number(F.col("o_totalprice"), 2)
    text = F.when(k == 0, F.concat(money, F.lit(" unaudited"))).when(k == 1, F.concat(F.lit("($"), money, F.lit(")"))).when(k == 2, F.concat(F.lit("A$"), money, F.lit(" k"))).otherwise(money)
    return _table(spark, sf, "orders").select("o_orderkey", C.parse_number(text).alias("value"))


@query("""SELECT p_partkey, try_cast(replace(replace(CASE WHEN p_partkey % 4 = 0 THEN '1,0' || p_size WHEN p_partkey % 4 = 1 THEN p_size || '_000' WHEN p_partkey % 4 = 2 THEN 'n/a ' || p_size ELSE ' ' || p_size || '.5 ' END, ',', ''), '_', '') AS DOUBLE) AS value FROM part""")
def tolerant_float(spark, sf):
    k, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    text = F.when(k == 0, F.concat(F.lit("1,0"), size)).when(k == 1, F.concat(size, F.lit("_000"))).when(k == 2, F.concat(F.lit("n/a "), size)).otherwise(F.concat(F.lit(" "), size, F.lit(".5 ")))
    return _table(spark, sf, "part").select("p_partkey", C.tolerant_float(text).alias("value"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0 ELSE greatest(0, least(1, value / 50 - 0.5::DOUBLE)) END AS confidence FROM events")
def clamp_confidence(spark, sf):
    raw = F.when(F.col("event_id") % 4 == 0, "high").otherwise((F.col("value") / 50 - F.lit(0.5)).cast("string"))
    return _table(spark, sf, "events").select("event_id", C.clamp(raw).alias("confidence"))


# corpora, imports, presentation


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """Labels as golden records: one field a label, stated or not by `quality`, ambiguous by `toxic`."""
    rows = _table(spark, sf, "labels").groupBy("doc_id").agg(F.collect_list(F.struct(F.lit("cash").alias("name"), F.when(F.col("quality") == 1, F.lit(5.0)).alias("value"), F.lit(1).alias("page"), (F.col("toxic") == 1).alias("ambiguous"), F.lit("").alias("note"))).alias("fields"))
    return rows.select(F.col("doc_id").cast("string").alias("doc_id"), "fields")


def _corpus(spark: SparkSession, sf: str) -> str:
    """Golden records and texts of all documents, written to a corpus folder, which is returned; a document's lines are its pages."""
    root = scratch(spark, "corpus")
    writers.save_tables(_table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), C.lines(F.col("text")).alias("pages")), _records(spark, sf), root)
    return root


@query("SELECT doc_id, CAST(len(string_split(text, chr(10))) AS INTEGER) AS n_pages, md5(text) AS digest FROM documents")
def page_count(spark, sf):
    """Pages of documents that were written to a corpus folder and read again."""
    return corpus.text_documents(spark, _corpus(spark, sf)).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.size("pages").alias("n_pages"), F.md5(F.array_join("pages", "\n")).alias("digest"))


@query("SELECT doc_id, 'cash' AS name, CASE WHEN quality = 1 THEN 5::DOUBLE END AS expected, toxic = 1 AS ambiguous FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)")
def golden_labels(spark, sf):
    """Labels that were written to a corpus folder and read again."""
    rows = corpus.golden_fields(corpus.golden_records(spark, _corpus(spark, sf)))
    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "name", "expected", "ambiguous")


@query("""SELECT count(DISTINCT doc_id) AS n_documents, count(*) AS n_fields, count(*) FILTER (quality = 1) AS n_stated, count(*) FILTER (quality IS DISTINCT FROM 1) AS n_absent, count(*) FILTER (toxic = 1) AS n_ambiguous FROM labels""")
def corpus_inventory(spark, sf):
    return corpus.inventory(_records(spark, sf))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION SELECT page_id FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled_documents(spark, sf):
    pdfs = _table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"))
    return corpus.unlabelled(_table(spark, sf, "labels").select("doc_id"), _table(spark, sf, "documents").select("doc_id"), pdfs)


@query("SELECT l.doc_id, CASE WHEN p.page_id IS NOT NULL THEN 'pdf' WHEN d.doc_id IS NOT NULL THEN 'text' ELSE 'missing' END AS kind FROM labels l LEFT JOIN pages p ON p.page_id = l.doc_id LEFT JOIN documents d ON d.doc_id = l.doc_id AND d.doc_id % 5 <> 0")
def source_resolution(spark, sf):
    text = _table(spark, sf, "documents").where("doc_id % 5 <> 0").select("doc_id")
    pdfs = _table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"))
    return corpus.resolve(_table(spark, sf, "labels").select("doc_id"), text, pdfs).select("doc_id", "kind")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 4 = 0 THEN 'absent' WHEN doc_id % 7 = 0 THEN NULL ELSE 'value' END AS kind FROM documents""")
def decoy_import(spark, sf):
    d = F.col("doc_id")
    asked = F.when(d % 3 == 0, "name town").otherwise("name income")
    expected = F.when(d % 4 == 0, "name=x").when(d % 7 == 0, "name=x income=unknown").otherwise("name=x income=1,250_000.5")
    return _table(spark, sf, "documents").select("doc_id", imports.label_of(asked, C.first_of_keys(expected), "income").alias("kind"))


@query("""WITH t AS (SELECT conv_id, turn, unnest(string_split('a=' || turn || ' junk role=' || role || ' a=x b=1=2', ' ')) AS t, generate_subscripts(string_split('a=' || turn || ' junk role=' || role || ' a=x b=1=2', ' '), 1) AS k FROM conversations),
    p AS (SELECT conv_id, turn, split_part(t, '=', 1) AS key, substr(t, instr(t, '=') + 1) AS value, k FROM t WHERE instr(t, '=') > 1)
    SELECT conv_id, turn, key, arg_min(value, k) AS value FROM p GROUP BY ALL""")
def kv_parse_first_wins(spark, sf):
    line = F.concat(F.lit("a="), F.col("turn").cast("string"), F.lit(" junk role="), F.col("role"), F.lit(" a=x b=1=2"))
    return _table(spark, sf, "conversations").select("conv_id", "turn", F.explode(C.first_of_keys(line)))


@query("""WITH a AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS position FROM customer), b AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders WHERE o_orderkey IN (SELECT min(o_orderkey) FROM orders GROUP BY o_custkey)),
    c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS position FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders))
    SELECT c.c_custkey, b.o_orderkey, position FROM c JOIN b USING (position)""")
def positional_zip(spark, sf):
    orders = _table(spark, sf, "orders")
    left = _table(spark, sf, "customer").select("c_custkey").join(orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    right = orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey")).select("o_orderkey")
    return imports.zip_by_position(imports.positioned(left, "c_custkey"), imports.positioned(right, "o_orderkey")).select("c_custkey", "o_orderkey", F.col("position").cast("bigint").alias("position"))


@query(r"""SELECT page_id, substr(trim(regexp_replace(lower(regexp_replace(regexp_replace(url, '/+$', ''), '^.*/', '')) || '', '[^a-z0-9._-]+', '-', 'g'), '-.'), 1, 100) AS slug FROM pages""")
def safe_doc_id(spark, sf):
    return _table(spark, sf, "pages").select("page_id", C.safe_doc_id(F.concat(F.regexp_replace("url", "/+$", ""), F.lit(".pdf"))).alias("slug"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_block(spark, sf):
    reply = F.concat(F.lit("Sure! Here it is:\n"), F.col("props"), F.lit("\nAnything else?"))
    return _table(spark, sf, "events").select("event_id", F.from_json(C.json_block(reply), "k bigint")["k"].alias("k"))


@query(f"""WITH t AS (SELECT conv_id, list(text ORDER BY turn) AS pages FROM conversations GROUP BY conv_id)
    SELECT conv_id, md5(array_to_string(list_transform(pages[1:60], lambda p, i: '<page number="' || i || '">' || chr(10) || p || chr(10) || '</page>'), chr(10)) || '{C.ASKED.replace(chr(10), "' || chr(10) || '")}'
        || CASE WHEN conv_id % 2 = 0 THEN chr(10) || chr(10) || '{C.FEEDBACK}' || chr(10) || '- cash: ' || conv_id || chr(10) || '- again' ELSE '' END) AS digest FROM t""")
def prompt_assembly(spark, sf):
    """What a model is asked about each conversation, every other one with what was wrong before."""
    turns = _table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    problems = F.when(F.col("conv_id") % 2 == 0, F.array(F.concat(F.lit("cash: "), F.col("conv_id").cast("string")), F.lit("again"))).otherwise(F.array().cast("array<string>"))
    return turns.select("conv_id", F.md5(C.prompt(F.col("t.text"), problems)).alias("digest"))


@query(f"""WITH {CLAIMS}, n AS (SELECT outcome, count(*) AS n, (SELECT count(*) FROM s) AS total FROM s GROUP BY 1)
    SELECT outcome, n, printf('%.1f%%', n / CAST(total AS DOUBLE) * 100) AS share, repeat('#', CAST(round_even(28 * n / CAST(total AS DOUBLE), 0) AS INTEGER)) || repeat('.', 28 - CAST(round_even(28 * n / CAST(total AS DOUBLE), 0) AS INTEGER)) AS bar FROM n""")
def taxonomy_bars(spark, sf):
    rows = scoring.taxonomy(_fields(spark, sf))
    return rows.select("outcome", "n", C.percent(F.col("share")).alias("share"), C.bar(F.col("n"), F.col("total")).alias("bar"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '\s+', ' ', 'g'))) AS digest FROM documents")
def normalise_text(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", F.md5(C.normalise("text")).alias("digest"))
