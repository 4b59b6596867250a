"""Four credit ratios that compute, or refuse and say why.

Inputs are one row per document with `<item>` (scaled value) and `<item>_status` (`ok`, `missing`, `rejected`) for each line
item. A ratio is a struct (value, abstained, reason, inputs); when it abstains its inputs are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.functions.columns import numbers_match
from veriloom.schemas import ITEMS, RATIO_OUTCOMES, RATIOS


# What a ratio says of itself; `{}` is an item, a number or another reason.
REASONS = {
    "rejected": "{} failed evidence verification (grounded=False) and is unusable",
    "missing": "{} is missing or abstained",
    "no add-backs": "EBITDA_ADDBACKS not disclosed; treated as 0",
    "no cash": "CASH not disclosed; treated as 0",
    "no ebitda": "adjusted EBITDA unavailable: {}",
    "ebitda not positive": "adjusted EBITDA is non-positive ({}); leverage is not meaningful",
    "proxy": "CFADS not disclosed; adjusted EBITDA used as proxy",
    "no proxy": "CFADS not disclosed and adjusted EBITDA proxy unavailable: {}",
    "no service": "debt service not disclosed ({} missing); assuming zero would overstate DSCR",
    "negative service": "{} is negative; debt service is stored as a positive magnitude, so this input cannot be netted into a ratio",
    "service not positive": "debt service is non-positive ({}); DSCR is undefined",
}


def _says(reason: str, about: Column | str = "") -> Column:
    before, _, after = REASONS[reason].partition("{}")
    return F.concat(F.lit(before), F.lit(about) if isinstance(about, str) else about, F.lit(after))


def wide(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, name, value, grounded) rows as inputs; a claim that failed verification is rejected before its value counts."""
    rejected = F.coalesce("grounded", F.lit(True)) == F.lit(False)
    cells = rows.select(key, "name", F.when(~rejected, F.col("value")).alias("value"), rejected.alias("rejected"))
    made = []
    for item in ITEMS:
        own = F.col("name") == item
        made += [F.max(F.when(own, F.col("value"))).alias(item), F.coalesce(F.max(F.when(own, F.col("rejected"))), F.lit(False)).alias(f"{item}_rejected")]
    pivoted = cells.groupBy(key).agg(*made)
    return pivoted.select(key, *ITEMS, *(status(F.col(i), F.col(f"{i}_rejected")).alias(f"{i}_status") for i in ITEMS))


def status(value: Column, rejected: Column) -> Column:
    return F.when(rejected, "rejected").when(value.isNull(), "missing").otherwise("ok")


def _is(item: str, state: str) -> Column:
    return F.col(f"{item}_status") == state


def _refuse(reason: Column | str) -> Column:
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return F.struct(F.lit(None).cast("double").alias("value"), F.lit(True).alias("abstained"), reason.alias("reason"), F.array().cast("array<string>").alias("inputs"))


def _answer(value: Column, reason: Column | str, inputs: Column) -> Column:
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return F.struct(value.alias("value"), F.lit(False).alias("abstained"), reason.alias("reason"), inputs.alias("inputs"))


def _rejected(item: str) -> Column:
    return _refuse(_says("rejected", item.upper()))


def _missing(item: str) -> Column:
    return _refuse(_says("missing", item.upper()))


def general(x: Column) -> Column:
    """A number as `%g` in C prints it: six significant digits, no trailing zeros."""
    exponent = F.when(x == 0, 0).otherwise(F.regexp_extract(F.format_string("%.5e", x), r"e([-+]\d+)$", 1).cast("int"))
    fixed = F.coalesce(*(F.when(exponent == e, F.format_string(f"%.{5 - e}f", x)) for e in range(-4, 6)))
    plain = F.when(F.contains(fixed, F.lit(".")), F.regexp_replace(fixed, r"\.?0+$", "")).otherwise(fixed)
    scientific = F.regexp_replace(F.format_string("%.5e", x), r"\.?0+e", "e")
    return F.when((exponent < -4) | (exponent >= 6), scientific).otherwise(plain)


def with_ratios(inputs: DataFrame) -> DataFrame:
    """`inputs` with a struct for each ratio."""
    names = lambda *items: F.array(*map(F.lit, items)).cast("array<string>")
    revenue = (
        F.when(_is("revenue_ltm", "rejected"), _rejected("revenue_ltm"))
        .when(_is("revenue_ltm", "missing"), _missing("revenue_ltm"))
        .otherwise(_answer(F.col("revenue_ltm"), "", names("revenue_ltm")))
    )
    ebitda = (
        F.when(_is("ebitda_reported", "rejected"), _rejected("ebitda_reported"))
        .when(_is("ebitda_reported", "missing"), _missing("ebitda_reported"))
        .when(_is("ebitda_addbacks", "rejected"), _rejected("ebitda_addbacks"))
        .when(_is("ebitda_addbacks", "ok"), _answer(F.col("ebitda_reported") + F.col("ebitda_addbacks"), "", names("ebitda_reported", "ebitda_addbacks")))
        .otherwise(_answer(F.col("ebitda_reported"), _says("no add-backs"), names("ebitda_reported")))
    )
    made = inputs.withColumns({"ltm_revenue": revenue, "adjusted_ebitda": ebitda})
    adjusted = F.col("adjusted_ebitda")
    note = F.nullif(adjusted["reason"], F.lit(""))

    has_cash = _is("cash", "ok")
    net = F.col("total_debt") - F.when(has_cash, F.col("cash")).otherwise(0.0)
    leverage = (
        F.when(_is("total_debt", "rejected"), _rejected("total_debt"))
        .when(_is("total_debt", "missing"), _missing("total_debt"))
        .when(_is("cash", "rejected"), _rejected("cash"))
        .when(adjusted["abstained"], _refuse(_says("no ebitda", adjusted["reason"])))
        .when(adjusted["value"] <= 0, _refuse(_says("ebitda not positive", general(adjusted["value"]))))
        .otherwise(_answer(
            F.try_divide(net, adjusted["value"]), F.concat_ws("; ", F.when(~has_cash, _says("no cash")), note),
            F.concat(names("total_debt"), F.when(has_cash, names("cash")).otherwise(names()), adjusted["inputs"])))
    )

    proxied = _is("cfads", "missing")
    legs = ("interest_expense", "principal_repayments")
    absent = F.concat_ws(", ", *(F.when(~_is(i, "ok"), i.upper()) for i in legs))
    negative = F.concat_ws(", ", *(F.when(F.col(i) < 0, i.upper()) for i in legs))
    service = F.col(legs[0]) + F.col(legs[1])
    dscr = (
        F.when(_is("cfads", "rejected"), _rejected("cfads"))
        .when(proxied & adjusted["abstained"], _refuse(_says("no proxy", adjusted["reason"])))
        .when(_is(legs[0], "rejected"), _rejected(legs[0]))
        .when(_is(legs[1], "rejected"), _rejected(legs[1]))
        .when(absent != "", _refuse(_says("no service", absent)))
        .when(negative != "", _refuse(_says("negative service", negative)))
        .when(service <= 0, _refuse(_says("service not positive", general(service))))
        .otherwise(_answer(
            F.try_divide(F.when(proxied, adjusted["value"]).otherwise(F.col("cfads")), service),
            F.concat_ws("; ", F.when(proxied, _says("proxy")), F.when(proxied, note)),
            F.concat(F.when(proxied, adjusted["inputs"]).otherwise(names("cfads")), names(*legs))))
    )
    return made.withColumns({"leverage": leverage, "dscr": dscr})


def ratio_rows(inputs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, ratio, value, abstained, reason, inputs), four rows per document."""
    each = F.array(*(F.struct(F.lit(r).alias("ratio"), F.col(r).alias("r")) for r in RATIOS))
    return with_ratios(inputs).select(key, F.explode(each).alias("x")).select(key, "x.ratio", "x.r.value", "x.r.abstained", "x.r.reason", "x.r.inputs")


def ratio_outcome(got: Column, want: Column) -> Column:
    """Of two (value, abstained) structs."""
    return (
        F.when(got["abstained"] & want["abstained"], "both_abstained").when(got["abstained"], "extraction_abstained").when(want["abstained"], "golden_abstained")
        .when(numbers_match(got["value"], want["value"], absolute=0.0), "agree").otherwise("disagree")
    )


def compare(extracted: DataFrame, golden: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, ratio, extracted, expected, outcome, extracted_reason, expected_reason, inputs) from both sides' wide inputs.

    One join of documents; both sides of each ratio are on the same row before anything is exploded.
    """
    got = with_ratios(extracted).select(key, *(F.col(r).alias(f"got_{r}") for r in RATIOS))
    want = with_ratios(golden).select(key, *(F.col(r).alias(f"want_{r}") for r in RATIOS))
    each = F.array(*(F.struct(F.lit(r).alias("ratio"), F.col(f"got_{r}").alias("got"), F.col(f"want_{r}").alias("want")) for r in RATIOS))
    rows = got.join(want, key).select(key, F.explode(each).alias("x")).select(key, "x.*")
    return rows.select(
        key, "ratio", F.col("got.value").alias("extracted"), F.col("want.value").alias("expected"), ratio_outcome(F.col("got"), F.col("want")).alias("outcome"),
        F.col("got.reason").alias("extracted_reason"), F.col("want.reason").alias("expected_reason"), F.col("got.inputs").alias("inputs"))


def summary(comparisons: DataFrame, *by: str) -> DataFrame:
    """Counts of outcomes, agreement and safety; null rates when there are none. A wrong answer is the only unsafe outcome
    besides answering what the golden side refuses."""
    counted = comparisons.groupBy(*by).agg(F.count("*").alias("n_ratios"), *(F.count_if(F.col("outcome") == o).alias(o) for o in RATIO_OUTCOMES))
    share = lambda *o: F.try_divide(sum((F.col(x) for x in o[1:]), F.col(o[0])).cast("double"), F.col("n_ratios").cast("double"))
    return counted.withColumns({"agreement": share("agree", "both_abstained"), "safety": share("agree", "both_abstained", "extraction_abstained")})
