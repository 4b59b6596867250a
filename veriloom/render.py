"""Reports as lines of text. Runs are rendered from their summaries, which have a bounded number of rows; lists come as they are."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.functions import columns as C
from veriloom.operators import frontier, scoring, selective
from veriloom.plans.run import Run
from veriloom.schemas import ITEMS, RATIO_OUTCOMES

RULE = "-" * 78
_SHOWN = ("accuracy", "coverage", "grounding_rate", "hallucination_rate", "abstention_precision")


def percent(x: float | None) -> str:
    return "n/a" if x is None else f"{100 * x:.1f}%"


def number(x: float | None) -> str:
    return "-" if x is None else f"{x:,.2f}".rstrip("0").rstrip(".")


def _rates(label: str, row) -> str:
    return f"{label:<24}" + "".join(f"{name.replace('_', ' ')} {percent(row[name]):>7}  " for name in _SHOWN).rstrip()


def taxonomy_lines(fields: DataFrame) -> DataFrame:
    """The outcomes as text, in their fixed order."""
    n, total = F.col("n"), F.col("total")
    return scoring.taxonomy(fields).orderBy("ordinal").select(F.format_string("%-20s %4d  %6s  %s", "outcome", n, C.percent(F.col("share")), C.bar(n, total)).alias("line"))


def run(run: Run, verbose: bool = False) -> Iterator[str]:
    """The whole report of a run; `verbose` adds each document's fields that are neither right nor rightly left out."""
    scopes = {r["scope"]: r for r in run.report.collect()}  # ten rows
    totals, latency = run.totals.first(), run.latency.first()
    yield f"run {run.run_id}: {run.extractor} on {run.corpus_root}, {totals['n_documents']} documents, {scopes['overall']['n_fields']} fields"
    if not run.verified:
        yield "Citations were not checked: nothing is ungrounded, and accuracy is an upper bound."
    if skipped := [r["doc_id"] for r in run.skipped.orderBy("doc_id").limit(21).collect()]:
        yield "Labels without a document, in no rate: " + ", ".join(skipped[:20]) + " and more" * (len(skipped) > 20)
    for r in run.documents.where("error is not null").orderBy("doc_id").select("doc_id", "error").limit(20).collect():
        yield f"{r['doc_id']}: {r['error']}"
    yield from ("", _rates("overall", scopes["overall"]))
    if scopes["ambiguous"]["n_fields"]:
        yield _rates(f"ambiguous ({scopes['ambiguous']['n_fields']})", scopes["ambiguous"])
    yield from ("", "Outcomes", RULE)
    yield from (r["line"] for r in taxonomy_lines(run.fields).collect())
    yield from ("", "Line items", RULE)
    for item in ITEMS:
        if row := scopes.get(f"field.{item}"):
            yield _rates(f"{item} ({row['n_answerable']}/{row['n_fields']})", row)
    ratio = run.ratio_summary.first()
    yield from ("", "Ratios", RULE, f"agreement {percent(ratio['agreement'])}  safety {percent(ratio['safety'])}  of {ratio['n_ratios']}; a ratio that is refused counts as safe")
    yield from (f"{o:<24}{ratio[o]:>6}" for o in RATIO_OUTCOMES)
    yield from ("", "Selective answering", RULE)
    yield from _selective(run)
    yield from ("", f"median latency {number(latency['latency_p50'])} s, cost of a document ${number(latency['cost_per_document'])}, retries {totals['total_retries']}, tokens {totals['total_input_tokens']} in, {totals['total_output_tokens']} out")
    if verbose:
        yield from ("", "Documents", RULE)
        for d in run.documents.select("doc_id", "n_pages", "fields").orderBy("doc_id").toLocalIterator():
            yield f"{d['doc_id']} ({d['n_pages']} pages)"
            for f in d["fields"] or []:
                if f["outcome"] not in ("correct", "correct_abstention"):
                    yield f"    {f['name']:<22}{f['outcome']:<16} expected {number(f['expected'])}, got {number(f['actual'])}"


def _selective(run: Run) -> Iterator[str]:
    s = run.selective.first()
    yield f"area under the risk-coverage curve {s['aurc']:.4f}, error when everything is answered {s['baseline_error']:.3f}"
    if not s["aurc_is_informative"]:
        yield f"{s['n_distinct_confidences']} distinct confidences are too few for that area to say how well they rank: don't gate on it."
    yield f"alpha {s['alpha']:g}: calibrated on {s['n_calibration']} fields, {s['n_calibration_correct']} of them right; tested on {s['n_test']}"
    if s["threshold_supported"]:
        met = "met" if s["guarantee_held"] else "missed: confidences do not tell right from wrong well enough"
        yield f"threshold {s['threshold']:.3f}: coverage {percent(s['coverage'])}, error on answered {percent(s['error_on_answered'])}, target {met}"
    else:
        least = run.selective.select(selective.least_calibration(F.lit(s["alpha"]))).first()[0]
        yield f"no threshold: alpha {s['alpha']:g} takes at least {least} right answers to calibrate on, so nothing is answered"


def gate(checks: DataFrame, allow_undefined: bool = False) -> Iterator[str]:
    """A line for each threshold, and the verdict."""
    rows = checks.orderBy("metric").collect()  # one per threshold
    mark = {"pass": "ok", "fail": "FAIL", "undefined": "????"}
    for r in rows:
        at = ">=" if r["direction"] == "min" else "<="
        yield f"[{mark[r['status']]:<4}] {r['metric']} {'undefined' if r['observed'] is None else f'{r['observed']:.3f}'}, wanted {at} {r['bound']:.3f}" + (f" ({r['note']})" if r["note"] and not r["passed"] else "")
    failed = sum(not r["passed"] for r in rows)
    yield RULE
    yield f"FAIL: {failed} of {len(rows)} thresholds" if failed else f"PASS: {len(rows)} thresholds"


def corpus(listing: DataFrame) -> Iterator[str]:
    """A line for each label of `corpus.listing`, then totals and what has no source."""
    yield f"{'document':<28}{'source':>8}{'pages':>7}{'fields':>8}{'stated':>8}{'ambiguous':>11}  scanned"
    for r in listing.toLocalIterator():
        yield f"{r['doc_id']:<28}{r['kind']:>8}{r['pages']:>7}{r['n_fields']:>8}{r['n_stated']:>8}{r['n_ambiguous']:>11}  {'yes' if r['scanned'] else ''}"
    t = listing.agg(F.count("*"), F.sum("n_fields"), F.sum("n_stated"), F.sum("n_ambiguous"), F.count_if(F.col("kind") == "missing")).first()
    n, fields, stated, ambiguous, missing = (x or 0 for x in t)
    yield from (RULE, f"{n} labels, {missing} without a source; {fields} fields: {stated} stated, {fields - stated} absent (these test for inventions), {ambiguous} ambiguous (these test abstention)")


def sweep(rows: DataFrame) -> Iterator[str]:
    """A line for each configuration of `frontier.sweep`, those on the frontier marked, and who comes near the best for less."""
    yield f"{'configuration':<28}{'accuracy':>9}{'grounded':>9}{'invented':>9}{'abst. prec.':>12}{'$ a document':>13}{'p50 s':>8}"
    for r in rows.orderBy(F.desc_nulls_last("accuracy"), "label").toLocalIterator():
        cost = "n/a" if r["cost"] is None else f"{r['cost']:.4f}"
        p50 = "n/a" if r["latency_p50"] is None else f"{r['latency_p50']:.2f}"
        yield (f"{r['label']:<28}{percent(r['accuracy']):>9}{percent(r['grounding_rate']):>9}{percent(r['hallucination_rate']):>9}{percent(r['abstention_precision']):>12}{cost:>13}{p50:>8}" + "  *" * r["on_frontier"])
    yield from (RULE, "* no other configuration is as accurate for as little")
    for r in frontier.near_best(rows).orderBy("label").toLocalIterator():
        yield f"{r['label']} has {percent(r['accuracy_share'])} of the accuracy of {r['best']} at {percent(r['cost_share'])} of its cost"
