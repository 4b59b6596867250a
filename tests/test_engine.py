import json
import random
import sys

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from veriloom import cli, render, schemas
from veriloom.functions import columns as C
from veriloom.operators import frontier, gate, ratios, scoring, selective
from veriloom.operators.extract import Heuristic, Model, Replay, Reply, UsageError, build
from veriloom.operators.verify import admit, verify
from veriloom.plans.run import artifact, run_corpus, score_run
from veriloom.sources import corpus, fixtures, imports, runs

LABELS = {
    "a": [("revenue_ltm", 1_250_000.0, False), ("total_debt", 400_000.0, False), ("cash", 60_000.0, False), ("interest_expense", 20_000.0, False), ("cfads", None, False), ("principal_repayments", 5_000.0, False)],
    "b": [("revenue_ltm", 5.0, True), ("total_debt", None, False), ("cash", None, True)],
}
PAGES = {"a": ["Accounts in $'000\nTotal revenue 1,250 1,100\nTotal debt 400\nCash 50\n", "Finance costs\n(20)\n"], "b": ["Turnover 5\nDebt\nCash at bank 7\n"]}


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    for folder in ("golden", "text"):
        (root / folder).mkdir()
    for d, fields in LABELS.items():
        (root / "golden" / f"{d}.json").write_text(json.dumps({"doc_id": d, "fields": [{"name": n, "value": v, "ambiguous": a} for n, v, a in fields]}))
        (root / "text" / f"{d}.json").write_text(json.dumps({"pages": PAGES[d]}))
    (root / "thresholds.json").write_text('{"metrics": {"accuracy": 0.6, "field.cash.hallucination_rate": {"max": 1}, "selective.coverage": {"min": 0}}}')
    return root


@pytest.fixture(scope="module")
def examples(tmp_path_factory):
    root = tmp_path_factory.mktemp("examples")
    fixtures.write_example(str(root))
    return root


@pytest.fixture(scope="module")
def run(spark, examples):
    return run_corpus(spark, str(examples), Heuristic())


def test_every_outcome_is_as_made(run):
    """Known by construction, and the same totals as the published baseline: 19, 8, 3, 1, 15, 2 of 48 fields."""
    kinds = dict(zip("CMOHAU", schemas.OUTCOMES[:4] + schemas.OUTCOMES[4:]))
    got = {(r.doc_id, r.name): r.outcome for r in run.fields.collect()}
    assert got == {(d, item): kinds[k] for d, row in fixtures.OUTCOMES.items() for item, k in zip(schemas.ITEMS, row)}
    overall = run.report.where("scope = 'overall'").first()
    assert [overall[o] for o in schemas.OUTCOMES] == [19, 8, 3, 1, 15, 2]
    assert (overall.accuracy, overall.coverage, overall.hallucination_rate, overall.omission_rate) == (0.59375, 0.90625, 0.0625, 0.09375)
    assert overall.grounding_rate == pytest.approx(28 / 30) and overall.n_abstained == 18
    ambiguous = run.report.where("scope = 'ambiguous'").first()
    assert ambiguous.n_fields == len(fixtures.AMBIGUOUS)


def by_hand(row):
    """The four ratios of one document's values, worked out one by one; null where they are refused."""
    v = dict(zip(schemas.ITEMS, row))
    bad = lambda *items: any(v[i] == "rejected" for i in items)
    adjusted = None if v["ebitda_reported"] is None or bad("ebitda_reported", "ebitda_addbacks") else v["ebitda_reported"] + (v["ebitda_addbacks"] or 0)
    leverage = None if v["total_debt"] is None or bad("total_debt", "cash") or not adjusted or adjusted <= 0 else (v["total_debt"] - (v["cash"] or 0)) / adjusted
    legs = (v["interest_expense"], v["principal_repayments"])
    flow = adjusted if v["cfads"] is None else v["cfads"]
    dscr = None if bad("cfads", "interest_expense", "principal_repayments") or flow is None or None in legs or sum(legs) <= 0 else flow / sum(legs)
    return {"ltm_revenue": None if bad("revenue_ltm") else v["revenue_ltm"], "adjusted_ebitda": adjusted, "leverage": leverage, "dscr": dscr}


def test_ratios_of_the_examples_by_hand(run):
    claimed = {"C": lambda x: x, "M": lambda x: 3 * x, "H": lambda x: x, "U": lambda x: "rejected", "O": lambda x: None, "A": lambda x: None}
    counts = dict.fromkeys(schemas.RATIO_OUTCOMES, 0)
    for d, (name, kinds) in enumerate(fixtures.OUTCOMES.items()):
        values = [fixtures.value_of(d, i) for i in range(8)]
        got, want = by_hand([claimed[k](x) for k, x in zip(kinds, values)]), by_hand([None if k in "AH" else x for k, x in zip(kinds, values)])
        rows = {r.ratio: r for r in run.comparisons.where(F.col("doc_id") == name).collect()}
        for ratio in schemas.RATIOS:
            assert (rows[ratio].extracted, rows[ratio].expected) == (pytest.approx(got[ratio]), pytest.approx(want[ratio])), (name, ratio)
            outcome = (
                "both_abstained" if got[ratio] is want[ratio] is None else "extraction_abstained" if got[ratio] is None else "golden_abstained" if want[ratio] is None
                else "agree" if abs(got[ratio] - want[ratio]) <= 0.01 * max(abs(got[ratio]), abs(want[ratio])) else "disagree")
            assert rows[ratio].outcome == outcome
            counts[outcome] += 1
    r = run.ratio_summary.first()
    assert {o: r[o] for o in schemas.RATIO_OUTCOMES} == counts and r.safety == pytest.approx((counts["agree"] + counts["both_abstained"] + counts["extraction_abstained"]) / 24)


def test_selective_summary_by_hand(run):
    rows = [r for r in run.fields.collect() if r.actual is not None]
    half = {d: i % 2 for i, d in enumerate(sorted(fixtures.OUTCOMES))}
    right = sorted(1 - r.confidence for r in rows if half[r.doc_id] == 0 and r.outcome == "correct")
    k = -(-(len(right) + 1) * 9 // 10)
    cut = 1 - right[k - 1] if k <= len(right) else selective.IMPOSSIBLE
    test = [r for r in rows if half[r.doc_id] == 1]
    answered = [r for r in test if r.confidence >= cut]
    s = run.selective.first()
    assert (s.n_items, s.n_calibration_correct, s.n_test, s.threshold) == (30, len(right), len(test), pytest.approx(cut))
    assert s.coverage == pytest.approx(len(answered) / len(test)) and s.baseline_error == pytest.approx(11 / 30)


def test_the_artifact_is_whole(spark, run, tmp_path):
    path = f"{tmp_path}/{run.run_id}"
    runs.save_run(artifact(run, spark), path, run.documents)
    kept = runs.as_dict(spark, path)
    assert {"run_id", "extractor", "corpus_root", "created_at", "alpha", "verified", "skipped", "report", "latency_p50", "cost_per_document", "ratios", "selective", "documents"} <= set(kept)
    assert kept["report"]["overall"]["taxonomy"] == dict(zip(schemas.OUTCOMES, [19, 8, 3, 1, 15, 2])) and list(kept["report"]["per_field"]) == list(schemas.ITEMS)
    assert kept["report"]["n_documents"] == 6 and kept["report"]["n_fields"] == 48 and kept["latency_p50"] >= 0 and kept["cost_per_document"] == 0
    assert len(kept["selective"]["curve"]["coverage"]) == kept["selective"]["n_distinct_confidences"] and sum(kept["ratios"]["counts"].values()) == 24
    assert [d["doc_id"] for d in kept["documents"]] == sorted(fixtures.OUTCOMES)
    first = kept["documents"][0]
    assert [f["name"] for f in first["fields"]] == list(schemas.ITEMS) and [r["name"] for r in first["ratios"]] == list(schemas.RATIOS) and first["n_pages"] == 2 and first["source"]
    debt = first["fields"][0]
    assert debt["quote"].startswith("Total revenue") and debt["page"] == 1 and debt["raw_value"] == fixtures.value_of(0, 0) and debt["note"] == "made as C" and debt["outcome"] == "correct"
    assert first["ratios"][0]["inputs_used"] == ["revenue_ltm"]


def test_reports_as_text(spark, run, examples, capsys):
    text = "\n".join(render.run(run, verbose=True))
    for part in ("59.4%", "90.6%", "93.3%", "6.2%", "Outcomes", "hallucination", "example-6", "revenue_ltm (", "no threshold" if not run.selective.first().threshold_supported else "threshold"):
        assert part in text, part
    assert cli.main(["corpus", str(examples)], spark) == cli.OK and "48 fields: 32 stated, 16 absent" in capsys.readouterr().out
    assert cli.main(["gate", str(examples)], spark) == cli.OK and "PASS: 6 thresholds" in capsys.readouterr().out
    assert cli.main(["sweep", str(examples), "--extractor", "heuristic,offline"], spark) == cli.OK
    out = capsys.readouterr().out
    assert "heuristic" in out and "59.4%" in out and "offline failed" in out


def test_a_small_corpus(spark, small):
    run = run_corpus(spark, str(small), Heuristic())
    got = {(r.doc_id, r.name): r.outcome for r in run.fields.collect()}
    assert got == {
        ("a", "revenue_ltm"): "correct", ("a", "total_debt"): "correct", ("a", "cash"): "mismatch", ("a", "interest_expense"): "mismatch", ("a", "cfads"): "correct_abstention",
        ("a", "principal_repayments"): "omission", ("b", "revenue_ltm"): "correct", ("b", "total_debt"): "correct_abstention", ("b", "cash"): "hallucination"}
    scopes = {r.scope: r for r in run.report.collect()}
    assert scopes["overall"].accuracy == 0.5 and scopes["ambiguous"].hallucination_rate == 1.0 and scopes["field.cfads"].accuracy is None
    assert scopes["overall"].grounding_rate == 1.0 and sum(scopes[f"field.{n}"].n_fields for n in {n for f in LABELS.values() for n, _, _ in f}) == 9
    again = run_corpus(spark, str(small), Heuristic())
    assert {(r.doc_id, r.name): r.outcome for r in again.fields.collect()} == got
    blind = run_corpus(spark, str(small), Heuristic(), check=False)
    assert blind.report.where("scope = 'overall'").first().n_grounded_true == 0


def test_cli_exit_codes(spark, small, tmp_path, capsys):
    root, strict = str(small), tmp_path / "t.json"
    assert cli.main(["gate", root], spark) == cli.BREACH  # accuracy is 0.5
    for text, code in (('{"metrics": {"accuracy": 0.5}}', cli.OK), ('{"metrics": {"accuracies": 0.5}}', cli.USAGE), ("{", cli.USAGE)):
        strict.write_text(text)
        assert cli.main(["gate", root, "--thresholds", str(strict)], spark) == code
    assert cli.main(["corpus", str(tmp_path)], spark) == cli.USAGE
    assert cli.main(["run", root, "--extractor", "nobody"], spark) == cli.USAGE
    assert cli.main(["sweep", root, "--extractor", "heuristic,nobody"], spark) == cli.OK
    assert cli.main(["extract", root], spark) == cli.OK and cli.main(["corpus", root], spark) == cli.OK
    assert cli.main(["run", root, "--save", str(tmp_path / "runs")], spark) == cli.OK
    assert "hallucination" in capsys.readouterr().out
    (tmp_path / "runs" / "bad" / "run").mkdir(parents=True)
    (tmp_path / "runs" / "bad" / "run" / "x.txt").write_text("not json")
    listed = runs.list_runs(spark, f"{tmp_path}/runs/*/run/*.txt").collect()
    assert [(r.extractor, r.error is None) for r in listed] == [("heuristic", True), (None, False)]


def test_outcome_precedence(spark):
    rows = [("a", None, None, None), ("b", None, None, 1.0), ("c", 5.0, False, 5.0), ("d", 5.0, None, None), ("e", 5.0, True, 5.9), ("f", 500.0, None, 550.0), ("g", 5.0, False, None)]
    df = spark.createDataFrame([(*r, False) for r in rows], "name string, actual double, grounded boolean, expected double, ambiguous boolean")
    got = {r.name: r.outcome for r in scoring.with_outcome(df).collect()}
    assert got == {"a": "correct_abstention", "b": "omission", "c": "ungrounded", "d": "hallucination", "e": "correct", "f": "mismatch", "g": "ungrounded"}


def test_empty_reports_are_undefined(spark):
    empty = spark.createDataFrame([], "doc_id string, name string, expected double, ambiguous boolean, actual double, grounded boolean, confidence double, outcome string")
    rows = {r.scope: r for r in scoring.report(empty).collect()}
    assert set(rows) == {"overall", "ambiguous"} and rows["overall"].accuracy is None and rows["overall"].n_fields == 0
    s = selective.summarise(empty).first()
    assert s.threshold == selective.IMPOSSIBLE and s.aurc == 0.0 and s.coverage == 0.0 and s.guarantee_held


def test_extra_and_missing_claims(spark):
    golden = spark.createDataFrame([("d", "cash", 5.0, False), ("d", "cfads", 7.0, False)], "doc_id string, name string, expected double, ambiguous boolean")
    claims = spark.createDataFrame([("d", "cash", 1, 9.0, 1.0, None, 0.5), ("d", "cash", 0, 5.0, 1.0, None, 0.5), ("d", "total_debt", 0, 1.0, 1.0, None, 0.5)],
                                   "doc_id string, name string, pos int, value double, unit_scale double, grounded boolean, confidence double")
    got = {r.name: r.outcome for r in scoring.score_fields(golden, claims).collect()}
    assert got == {"cash": "correct", "cfads": "omission"}


def inputs(spark, **values):
    """Wide ratio inputs of one document; a tuple is a rejected value."""
    row = {"doc_id": "d"}
    for item in schemas.ITEMS:
        v = values.get(item)
        row[item] = v if not isinstance(v, tuple) else None
        row[f"{item}_status"] = "rejected" if isinstance(v, tuple) else "missing" if v is None else "ok"
    schema = "doc_id string, " + ", ".join(f"{i} double, {i}_status string" for i in schemas.ITEMS)
    return spark.createDataFrame([tuple(row[c.split()[0]] for c in schema.split(", "))], schema)


FULL = {"revenue_ltm": 100.0, "ebitda_reported": 20.0, "ebitda_addbacks": 5.0, "total_debt": 60.0, "cash": 10.0, "interest_expense": 4.0, "principal_repayments": 6.0, "cfads": 15.0}


@pytest.mark.parametrize(("change", "ratio", "value", "reason"), [
    ({}, "leverage", 2.0, ""), ({}, "dscr", 1.5, ""), ({"cash": None}, "leverage", 2.4, "CASH not disclosed; treated as 0"), ({"cash": (1,)}, "leverage", None, "CASH failed"),
    ({"ebitda_addbacks": None}, "adjusted_ebitda", 20.0, "EBITDA_ADDBACKS not disclosed; treated as 0"), ({"ebitda_reported": -30.0}, "leverage", None, "non-positive (-25)"),
    ({"cfads": None}, "dscr", 2.5, "CFADS not disclosed; adjusted EBITDA used as proxy"), ({"cfads": (1,)}, "dscr", None, "CFADS failed"),
    ({"interest_expense": None}, "dscr", None, "(INTEREST_EXPENSE missing)"), ({"interest_expense": None, "principal_repayments": None}, "dscr", None, "(INTEREST_EXPENSE, PRINCIPAL_REPAYMENTS missing)"),
    ({"interest_expense": -4.0}, "dscr", None, "INTEREST_EXPENSE is negative"), ({"interest_expense": 0.0, "principal_repayments": 0.0}, "dscr", None, "non-positive (0)"),
    ({"cfads": -15.0}, "dscr", -1.5, ""), ({"cash": 110.0}, "leverage", -2.0, ""), ({"revenue_ltm": (1,)}, "ltm_revenue", None, "REVENUE_LTM failed"),
])
def test_ratios(spark, change, ratio, value, reason):
    row = ratios.ratio_rows(inputs(spark, **FULL | change)).where(F.col("ratio") == ratio).first()
    assert row.value == (value if value is None else pytest.approx(value)) and reason in row.reason
    assert row.abstained == (value is None) and (row.inputs == []) == (value is None)


def test_ratio_inputs_in_order(spark):
    got = {r.ratio: r.inputs for r in ratios.ratio_rows(inputs(spark, **FULL)).collect()}
    assert got["leverage"] == ["total_debt", "cash", "ebitda_reported", "ebitda_addbacks"] and got["dscr"] == ["cfads", "interest_expense", "principal_repayments"]


@pytest.mark.parametrize("x", [0.0, 1.0, -25.0, 123456.0, 1234567.0, 0.5, 0.0001, 0.00001234, -3.14159265, 999999.5, 12.5])
def test_general_format(spark, x):
    assert spark.range(1).select(ratios.general(F.lit(x))).first()[0] == f"{x:g}"


def items(spark, pairs):
    return spark.createDataFrame([(0, float(c), bool(ok)) for c, ok in pairs], "doc_id int, confidence double, correct boolean")


def test_threshold_is_the_order_statistic(spark):
    cal = items(spark, [(c / 20, True) for c in range(1, 21)] + [(0.99, False)])
    row = selective.threshold(cal, 0.1).first()
    scores = sorted(1.0 - c / 20 for c in range(1, 21))
    assert row.k == 19 and row.threshold == 1.0 - scores[18]
    assert selective.threshold(items(spark, [(0.9, True)] * 8), 0.1).first().threshold == selective.IMPOSSIBLE
    assert selective.threshold(items(spark, [(0.9, True)] * 9), 0.1).first().threshold == pytest.approx(0.9)
    with pytest.raises(ValueError):
        selective.threshold(cal, 1.0)


@pytest.mark.parametrize("buckets", [1, 3, 200])
def test_documents_alternate(spark, buckets):
    ids = sorted(f"doc {i * 37 % 1000:x}é" for i in range(0, 1000, 3))
    df = spark.createDataFrame([(i,) for i in ids * 2], "doc_id string").repartition(5)
    assert {r.doc_id: r.half for r in selective.split_documents(df, buckets).collect()} == {d: n % 2 for n, d in enumerate(ids)}


def test_curve_and_area(spark):
    rows = selective.risk_coverage(items(spark, [(0.9, True), (0.9, False), (0.5, True), (0.1, False)])).orderBy("coverage").collect()
    assert [(r.coverage, r.risk) for r in rows] == [(0.5, 0.5), (0.75, pytest.approx(1 / 3)), (1.0, 0.5)]
    good = items(spark, [(0.9 - i / 100, True) for i in range(20)] + [(0.3 - i / 100, False) for i in range(10)])
    bad = good.withColumn("confidence", 1 - F.col("confidence"))
    assert selective.aurc(good).first()[0] < selective.aurc(bad).first()[0] and selective.aurc(items(spark, [(0.5, True)])).first()[0] == 0.0


def test_verification(spark):
    docs = spark.createDataFrame([("d", ["Total debt 1,250\nInterest (842)", "x"])], schemas.TEXT)
    rows = [("cash", None, 1, "x"), ("total_debt", 1250.0, 1, "Total debt 1,250"), ("total_debt", 1250.0, 2, "Total debt 1,250"), ("total_debt", 1250.0, 3, "Total debt 1,250"),
            ("total_debt", 9.0, 1, "Total debt 1,250"), ("interest_expense", 842.0, 1, "Interest (842)"), ("cash", 842.0, 1, "Interest (842)"), ("cash", 5.0, None, None)]
    claims = spark.createDataFrame([("d", i, n, v, 1.0, None, p, q, 0.5) for i, (n, v, p, q) in enumerate(rows)], schemas.CLAIM_ROWS)
    assert [r.grounded for r in verify(claims, docs).orderBy("pos").collect()] == [None, True, False, False, False, True, False, False]
    admitted = admit(claims, docs).orderBy("pos").collect()
    assert [r.problem is None for r in admitted] == [True, True, False, False, False, True, False, False]


def test_replay_keeps_the_last_admitted(spark):
    docs = spark.createDataFrame([("d", ["Cash 5\nCash 7"]), ("e", ["y"])], schemas.TEXT)
    rec = spark.createDataFrame([("d", 0, "cash", 5.0, 1.0, None, 1, "Cash 5", 0.5), ("d", 1, "cash", 7.0, 0.0, None, 1, "Cash 7", 3.0), ("d", 2, "cash", 8.0, 1.0, None, 1, "Cash 7", 0.5)], schemas.CLAIM_ROWS)
    got = Replay(rec).claims(docs)
    assert got.count() == 16
    row = got.where("doc_id = 'd' and name = 'cash'").first()
    assert (row.value, row.unit_scale, row.confidence) == (7.0, 1.0, 1.0)


def claim(**x):
    return {"name": "cash", "value": 5, "unit_scale": 1, "currency": None, "page": 1, "quote": "Cash 5", "confidence": 0.9} | x


def answer(*claims):
    return json.dumps({"fields": list(claims)})


def asking(*replies):
    """A model that gives these replies in turn, and what it was asked."""
    asked = []

    def ask(prompt):
        asked.append(prompt)
        reply = replies[len(asked) - 1]
        if isinstance(reply, Exception):
            raise reply
        return reply

    return ask, asked


def test_model_asks_again_with_what_was_wrong(spark):
    ask, asked = asking(answer(claim(quote="Cash 6"), claim(name="cfads", value=None, page=None, quote=None)), "prose " + answer(claim()) + " end")
    taken = Model(ask).document(["Cash 5"])
    assert taken.found["cash"]["value"] == 5 and taken.found["cfads"]["value"] is None and "not on page 1" in asked[1] and taken.retries == 1
    text = answer(claim())
    fields = Model(lambda p: text).claims(spark.createDataFrame([("d", ["Cash 5"])], schemas.TEXT))
    assert fields.where("name = 'cash'").first().value == 5.0 and fields.count() == 8


@pytest.mark.parametrize("bad", ["not json", '{"fields": [{"name": "not-an-item"}]}', "{}", '{"fields": 5}', answer(claim(extra=1)), answer(claim(value="five")), '{"fields": [}'])
def test_model_asks_again_after_an_unreadable_reply(bad):
    ask, asked = asking(bad, answer(claim()))
    taken = Model(ask).document(["Cash 5"])
    assert taken.found["cash"]["value"] == 5 and taken.retries == 1 and "not what was asked for" in asked[1] and taken.error is None
    ask, asked = asking(bad, bad)
    assert Model(ask).document(["Cash 5"]).found == {} and len(asked) == 2
    ask, asked = asking(bad)
    assert Model(ask, retries=0).document(["Cash 5"]).retries == 0 and len(asked) == 1


def test_a_failed_call_or_a_refusal_ends_the_attempts():
    for last in (RuntimeError("reset"), Reply(None), Reply("x", refused=True)):
        ask, asked = asking(answer(claim(), claim(name="total_debt", value=7)), last)
        taken = Model(ask, retries=5).document(["Cash 5"])
        assert set(taken.found) == {"cash"} and taken.error and len(asked) == 2
    ask, asked = asking()
    assert Model(ask).document([]).error == "no pages" and asked == []


def test_a_runs_tokens_costs_and_retries(spark):
    replies = iter([Reply(answer(claim(quote="Cash 6")), 1000, 200, 50, 20), Reply(answer(claim()), 1000, 200), Reply(answer(claim()), 500, 100)])
    documents = spark.createDataFrame([("d", ["Cash 5"]), ("e", ["Cash 5"])], schemas.TEXT).coalesce(1)
    model = Model(lambda p: None, name="m", model="big", prices=(5.0, 25.0))
    rows = [(d, model_document(model, replies)) for d in ("d", "e")]
    each = 1000 * 5 + 200 * 25
    assert [t.cost_usd for _, t in rows] == [pytest.approx((2 * each + 50 * 0.5 + 20 * 6.25) / 1e6), pytest.approx(each / 2e6)]
    reply = Reply(answer(claim()), 1000, 200)
    priced = Model(lambda p: reply, prices=(5.0, 25.0))
    golden = spark.createDataFrame([("d", "cash", 5.0, False), ("e", "cash", 6.0, True)], "doc_id string, name string, expected double, ambiguous boolean")
    done = score_run(golden, documents, priced)
    t = done.totals.first()
    assert (t.n_documents, t.total_input_tokens, t.total_output_tokens, t.total_retries, t.total_cost_usd) == (2, 2000, 400, 0, pytest.approx(2 * each / 1e6))
    assert done.latency.first().cost_per_document == pytest.approx(each / 1e6) and done.latency.first().latency_p50 >= 0
    assert {r.doc_id: r.input_tokens for r in done.documents.collect()} == {"d": 1000, "e": 1000}


def model_document(model, replies):
    model.ask = lambda prompt: next(replies)
    return model.document(["Cash 5"])


def test_a_model_behind_a_program():
    reply = answer(claim())
    taken = build("command", argv=[sys.executable, "-c", f"import sys; sys.stdin.read(); print('so: ' + {reply!r})"]).document(["Cash 5"])
    assert taken.found["cash"]["value"] == 5 and taken.cost_usd == 0
    assert "ended with 3" in build("command", argv=[sys.executable, "-c", "raise SystemExit(3)"]).document(["Cash 5"]).error
    for bad in ({"name": "command", "argv": ["no-such-program"]}, {"name": "command"}, {"name": "offline"}, {"name": "nobody"}, {"name": "heuristic", "model": "big"}):
        with pytest.raises(UsageError):
            build(**bad)


def test_pdfs_with_a_parser(spark, tmp_path):
    """Any parser will do; one that fails makes a document without pages, whose error is on its row."""
    for folder in ("golden", "text", "pdfs"):
        (tmp_path / folder).mkdir()
    for d in ("a", "b", "c"):
        (tmp_path / "golden" / f"{d}.json").write_text(json.dumps({"doc_id": d, "fields": [{"name": "cash", "value": 5.0}]}))
    (tmp_path / "text" / "a.json").write_text('{"pages": ["Cash 9"]}')
    (tmp_path / "pdfs" / "a.pdf").write_bytes(b"%PDF-Cash 5\x0cmore")
    (tmp_path / "pdfs" / "b.pdf").write_bytes(b"%PDF-broken")
    (tmp_path / "pdfs" / "c.pdf").write_bytes(b"no")

    def parser(data):
        if b"broken" in data:
            raise ValueError("unreadable")
        return data[5:].decode().split("\x0c")

    done = run_corpus(spark, str(tmp_path), Heuristic(), parser=parser)
    rows = {r.doc_id: r for r in done.documents.collect()}
    assert {d: (r.n_pages, r.fields[0].outcome, r.error) for d, r in rows.items()} == {"a": (2, "correct", None), "b": (0, "omission", "ValueError: unreadable"), "c": (0, "omission", "empty, too large or no PDF")}
    assert run_corpus(spark, str(tmp_path), Heuristic()).fields.first().outcome == "mismatch"  # without a parser the text counts
    with pytest.raises(corpus.CorpusError):
        corpus.document(spark, str(tmp_path), "b")


def test_running_sums(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(300) / 300, rng.randrange(5)) for _ in range(2000)]
    for down in (False, True):
        got = selective.running(spark.createDataFrame(rows, "x double, n int").groupBy("x").agg(F.sum("n").alias("n")), "x", {"upto": "n"}, down, 7).collect()
        for r in got:
            assert r.upto == sum(n for x, n in rows if (x >= r.x if down else x <= r.x))
    placed = imports.positioned(spark.createDataFrame(rows, "x double, n int").repartition(5), "x").orderBy("position").collect()
    assert [r.position for r in placed] == list(range(2000)) and [r.x for r in placed] == sorted(x for x, _ in rows)


def test_thresholds():
    rows, undefined = gate.thresholds('{"allow_undefined": true, "metrics": {"accuracy": 0.5, "field.cash.accuracy": {"max": 1, "note": "n"}}}')
    assert undefined and rows == [("accuracy", "min", 0.5, ""), ("field.cash.accuracy", "max", 1.0, "n")]
    for bad in ("{", "{}", '{"metrics": {}}', '{"metrics": {"x": 1}}', '{"metrics": {"accuracy": true}}', '{"metrics": {"accuracy": {"min": 1, "max": 2}}}', '{"metrics": {"accuracy": {}}}'):
        with pytest.raises(gate.GateError):
            gate.thresholds(bad)


def test_undefined_metrics(spark):
    values = spark.createDataFrame([("accuracy", None)], "metric string, value double")
    limits = gate.threshold_table(spark, [("accuracy", "min", 0.5, "")])
    assert [gate.grade(values, limits, u).first().passed for u in (False, True)] == [False, True]


def test_pareto(spark):
    rows = [("a", 0.9, 10.0), ("b", 0.8, 5.0), ("c", 0.7, 6.0), ("d", 0.8, 5.0), ("e", None, 1.0), ("f", 0.95, None), ("g", 0.9, 12.0)]
    df = spark.createDataFrame(rows, "label string, accuracy double, cost double")
    assert {r.label for r in frontier.pareto(df).collect()} == {"a", "b", "d"}


def test_imports(spark, tmp_path):
    import lzma

    text = "a.pdf\tincome town\t\t\t\tIncome\\n5\nb.pdf\tincome\t\t\t\tx\nc.pdf\ttown\t\t\t\ty\n"
    (tmp_path / "in.tsv.xz").write_bytes(lzma.compress(text.encode()))
    (tmp_path / "expected.tsv.xz").write_bytes(lzma.compress(b"income=1,000 income=2\ntown=x\ntown=y\n"))
    cells = F.split("line", "\t")
    left = imports.read_xz(spark, f"{tmp_path}/in.tsv.xz").select("position", *(cells[i].alias(c) for i, c in enumerate(imports.COLUMNS)))
    right = imports.read_xz(spark, f"{tmp_path}/expected.tsv.xz").select("position", F.col("line").alias("expected"))
    got = {r.doc_id: r for r in imports.import_rows(imports.zip_by_position(left, right), {"income": "revenue_ltm"}).collect()}
    assert set(got) == {"import-a", "import-b"} and got["import-a"].pages == ["Income\n5"]
    assert got["import-a"].fields[0].value == 1000.0 and got["import-a"].fields[0].ambiguous and got["import-b"].fields[0].value is None
    with pytest.raises(PySparkException):
        imports.zip_by_position(left, right.where("position > 0")).collect()


def test_corpus_sources(spark, tmp_path):
    for folder in ("golden", "text", "pdfs"):
        (tmp_path / folder).mkdir()
    for d in ("a", "b", "c"):
        (tmp_path / "golden" / f"{d}.json").write_text(json.dumps({"doc_id": d, "fields": [{"name": "cash", "value": 5.0, "ambiguous": d == "a"}, {"name": "cfads", "value": None}]}))
    (tmp_path / "text" / "a.json").write_text(json.dumps({"pages": ["Cash 5"]}))
    (tmp_path / "text" / "z.json").write_text(json.dumps({"doc_id": "z", "pages": []}))
    (tmp_path / "pdfs" / "b.pdf").write_bytes(b"%PDF-1.7")
    (tmp_path / "pdfs" / "y.pdf").write_bytes(b"no")
    root = str(tmp_path)
    records, text, pdfs = corpus.golden_records(spark, root), corpus.text_documents(spark, root), corpus.pdf_files(spark, root)
    assert {r.doc_id: r.kind for r in corpus.resolve(records, text, pdfs).collect()} == {"a": "text", "b": "pdf", "c": "missing"}
    assert {r.doc_id for r in corpus.unlabelled(records, text, pdfs).collect()} == {"y", "z"}
    assert {r.doc_id: r.valid for r in pdfs.collect()} == {"b": True, "y": False}
    assert tuple(corpus.inventory(records).first()) == (3, 6, 3, 3, 1)
    done = run_corpus(spark, root, Heuristic())
    assert {r.doc_id for r in done.skipped.collect()} == {"b", "c"} and done.report.where("scope = 'overall'").first().n_fields == 2
    (tmp_path / "golden" / "d.json").write_text('{"doc_id": "d", "fields": [{"name": "sales"}]}')
    with pytest.raises(PySparkException):
        corpus.golden_fields(corpus.golden_records(spark, root)).collect()


def test_columns(spark):
    row = spark.range(1).select(
        C.clamp(F.lit("2")).alias("a"), C.clamp(F.lit("x")).alias("b"), C.clamp(F.lit("-1")).alias("c"), C.json_block(F.lit("a {b} c} d")).alias("d"), C.json_block(F.lit("none")).alias("e"),
        C.percent(F.lit(None).cast("double")).alias("f"), C.bar(F.lit(1), F.lit(2)).alias("g"), C.bar(F.lit(1), F.lit(0)).alias("h"), C.first_of_keys(F.lit("a=1 a=2 x b==3")).alias("i"),
        C.numbers_match(F.lit(None).cast("double"), F.lit(None).cast("double")).alias("j")).first()
    assert (row.a, row.b, row.c, row.d, row.e, row.f, row.g, row.h, row.i, row.j) == (1.0, 0.0, 0.0, "{b} c}", None, "n/a", "#" * 14 + "." * 14, "", {"a": "1", "b": "=3"}, False)


def test_streaming_scores_once(spark, tmp_path):
    from veriloom.streaming.scoring import score_stream

    schema = "doc_id string, name string, value double, unit_scale double, grounded boolean, confidence double, at timestamp"
    rows = [("d", "cash", 5.0, 1.0, True, 0.9)]
    for i in range(2):
        spark.createDataFrame([(*r,) for r in rows], "doc_id string, name string, value double, unit_scale double, grounded boolean, confidence double").withColumn("at", F.timestamp_seconds(F.lit(1000 + i))).write.mode("append").json(f"{tmp_path}/in")
    golden = spark.createDataFrame([("d", "cash", 5.0, False)], "doc_id string, name string, expected double, ambiguous boolean")
    stream = score_stream(spark.readStream.schema(schema).json(f"{tmp_path}/in"), golden)
    q = stream.writeStream.format("memory").queryName("scored_claims").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert [(r.doc_id, r.outcome) for r in spark.table("scored_claims").collect()] == [("d", "correct")]
