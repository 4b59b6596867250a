"""A run: documents, labels and an extractor in; scores, ratios, the selective summary and addressable metrics out."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.operators import attempts, gate, ratios, scoring, selective
from veriloom.operators.extract import Extractor, claims
from veriloom.operators.verify import unverified, verify
from veriloom.schemas import ITEMS, OUTCOMES, RATES, RATIO_OUTCOMES
from veriloom.sources import corpus


@dataclass
class Run:
    run_id: str
    extractor: str
    corpus_root: str
    created_at: str
    alpha: float
    verified: bool
    extractions: DataFrame
    claims: DataFrame
    fields: DataFrame
    report: DataFrame
    totals: DataFrame
    latency: DataFrame
    comparisons: DataFrame
    ratio_summary: DataFrame
    selective: DataFrame
    curve: DataFrame
    metrics: DataFrame
    documents: DataFrame
    skipped: DataFrame


def score_run(
    golden: DataFrame, documents: DataFrame, extractor: Extractor, check: bool = True, alpha: float = 0.1, run_id: str | None = None,
    skipped: DataFrame | None = None, root: str = "", records: DataFrame | None = None,
) -> Run:
    """`golden` is (doc_id, name, expected, ambiguous, perhaps pos and note), `documents` (doc_id, pages, perhaps error), `records`
    the labels' (doc_id, source, scanned). Labels without a document take no part.

    Extractions and scored fields are persisted: the extractor, the dear step, runs once for all that reads them.
    """
    now = datetime.now(timezone.utc)
    run_id = run_id or f"{now:%Y%m%dT%H%M%SZ}-{extractor.name}"
    here = golden.join(documents.select("doc_id"), "doc_id", "left_semi")
    extractions = extractor.extract(documents).persist()
    rows = claims(extractions)
    rows = (verify(rows, documents) if check else unverified(rows)).persist()
    fields = scoring.score_fields(here, rows).persist()
    report = scoring.report(fields)
    first = scoring.first_claims(rows).select("doc_id", "name", (F.col("value") * F.col("unit_scale")).alias("value"), "grounded")
    truth = here.select("doc_id", "name", F.col("expected").alias("value"), F.lit(None).cast("boolean").alias("grounded"))
    comparisons = ratios.compare(ratios.wide(first), ratios.wide(truth)).persist()
    summary = ratios.summary(comparisons)
    chosen = selective.summarise(fields, alpha)
    return Run(
        run_id, extractor.name, root, now.isoformat(), alpha, check, extractions, rows, fields, report, scoring.totals(extractions), attempts.latency(extractions), comparisons, summary, chosen,
        selective.risk_coverage(selective.scored_items(fields)), gate.metrics(report, summary, chosen), _documents(documents, extractions, fields, comparisons, records),
        skipped if skipped is not None else here.select("doc_id").limit(0))


def _documents(documents: DataFrame, extractions: DataFrame, fields: DataFrame, comparisons: DataFrame, records: DataFrame | None) -> DataFrame:
    """A row for each document: what it is, what it took, its fields with note and evidence, its ratios; at most eight and four."""
    error = F.col("error") if "error" in documents.columns else F.lit(None).cast("string")
    heads = documents.select("doc_id", F.coalesce(F.size("pages"), F.lit(0)).alias("n_pages"), error.alias("unread"))
    took = extractions.select("doc_id", "latency_s", "cost_usd", "retries", "input_tokens", "output_tokens", "error")
    pos = F.col("pos") if "pos" in fields.columns else F.array_position(F.array(*map(F.lit, ITEMS)), F.col("name"))
    kept = [c for c in ("name", "outcome", "expected", "actual", "ambiguous", "grounded", "note", "confidence", "unit_scale", "currency", "raw_value", "page", "quote") if c in fields.columns]
    own = fields.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(pos.alias("pos"), *kept))).alias("fields"))
    order = F.array_position(F.array(*map(F.lit, ("ltm_revenue", "adjusted_ebitda", "leverage", "dscr"))), F.col("ratio"))
    ratio = F.struct(order.alias("pos"), F.col("ratio").alias("name"), "outcome", "extracted", "expected", "extracted_reason", "expected_reason", F.col("inputs").alias("inputs_used"))
    made = comparisons.groupBy("doc_id").agg(F.array_sort(F.collect_list(ratio)).alias("ratios"))
    rows = heads.join(took, "doc_id", "left").join(own, "doc_id", "left").join(made, "doc_id", "left")
    if records is not None:
        rows = rows.join(records.select("doc_id", "source", "scanned"), "doc_id", "left")
    else:
        rows = rows.withColumns({"source": F.lit(None).cast("string"), "scanned": F.lit(None).cast("boolean")})
    bare = lambda c, names: F.transform(c, lambda x: F.struct(*(x[n].alias(n) for n in names)))
    return rows.select(
        "doc_id", "n_pages", F.coalesce("scanned", F.lit(False)).alias("scanned"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("unread", "error").alias("error"),
        *("latency_s", "cost_usd", "retries", "input_tokens", "output_tokens"), bare("fields", kept).alias("fields"),
        bare("ratios", ("name", "outcome", "extracted", "expected", "extracted_reason", "expected_reason", "inputs_used")).alias("ratios"))


def run_corpus(spark: SparkSession, root: str, extractor: Extractor, check: bool = True, alpha: float = 0.1, run_id: str | None = None, parser: corpus.Parser | None = None) -> Run:
    """A run over a corpus folder. Labels whose source can't be found, or is a PDF without a `parser`, are skipped; a PDF that
    its parser can't read is a document without pages, on which every extractor abstains, with the error on its row."""
    records = corpus.golden_records(spark, root)
    resolved = corpus.resolve(records, corpus.text_documents(spark, root), corpus.pdf_files(spark, root))
    if not resolved.where("kind <> 'missing'").limit(1).count():
        raise corpus.CorpusError(f"{root}: no label has a document")
    documents = corpus.documents(spark, root, parser).join(records.select("doc_id"), "doc_id", "left_semi")
    skipped = resolved.join(documents, "doc_id", "left_anti").select("doc_id")
    return score_run(corpus.golden_fields(records), documents, extractor, check, alpha, run_id, skipped, root, records)


def _stats(scope: str) -> F.Column:
    """A scope's counters, outcomes and rates as a struct."""
    return F.struct(
        "n_fields", "n_answerable", "n_unanswerable", "n_attempted", "n_abstained", F.struct(*OUTCOMES).alias("taxonomy"), *RATES).alias(scope)


def artifact(run: Run, spark: SparkSession) -> DataFrame:
    """The run as one nested row, but for its documents, which are as many as they are; `sources.runs.save_run` writes both."""
    scope = lambda name: run.report.where(F.col("scope") == name).select(_stats(name))
    items = run.report.where("scope like 'field.%'").select(F.substring_index("scope", ".", -1).alias("item"), _stats("stats"))
    places = F.array_position(F.array(*map(F.lit, ITEMS)), F.col("item"))
    per_field = items.agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct(places.alias("pos"), "item", "stats"))), lambda x: F.struct(x["item"], x["stats"]))).alias("per_field"))
    overall = scope("overall").join(scope("ambiguous").withColumnRenamed("ambiguous", "on_ambiguous")).join(per_field).join(run.totals)
    report = overall.select(F.struct(
        "n_documents", F.col("overall.n_fields").alias("n_fields"), "total_cost_usd", "total_latency_s", "total_input_tokens", "total_output_tokens", "total_retries", "overall", "on_ambiguous", "per_field").alias("report"))
    ratio = run.ratio_summary.select(F.struct("agreement", "safety", F.struct(*RATIO_OUTCOMES).alias("counts")).alias("ratios"))
    points = run.curve.agg(F.array_sort(F.collect_list(F.struct("coverage", "risk"))).alias("p"))  # distinct confidences
    curve = points.select(F.struct(F.col("p.coverage").alias("coverage"), F.col("p.risk").alias("risk")).alias("curve"))
    chosen = run.selective.join(curve).select(F.when(F.col("n_items") > 0, F.struct(*run.selective.columns, "curve")).alias("selective"))
    skipped = run.skipped.agg(F.sort_array(F.collect_list("doc_id")).alias("skipped"))
    head = spark.createDataFrame([(run.run_id, run.extractor, run.corpus_root, run.created_at, run.alpha, run.verified)], "run_id string, extractor string, corpus_root string, created_at string, alpha double, verified boolean")
    return head.join(skipped).join(report).join(run.latency).join(ratio).join(chosen)


def inspect(documents: DataFrame, extractor: Extractor, line_items: DataFrame, golden: DataFrame | None = None) -> DataFrame:
    """All eight items of each document, claimed or not, with their label if there is one; no outcome, as nothing is graded."""
    found = scoring.first_claims(verify(extractor.claims(documents), documents))
    rows = documents.select("doc_id").crossJoin(F.broadcast(line_items)).join(found, ["doc_id", "name"], "left")
    if golden is not None:
        rows = rows.join(golden.select("doc_id", "name", "expected", "ambiguous", "note"), ["doc_id", "name"], "left")
    return rows
