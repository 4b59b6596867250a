"""`python -m veriloom.cli corpus|extract|run|gate|sweep|import|serve CORPUS`: exit code 0, 1 for a breach, 2 for bad data or usage."""

from __future__ import annotations

import argparse
import shlex
import sys
from collections.abc import Iterable, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom import render, schemas, web
from veriloom.operators import frontier, gate
from veriloom.operators.extract import REPLAYS, Extractor, UsageError, build
from veriloom.plans.run import artifact, inspect, run_corpus
from veriloom.sources import corpus, datasets, runs

OK, BREACH, USAGE = 0, 1, 2


def extractor_of(spark: SparkSession, name: str, args: argparse.Namespace) -> Extractor:
    return build(name, corpus.recorded_claims(spark, args.transcripts) if args.transcripts else None, shlex.split(args.command or ""), args.model)


def sweep(spark: SparkSession, root: str, names: list[str], args: argparse.Namespace) -> tuple[DataFrame | None, list[str]]:
    """Configurations of `frontier.sweep`, and what failed: one configuration's failure is its own."""
    done, failed = [], []
    for name in names:
        try:
            if name in REPLAYS:
                raise UsageError(f"{name} replays records: it took nothing that could be compared")
            one = run_corpus(spark, root, extractor_of(spark, name, args), parser=corpus.installed_parser())
            done.append((one.fields.withColumn("label", F.lit(name)), one.extractions.drop("fields").withColumn("label", F.lit(name))))
            one.report.where("scope = 'overall'").first()
        except Exception as e:
            failed.append(f"{name} failed: {str(e).splitlines()[0]}")
    if not done:
        return None, failed
    fields, took = done[0]
    for f, t in done[1:]:
        fields, took = fields.unionByName(f), took.unionByName(t)
    return frontier.sweep(fields, took), failed


def tell(lines: Iterable[str]) -> None:
    for line in lines:
        print(line)


def show(frame: DataFrame, *columns: str) -> None:
    tell("  ".join(str(row[c]) for c in columns or frame.columns) for row in frame.toLocalIterator())


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="veriloom")
    parser.add_argument("verb", choices=("corpus", "extract", "run", "gate", "sweep", "import", "serve"))
    parser.add_argument("corpus")
    parser.add_argument("--extractor", default="heuristic")
    parser.add_argument("--transcripts")
    parser.add_argument("--alpha", type=float, default=0.1)
    parser.add_argument("--no-verify", action="store_true")
    parser.add_argument("--thresholds")
    parser.add_argument("--save")
    parser.add_argument("--port", type=int, default=8756)
    parser.add_argument("--model", help="for extractors that take one")
    parser.add_argument("--command", help="the program behind the extractor `command`")
    parser.add_argument("--verbose", action="store_true")
    parser.add_argument("--dataset", default="own", help=f"import: {', '.join(datasets.DATASETS)}, or another with --field")
    parser.add_argument("--source", help="import: a folder with in.tsv.xz and expected.tsv of a split")
    parser.add_argument("--limit", type=int, help="import: the first so many rows only")
    parser.add_argument("--field", action="append", default=[], metavar="KEY=ITEM", help="import: which key is which line item")
    try:
        args = parser.parse_args(argv)
    except SystemExit as e:
        return USAGE if e.code else OK
    spark = spark or SparkSession.builder.appName("veriloom").getOrCreate()
    try:
        return run_verb(spark, args)
    except (corpus.CorpusError, gate.GateError, UsageError) as e:
        print(e, file=sys.stderr)
        return USAGE


def run_verb(spark: SparkSession, args: argparse.Namespace) -> int:
    parse = corpus.installed_parser()
    if args.verb == "corpus":
        records = corpus.golden_records(spark, args.corpus)
        tell(render.corpus(corpus.listing(corpus.resolve(records, corpus.text_documents(spark, args.corpus), corpus.pdf_files(spark, args.corpus)))))
        return OK
    if args.verb == "import":
        dataset = datasets.DATASETS.get(args.dataset) or datasets.Dataset(args.dataset, "a data set of your own", args.source or "", "yours to know", False)
        if args.field:
            dataset = replace(dataset, fields=dict(f.split("=", 1) for f in args.field))
        tell(datasets.import_split(spark, args.source or "", args.corpus, dataset, args.limit).lines())
        return OK
    if args.verb == "serve":
        web.server(web.App(spark, args.corpus, args.save or f"{args.corpus}/runs", args.extractor, args.alpha), port=args.port).serve_forever()
    if args.verb == "sweep":
        rows, failed = sweep(spark, args.corpus, args.extractor.split(","), args)
        tell([*(render.sweep(rows) if rows is not None else ()), *failed])
        return OK if rows is not None else USAGE
    extractor = extractor_of(spark, args.extractor, args)
    if args.verb == "extract":
        show(inspect(corpus.documents(spark, args.corpus, parse), extractor, schemas.line_items(spark)).orderBy("doc_id", "ordinal"), "doc_id", "name", "value", "unit_scale", "page", "grounded", "quote")
        return OK
    limits, undefined = [], False
    if args.verb == "gate":  # thresholds first: a bad file must not cost a run
        text = spark.read.text(args.thresholds or f"{args.corpus}/thresholds.json", wholetext=True).first()
        limits, undefined = gate.thresholds(text[0] if text else "")
    run = run_corpus(spark, args.corpus, extractor, not args.no_verify, args.alpha, parser=parse)
    if args.save:
        runs.save_run(artifact(run, spark), f"{args.save}/{run.run_id}", run.documents)
    if args.verb == "run":
        tell(render.run(run, args.verbose))
        return OK
    checks = gate.grade(run.metrics, gate.threshold_table(spark, limits), undefined).persist()
    tell(render.gate(checks))
    return OK if gate.passes(checks).first()["passed"] else BREACH


if __name__ == "__main__":
    sys.exit(main())
