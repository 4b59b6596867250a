"""A thin HTTP face of the engine on the driver: looks at a corpus and its runs, starts runs, takes uploads and labels.

GET `/`, `/api/config`, `/api/corpus`, `/api/runs`, `/api/runs/<id>`, `/api/runs/<id>/<document>`, `/api/inspect/<id>`, `/api/golden/<id>`;
POST `/api/run`, `/api/upload?filename=`; PUT `/api/golden/<id>`. What writes holds a lock; ids never become paths.
"""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom import schemas
from veriloom.operators.extract import EXTRACTORS, build
from veriloom.plans.run import artifact, inspect, run_corpus
from veriloom.sources import corpus, runs, writers

#: A page that shows the corpus and the runs, starts a run, and opens one.
_PAGE = """<!doctype html><meta charset=utf-8><title>veriloom</title>
<style>body{font:15px sans-serif;margin:2em;max-width:60em}pre{background:#f4f4f4;padding:1em;overflow:auto}td,th{padding:.2em .8em;text-align:left}</style>
<h1>veriloom</h1><p id=corpus></p><p><select id=extractor></select> <button id=go>Run</button> <span id=state></span></p>
<table><thead><tr><th>run<th>extractor<th>made</thead><tbody id=runs></tbody></table><pre id=shown hidden></pre>
<script>
const get = async (path, options) => { const r = await fetch('/api/' + path, options), v = await r.json(); if (!r.ok) throw Error(v.error); return v };
const el = id => document.getElementById(id), say = text => { el('state').textContent = text };
async function list() {
  el('runs').replaceChildren(...(await get('runs')).map(r => {
    const row = document.createElement('tr');
    for (const x of [r.run_id, r.extractor, r.created_at]) row.insertCell().textContent = x ?? r.error ?? '';
    row.onclick = async () => { el('shown').hidden = false; el('shown').textContent = JSON.stringify(await get('runs/' + encodeURIComponent(r.run_id)), null, 1) };
    return row }));
}
el('go').onclick = async () => { say('running'); try { await get('run', {method: 'POST', body: JSON.stringify({extractor: el('extractor').value})}); say(''); await list() } catch (e) { say(e.message) } };
(async () => {
  const config = await get('config'), corpus = await get('corpus');
  for (const x of config.extractors) el('extractor').append(new Option(x, x, x == config.extractor, x == config.extractor));
  el('corpus').textContent = `${config.corpus}: ${corpus.n_documents} labels, ${corpus.n_fields} fields, ${corpus.unlabelled} sources without a label`;
  await list();
})();
</script>"""
#: Documents of a run that one answer holds; the others are asked for by id.
MOST_DOCUMENTS = 1000


class Missing(LookupError):
    """What was asked for is not there."""


def _rows(frame: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in frame.collect()]


class App:
    """The endpoints as methods; each answers with something that JSON can say. Answers are of one document, one run or totals."""

    def __init__(self, spark: SparkSession, root: str, runs_root: str, extractor: str = "heuristic", alpha: float = 0.1):
        self.spark, self.root, self.runs_root, self.extractor, self.alpha = spark, root, runs_root, extractor, alpha
        self.lock = threading.Lock()

    def config(self) -> dict:
        return {"corpus": self.root, "runs": self.runs_root, "extractor": self.extractor, "extractors": sorted(EXTRACTORS), "alpha": self.alpha, "items": list(schemas.ITEMS)}

    def corpus(self) -> dict:
        records = corpus.golden_records(self.spark, self.root)
        text, pdfs = corpus.text_documents(self.spark, self.root), corpus.pdf_files(self.spark, self.root)
        kinds = corpus.resolve(records, text, pdfs).groupBy("kind").agg(F.count("*").alias("n"))
        unlabelled = corpus.unlabelled(records, text, pdfs).agg(F.count("*").alias("n")).first()["n"]
        return _rows(corpus.inventory(records))[0] | {"kinds": {r["kind"]: r["n"] for r in kinds.collect()}, "unlabelled": unlabelled}

    def list_runs(self) -> list[dict]:
        try:
            return _rows(runs.list_runs(self.spark, f"{self.runs_root}/*/run/*.txt"))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise

    def run(self, run_id: str) -> dict:
        try:
            return runs.as_dict(self.spark, f"{self.runs_root}/{run_id}", MOST_DOCUMENTS)
        except AnalysisException as e:
            raise Missing(run_id) from e

    def run_document(self, run_id: str, doc_id: str) -> dict:
        found = runs.load_documents(self.spark, f"{self.runs_root}/{run_id}").where(F.col("doc_id") == doc_id).select(F.to_json("document")).first()
        if found is None:
            raise Missing(f"{run_id}, {doc_id}")
        return json.loads(found[0])

    def execute(self, extractor: str | None = None, alpha: float | None = None) -> dict:
        made, alpha = build(extractor or self.extractor), self.alpha if alpha is None else float(alpha)
        with self.lock:
            run = run_corpus(self.spark, self.root, made, True, alpha, parser=corpus.installed_parser())
            runs.save_run(artifact(run, self.spark), f"{self.runs_root}/{run.run_id}", run.documents)
        return self.run(run.run_id)

    def inspect(self, doc_id: str) -> dict:
        try:
            documents = corpus.document(self.spark, self.root, doc_id, corpus.installed_parser())
        except corpus.CorpusError as e:
            raise Missing(doc_id) from e
        golden = corpus.golden_fields(corpus.golden_records(self.spark, self.root).where(F.col("doc_id") == doc_id))
        rows = inspect(documents, build(self.extractor), schemas.line_items(self.spark), golden)
        return {"doc_id": doc_id, "fields": _rows(rows.orderBy("ordinal"))}

    def golden(self, doc_id: str) -> dict:
        found = _rows(corpus.golden_records(self.spark, self.root).where(F.col("doc_id") == doc_id).drop("file"))
        if not found:
            raise Missing(doc_id)
        return found[0]

    def save_golden(self, doc_id: str, record: dict) -> dict:
        with self.lock:
            writers.save_golden(self.root, record | {"doc_id": doc_id})
        return self.golden(doc_id)

    def upload(self, filename: str, data: bytes) -> dict:
        with self.lock:
            return {"doc_id": writers.save_pdf(self.root, filename, data)}


def document_id(raw: str) -> str:
    """An id out of a path; one that could leave its folder is refused."""
    name = unquote(raw)
    if not name or "/" in name or "\\" in name or ".." in name:
        raise corpus.CorpusError("not a document id")
    return name


def handler(app: App) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def answer(self, status: int, body: bytes, kind: str = "application/json") -> None:
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def body(self) -> bytes:
            size = int(self.headers.get("Content-Length") or 0)
            if size > writers.LARGEST_PDF:
                raise corpus.CorpusError("too large")
            return self.rfile.read(size)

        def serve(self) -> None:
            url = urlsplit(self.path)
            first, _, rest = url.path.removeprefix("/api/").partition("/")
            try:
                if self.command == "GET" and url.path == "/":
                    return self.answer(200, _PAGE.encode(), "text/html; charset=utf-8")
                if not url.path.startswith("/api/"):
                    raise Missing(url.path)
                plain = {("GET", "config"): app.config, ("GET", "corpus"): app.corpus, ("GET", "runs"): app.list_runs}
                one = {("GET", "runs"): app.run, ("GET", "inspect"): app.inspect, ("GET", "golden"): app.golden}
                call = (self.command, first)
                if not rest and call in plain:
                    value = plain[call]()
                elif call == ("GET", "runs") and "/" in rest:
                    value = app.run_document(*map(document_id, rest.split("/", 1)))
                elif rest and call in one:
                    value = one[call](document_id(rest))
                elif not rest and call == ("POST", "run"):
                    asked = json.loads(self.body() or b"{}")
                    value = app.execute(asked.get("extractor"), asked.get("alpha"))
                elif not rest and call == ("POST", "upload"):
                    value = app.upload(parse_qs(url.query).get("filename", [""])[0], self.body())
                elif rest and call == ("PUT", "golden"):
                    value = app.save_golden(document_id(rest), json.loads(self.body()))
                else:
                    raise Missing(url.path)
                self.answer(200, json.dumps(value, default=str).encode())
            except Missing as e:
                self.answer(404, json.dumps({"error": f"not here: {e}"}).encode())
            except (ValueError, KeyError, TypeError) as e:
                self.answer(400, json.dumps({"error": str(e)}).encode())

        do_GET = do_POST = do_PUT = serve

    return Handler


def server(app: App, host: str = "127.0.0.1", port: int = 8756) -> ThreadingHTTPServer:
    return ThreadingHTTPServer((host, port), handler(app))
