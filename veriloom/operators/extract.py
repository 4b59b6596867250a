"""Extractors: what is claimed of each document, and what that took.

An extractor takes documents (doc_id, pages, perhaps error) and returns a row of `schemas.EXTRACTIONS` for each, with all eight
items; what it does not claim is an abstention. It never fails for a bad document.
"""

from __future__ import annotations

import json
import shutil
import subprocess
import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriloom.functions import kernels
from veriloom.functions.columns import ASKED, FEEDBACK
from veriloom.operators.attempts import price
from veriloom.operators.verify import admit
from veriloom.schemas import CLAIM_KEYS, CLAIM_ROWS, EXTRACTIONS, ITEMS, MAGNITUDE_ITEMS

_NAMES = [c.split()[0] for c in CLAIM_ROWS.split(", ")]
_NOTHING = {"value": None, "unit_scale": 1.0, "currency": None, "page": None, "quote": None, "confidence": 0.0}


def claims(extractions: DataFrame) -> DataFrame:
    """Rows of CLAIM_ROWS of EXTRACTIONS."""
    return extractions.select("doc_id", F.explode("fields").alias("f")).select("doc_id", "f.*").select(*_NAMES)


class Extractor(ABC):
    name: str

    @abstractmethod
    def extract(self, documents: DataFrame) -> DataFrame:
        """Rows of EXTRACTIONS."""

    def claims(self, documents: DataFrame) -> DataFrame:
        return claims(self.extract(documents))


class Taken(NamedTuple):
    """What one document gave and took."""

    found: dict[str, dict]
    latency_s: float = 0.0
    input_tokens: int = 0
    output_tokens: int = 0
    cost_usd: float = 0.0
    retries: int = 0
    error: str | None = None


def _batch(doc_ids: list, extractor: str, model: str | None, taken: list[Taken]):
    """A record batch of EXTRACTIONS; items not found abstain, sizes of outflows lose their sign."""
    import pyarrow as pa

    kinds = {"string": pa.string(), "double": pa.float64(), "bigint": pa.int64(), "int": pa.int32()}
    field = pa.struct([(n, kinds[k]) for n, k in (x.split() for x in CLAIM_ROWS.split(", ")[1:])])
    schema = pa.schema([(n, kinds.get(k, pa.list_(field))) for n, k in (x.split()[:2] for x in " ".join(EXTRACTIONS.split("<")[0].split()).split(", "))])
    rows = []
    for doc_id, t in zip(doc_ids, taken):
        fields = [{"pos": pos, "name": item} | _NOTHING | {k: v for k, v in t.found.get(item, {}).items() if k in CLAIM_KEYS[1:]} for pos, item in enumerate(ITEMS)]
        for f in fields:
            if f["name"] in MAGNITUDE_ITEMS and f["value"] is not None:
                f["value"] = abs(f["value"])
        rows.append({"doc_id": doc_id, "extractor": extractor, "model": model, "fields": fields} | {k: v for k, v in t._asdict().items() if k != "found"})
    return pa.RecordBatch.from_pylist(rows, schema)


class Heuristic(Extractor):
    """The deterministic keyword baseline: for each line item, the first labelled line in reading order that has an amount.

    One pass over a batch makes a table of the lines of all its pages; only lines that may have a label are looked at.
    """

    name = "heuristic"

    def extract(self, documents: DataFrame) -> DataFrame:
        name = self.name

        def scan(batches: Iterable) -> Iterator:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    began = time.perf_counter()
                    found = first_claims_of(part.column("pages"))
                    each = (time.perf_counter() - began) / part.num_rows
                    yield _batch(part.column("doc_id").to_pylist(), name, None, [Taken(f, each) for f in found])

        return documents.select("doc_id", "pages").mapInArrow(scan, EXTRACTIONS)


def first_claims_of(pages) -> list[dict[str, dict]]:
    """Claims by item of each document of an Arrow array of lists of pages."""
    import numpy as np
    import pyarrow.compute as pc

    texts = pc.fill_null(pages.flatten(), "")
    lists = pc.split_pattern(texts, "\n")
    lines = lists.flatten()
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(int).tolist()
    sizes = pc.fill_null(pc.list_value_length(pages), 0).to_pylist()
    of_doc = np.repeat(np.arange(len(pages)), sizes).tolist()
    number = [n for size in sizes for n in range(1, size + 1)]
    near = np.flatnonzero(pc.match_substring_regex(lines, kernels.LABEL_STARTS, ignore_case=True).to_numpy(zero_copy_only=False)).tolist()
    of_page = np.searchsorted(ends, near, "right").tolist()
    labelled: dict[int, dict[int, kernels.Label]] = {}
    for page, i in zip(of_page, near):
        if label := kernels.best_label(lines[i].as_py()):
            labelled.setdefault(page, {})[i] = label
    found: list[dict[str, dict]] = [{} for _ in sizes]
    for page, labels in labelled.items():
        first, end = ends[page - 1] if page else 0, ends[page]
        text = texts[page].as_py()
        own = {i + first: line for i, line in enumerate(text.split("\n"))}
        declared: dict[str, object] = {}
        for c in kernels.candidates(own, labels, first, end):
            if c.item in found[of_doc[page]]:
                continue
            declared = declared or {k: kernels.declared(text, k) for k in ("units", "currency")}
            scale = c.scale if c.scale != 1.0 else declared["units"] or 1.0
            found[of_doc[page]][c.item] = {"value": c.value, "unit_scale": scale, "currency": declared["currency"], "page": number[page], "quote": c.quote, "confidence": c.confidence}
    return found


class Replay(Extractor):
    """Recorded claims by document; documents without a record abstain. Claims go through the same admission as live ones."""

    def __init__(self, recorded: DataFrame, check_quotes: bool = True, name: str = "offline"):
        self.recorded, self.check_quotes, self.name = recorded, check_quotes, name

    def extract(self, documents: DataFrame) -> DataFrame:
        """`recorded` has doc_id and rows of claims with `pos`; of admitted claims on one item in a record the last counts."""
        admitted = admit(self.recorded, documents, self.check_quotes).where("problem is null")
        last = Window.partitionBy("doc_id", "name").orderBy(F.desc("pos"))
        kept = admitted.withColumn("_k", F.row_number().over(last)).where("_k = 1").select(*_NAMES).drop("pos")
        timed = F.max("latency_s") if "latency_s" in self.recorded.columns else F.lit(0.0)
        known = self.recorded.groupBy("doc_id").agg(F.coalesce(timed, F.lit(0.0)).alias("latency_s"))
        own = F.map_from_entries(F.collect_list(F.struct("name", F.struct(*(c for c in _NAMES if c not in ("doc_id", "pos", "name")))))).alias("own")
        rows = documents.select("doc_id").join(known, "doc_id", "left").join(kept.groupBy("doc_id").agg(own), "doc_id", "left")  # 8 claims at most
        field = lambda pos, item: F.struct(
            F.lit(pos).alias("pos"), F.lit(item).alias("name"), *(F.coalesce(F.get(F.array(F.col("own")[item]), 0)[c], F.lit(_NOTHING[c])).alias(c) for c in _NAMES[3:]))
        columns = {
            "extractor": F.lit(self.name), "model": F.lit(None), "latency_s": F.coalesce("latency_s", F.lit(0.0)), "input_tokens": F.lit(0), "output_tokens": F.lit(0), "cost_usd": F.lit(0.0), "retries": F.lit(0),
            "error": F.when(F.col("latency_s").isNull(), "no record"), "fields": F.array(*(field(p, i) for p, i in enumerate(ITEMS))),
        }
        schema = documents.sparkSession.createDataFrame([], EXTRACTIONS).schema
        return rows.select("doc_id", *(c.alias(n) for n, c in columns.items())).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))


def prompt(pages: list[str | None], problems: list[str], most_pages: int = 60) -> str:
    """`columns.prompt`, for one document at hand."""
    body = "\n".join(f'<page number="{i}">\n{p or ""}\n</page>' for i, p in enumerate(pages[:most_pages], 1))
    return body + ASKED + (f"\n\n{FEEDBACK}" + "".join(f"\n- {p}" for p in problems) if problems else "")


class Reply(NamedTuple):
    """A model's answer and what it reports to have taken."""

    text: str | None
    input_tokens: int = 0
    output_tokens: int = 0
    cache_read_tokens: int = 0
    cache_write_tokens: int = 0
    refused: bool = False


def parse_reply(reply: str | None) -> list[dict]:
    """The claims of a reply's JSON block; raises for missing or extra keys and unknown items."""
    text = reply or ""
    start, end = text.find("{"), text.rfind("}")
    if start < 0 or end < start:
        raise ValueError("there is no JSON object")
    claims = json.loads(text[start : end + 1])["fields"]
    for c in claims:
        if set(c) != set(CLAIM_KEYS) or c["name"] not in ITEMS:
            raise ValueError(f"not a claim: {sorted(c)}, {c.get('name')}")
        if not all(c[k] is None or isinstance(c[k], (int, float)) and not isinstance(c[k], bool) for k in ("value", "unit_scale", "page", "confidence")):
            raise ValueError(f"{c['name']}: value, unit_scale, page and confidence are numbers")
    return claims


def check_claim(claim: dict, pages: list[str | None]) -> str | None:
    """What is wrong with a model's claim; null if nothing. The rules of `verify.admit`, one claim at a time."""
    if claim["value"] is None:
        return None
    name, page, quote = claim["name"], claim["page"], claim["quote"]
    if page is None or not quote:
        return f"{name}: a value without a page or a quote; cite both, or abstain"
    if not 1 <= page <= len(pages):
        return f"{name}: cites page {page} of {len(pages)}"
    if not kernels.on_page(quote, pages[int(page) - 1]):
        return f"{name}: the quote is not on page {page}"
    outflow = name in MAGNITUDE_ITEMS
    scale = claim["unit_scale"] if (claim["unit_scale"] or 0) > 0 else 1.0
    value = abs(claim["value"]) if outflow else claim["value"]
    return None if kernels.figure_in(value, quote, scale, outflow) else f"{name}: the figure is not in the quote"


class Model(Extractor):
    """A model behind a function from prompt to reply; asks again with what was wrong, up to `retries` times.

    Wrong is a claim that its own page does not bear out, and a reply that is not what was asked for. A call that fails or a
    refusal ends the attempts. Of a reply's claims on one item the last counts, across attempts the first that is admitted,
    abstentions included: a good field is never put at risk by another one's retry. `ask` may answer with a string, or with a
    `Reply` that has token counts; `prices` are USD per million tokens (in, out).
    """

    def __init__(self, ask: Callable[[str], str | Reply], name: str = "model", model: str | None = None, retries: int = 1, most_pages: int = 60, prices: tuple[float, float] | None = None):
        self.ask, self.name, self.model, self.retries, self.most_pages, self.prices = ask, name, model, retries, most_pages, prices

    def document(self, pages: list[str | None]) -> Taken:
        began, kept, problems = time.perf_counter(), {}, []
        tokens, again, error = [0, 0, 0, 0], 0, None if pages else "no pages"
        while error is None:
            try:
                reply = self.ask(prompt(pages, problems, self.most_pages))
            except Exception as e:  # whatever the transport raises
                error = f"{type(e).__name__}: {e}"
                break
            reply = reply if isinstance(reply, Reply) else Reply(reply)
            tokens = [a + b for a, b in zip(tokens, reply[1:5])]
            if reply.refused or reply.text is None:
                error = "refused" if reply.refused else "no answer"
                break
            claims, problems = self._read(reply.text, pages)
            for name, claim in claims.items():
                kept.setdefault(name, claim)
            if not problems or again == self.retries:
                break
            again += 1
        cost = price(*tokens, *self.prices) if self.prices else 0.0
        return Taken(kept, time.perf_counter() - began, tokens[0], tokens[1], cost, again, error)

    @staticmethod
    def _read(text: str, pages: list[str | None]) -> tuple[dict[str, dict], list[str]]:
        """Claims that hold, by item, and what is wrong with the others or with the reply."""
        try:
            claims = parse_reply(text)
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            return {}, [f"the reply is not what was asked for: {e}"]
        good, problems = {}, []
        for claim in claims:
            if (problem := check_claim(claim, pages)) is not None:
                problems.append(problem)
                continue
            scale = claim["unit_scale"] if (claim["unit_scale"] or 0) > 0 else 1.0
            page = None if claim["page"] is None else int(claim["page"])
            good[claim["name"]] = claim | {"page": page, "unit_scale": float(scale), "confidence": min(1.0, max(0.0, float(claim["confidence"] or 0.0)))}
        return good, problems

    def extract(self, documents: DataFrame) -> DataFrame:
        document, name, model = self.document, self.name, self.model

        def scan(batches: Iterable) -> Iterator:
            for batch in batches:
                for doc_id, pages in zip(batch.column("doc_id").to_pylist(), batch.column("pages").to_pylist()):
                    yield _batch([doc_id], name, model, [document(pages or [])])

        return documents.select("doc_id", "pages").mapInArrow(scan, EXTRACTIONS)


def command(argv: Sequence[str], timeout_s: float = 300.0) -> Callable[[str], Reply]:
    """A transport that gives the prompt to a program's standard input and takes its output for the reply."""

    def ask(text: str) -> Reply:
        done = subprocess.run(list(argv), input=text, capture_output=True, text=True, timeout=timeout_s, check=False)
        if done.returncode:
            raise RuntimeError(f"{argv[0]} ended with {done.returncode}: {done.stderr.strip()[:200]}")
        return Reply(done.stdout)

    return ask


class UsageError(ValueError):
    """An extractor that can't be made of what was given."""


#: Extractors by name. `command` is a model behind a program; a session may add models of its own, with prices.
EXTRACTORS: dict[str, Callable[..., Extractor]] = {"heuristic": Heuristic, "offline": Replay, "command": Model}
#: Those that replay records can't be compared with others in a sweep; those without a price have no place on a frontier.
REPLAYS, UNPRICED = frozenset({"offline"}), frozenset({"offline", "command"})


def build(name: str, recorded: DataFrame | None = None, argv: Sequence[str] = (), model: str | None = None) -> Extractor:
    """An extractor of the registry; what does not go with it is refused before any document is read."""
    if name not in EXTRACTORS:
        raise UsageError(f"no extractor {name}; there are {', '.join(sorted(EXTRACTORS))}")
    if model and name in ("heuristic", "offline", "command"):
        raise UsageError(f"{name} takes no model")
    if name == "offline":
        if recorded is None:
            raise UsageError("offline needs recorded claims")
        return Replay(recorded)
    if name == "command":
        if not argv or shutil.which(argv[0]) is None:
            raise UsageError(f"command needs a program that is there, not {' '.join(argv) or 'none'}")
        return Model(command(argv), "command")
    return EXTRACTORS[name](**({"model": model} if model else {}))
