"""Writing corpora: one JSON file per label, text or recorded claims, or a table of many; each appears whole or not at all."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.functions import kernels
from veriloom.schemas import CLAIM_KEYS, ITEMS
from veriloom.sources.corpus import CorpusError, save_table

LARGEST_PDF = 64 << 20


def _place(root: str, folder: str, name: str):
    """(filesystem, path) in a corpus folder, which is made if need be; ids never leave the folder."""
    from pyarrow import fs

    if not name or "/" in name or "\\" in name or ".." in name:
        raise CorpusError(f"not a document id: {name!r}")
    system, base = fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
    system.create_dir(f"{base}/{folder}", recursive=True)
    return system, f"{base}/{folder}/{name}"


def write_atomically(system, path: str, data: bytes) -> None:
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(own) as out:
        out.write(data)
    system.move(own, path)


def _json(value) -> bytes:
    return (json.dumps(value, indent=2, ensure_ascii=False) + "\n").encode()


def save_text(root: str, name: str, text: str) -> None:
    """A file of the corpus's own, such as a README."""
    write_atomically(*_place(root, "", name), text.encode())


def save_page_text(root: str, doc_id: str, pages: list[str]) -> None:
    write_atomically(*_place(root, "text", f"{doc_id}.json"), _json({"doc_id": doc_id, "pages": list(pages)}))


def save_golden(root: str, record: dict) -> None:
    """A label: doc_id, and fields with known names, once each."""
    names = [f["name"] for f in record["fields"]]
    if any(n not in ITEMS for n in names):
        raise CorpusError(f"no line item: {sorted(set(names) - set(ITEMS))}")
    write_atomically(*_place(root, "golden", f"{record['doc_id']}.json"), _json(record))


def save_pdf(root: str, filename: str, data: bytes) -> str:
    """An uploaded PDF under a safe id, which is returned."""
    doc_id = kernels.slug(filename)
    if doc_id is None:
        raise CorpusError(f"{filename!r} has no letters or digits to make an id of")
    if not data or len(data) > LARGEST_PDF or not data.startswith(b"%PDF-"):
        raise CorpusError(f"{filename!r} is empty, too large or no PDF")
    write_atomically(*_place(root, "pdfs", f"{doc_id}.pdf"), data)
    return doc_id


def save_claims(root: str, doc_id: str, claims: list[dict], latency_s: float = 0.0) -> None:
    """Recorded claims for a replay; each has exactly the seven keys."""
    for c in claims:
        if set(c) != set(CLAIM_KEYS) or c["name"] not in ITEMS:
            raise CorpusError(f"not a claim: {sorted(c)}")
    write_atomically(*_place(root, "", f"{doc_id}.json"), _json({"fields": claims, "latency_s": latency_s}))


def save_corpus(documents: DataFrame, root: str) -> int:
    """Write `golden` and `text` files of (doc_id, pages, fields) rows from the tasks; returns how many documents."""

    def write(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, pages, fields in zip(batch["doc_id"], batch["pages"], batch["fields"]):
                save_page_text(root, doc_id, pages)
                own = [{k: None if v is None or v != v else v for k, v in dict(f).items()} for f in fields]
                save_golden(root, {"doc_id": doc_id, "source": "import", "pages": len(pages), "scanned": True, "fields": [f | {"page": None if f["page"] is None else int(f["page"]), "ambiguous": bool(f["ambiguous"])} for f in own]})
            yield pd.DataFrame({"n": [len(batch)]})

    written = documents.select("doc_id", "pages", "fields").mapInPandas(write, "n bigint").agg({"n": "sum"}).first()[0]
    return int(written or 0)


def _known(value: Column, good: Column, what: str) -> Column:
    return F.when(good, value).otherwise(F.raise_error(F.concat(F.lit(f"{what}: "), F.coalesce(value, F.lit("null")))).cast("string"))


def save_tables(texts: DataFrame, labels: DataFrame, root: str) -> None:
    """Write (doc_id, pages) texts and their (doc_id, fields) labels as a corpus of many documents: tables with a line a
    document. Ids, items and records are those of `save_corpus`, a record for each id; all in the JVM, and of the texts
    only ids and numbers of pages meet the labels."""
    doc_id = F.col("doc_id")
    good = (doc_id != "") & ~doc_id.contains("/") & ~doc_id.contains("\\") & ~doc_id.contains("..")
    texts = texts.select(_known(doc_id, good, "not a document id").alias("doc_id"), "pages")
    own = F.transform(F.coalesce("fields", F.array()), lambda f: F.struct(
        _known(f["name"], f["name"].isin(*ITEMS), "no line item").alias("name"), F.nanvl(f["value"], F.lit(None).cast("double")).alias("value"), f["page"].alias("page"),
        F.coalesce(f["ambiguous"], F.lit(False)).alias("ambiguous"), f["note"].alias("note")))
    records = texts.groupBy("doc_id").agg(F.max(F.size("pages")).alias("pages")).join(labels, "doc_id", "left")
    save_table(texts, f"{root}/text.jsonl")
    save_table(records.select("doc_id", F.lit("import").alias("source"), "pages", F.lit(True).alias("scanned"), own.alias("fields")), f"{root}/golden.jsonl")
