"""Corpora on storage: `golden/*.json` labels, `text/*.json` pages, `pdfs/*.pdf`; all read by Spark's own readers.

A corpus of many documents has its labels and its texts as tables instead, `golden.jsonl` and `text.jsonl`, a line a document:
a file a document costs an open each, and the driver a list of them all. Where both are there, a document's own file counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom import schemas


class CorpusError(ValueError):
    """A corpus that can't be read."""


def _stem() -> F.Column:
    return F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")


def _json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame | None:
    """JSON, whole files or lines, failing on malformed ones; None where nothing is there."""
    try:
        return spark.read.schema(schema).option("multiLine", not lines).option("mode", "FAILFAST").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def _own_first(own: DataFrame | None, table: DataFrame | None, file: str) -> DataFrame | None:
    """Documents with files of their own, and those of the table that have none; `file` is their file's name, in a table their id."""
    own, table = own and own.withColumn(file, _stem()), table and table.withColumn(file, F.col("doc_id"))
    if own is None or table is None:
        return table if own is None else own
    return own.unionByName(table.join(own.select(file), file, "left_anti"))


def golden_records(spark: SparkSession, root: str) -> DataFrame:
    """Labels, one row per document, by the name of their file, in a table their id."""
    own, table = _json(spark, f"{root}/golden/*.json", schemas.GOLDEN), _json(spark, f"{root}/golden.jsonl", schemas.GOLDEN, lines=True)
    found = _own_first(own, table, "file")
    if found is None:
        raise CorpusError(f"{root} has no golden labels")
    return found.orderBy("file")


def golden_fields(records: DataFrame) -> DataFrame:
    """One row per labelled field: doc_id, pos, name, expected, page, ambiguous, note. Unknown items are an error."""
    rows = records.select("doc_id", F.posexplode("fields").alias("pos", "f"))
    known = F.when(F.col("f.name").isin(*schemas.ITEMS), F.col("f.name")).otherwise(F.raise_error(F.concat(F.lit("no line item: "), F.coalesce("f.name", F.lit("null")))).cast("string"))
    return rows.select(
        "doc_id", "pos", known.alias("name"), F.col("f.value").alias("expected"), F.col("f.page").alias("page"), F.coalesce("f.ambiguous", F.lit(False)).alias("ambiguous"), F.coalesce("f.note", F.lit("")).alias("note"))


def text_documents(spark: SparkSession, root: str) -> DataFrame:
    """Page texts (doc_id, pages); the id is the file's name where the file does not say it."""
    found = _own_first(_json(spark, f"{root}/text/*.json", schemas.TEXT), _json(spark, f"{root}/text.jsonl", schemas.TEXT, lines=True), "file")
    if found is None:
        return spark.createDataFrame([], schemas.TEXT)
    pages = F.when(F.col("pages").isNull() | F.exists("pages", F.isnull), F.raise_error(F.lit("pages are a list of strings")).cast("array<string>")).otherwise(F.col("pages"))
    return found.select(F.coalesce("doc_id", "file").alias("doc_id"), pages.alias("pages"))


def pdf_files(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """(doc_id, path, valid, and the content if wanted): sources to parse; valid is non-empty, at most 64 MiB and with the magic bytes."""
    try:
        found = spark.read.format("binaryFile").load(f"{root}/pdfs/*.pdf")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "doc_id string, path string, valid boolean" + ", content binary" * content)
    magic = F.substring("content", 1, 5) == F.lit(b"%PDF-")
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return found.select(name.alias("doc_id"), "path", ((F.col("length") > 0) & (F.col("length") <= 64 << 20) & magic).alias("valid"), *["content"] * content)


#: From a PDF's bytes to the text of its pages; raises for what it can't read.
Parser = Callable[[bytes], list[str]]


def installed_parser() -> Parser | None:
    """A parser made of a PDF library, if one is installed."""
    try:
        import fitz
    except ImportError:
        return None

    def parse(data: bytes) -> list[str]:
        with fitz.open(stream=data, filetype="pdf") as pdf:
            return [page.get_text() for page in pdf]

    return parse


def pdf_documents(spark: SparkSession, root: str, parser: Parser) -> DataFrame:
    """(doc_id, pages, error) of the PDFs, parsed where they are read; one that can't be parsed has no pages and says why."""

    def parse(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for doc_id, data, valid in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "content", "valid"))):
                try:
                    rows.append((doc_id, [str(p) for p in parser(data)], None) if valid else (doc_id, [], "empty, too large or no PDF"))
                except Exception as e:  # whatever the library raises is this document's own
                    rows.append((doc_id, [], f"{type(e).__name__}: {e}"))
            kinds = (pa.string(), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "pages", "error"]) if rows else pa.RecordBatch.from_arrays([pa.array([], k) for k in kinds], ["doc_id", "pages", "error"])

    found = pdf_files(spark, root, content=True).select("doc_id", F.when(F.col("valid"), F.col("content")).alias("content"), "valid")
    return found.mapInArrow(parse, "doc_id string, pages array<string>, error string")


def documents(spark: SparkSession, root: str, parser: Parser | None = None) -> DataFrame:
    """(doc_id, pages, error) of all sources that can be read: a PDF, where there is a `parser`, before a text of the same id."""
    text = text_documents(spark, root).withColumn("error", F.lit(None).cast("string"))
    if parser is None:
        return text
    pdfs = pdf_files(spark, root).select("doc_id").distinct()
    return pdf_documents(spark, root, parser).unionByName(text.join(pdfs, "doc_id", "left_anti"))


def document(spark: SparkSession, root: str, doc_id: str, parser: Parser | None = None) -> DataFrame:
    """One document; without a source it is an error, not an empty document."""
    found = documents(spark, root, parser).where(F.col("doc_id") == doc_id)
    if not found.limit(1).count():
        raise CorpusError(f"{doc_id}: there is no text, and no PDF that can be read here")
    return found


def resolve(records: DataFrame, text: DataFrame, pdfs: DataFrame) -> DataFrame:
    """Labels with `kind`: `pdf` before `text` before `missing`."""
    joined = records.join(pdfs.select("doc_id", F.lit(True).alias("_pdf")).distinct(), "doc_id", "left").join(text.select("doc_id", F.lit(True).alias("_text")).distinct(), "doc_id", "left")
    return joined.withColumn("kind", F.when(F.col("_pdf"), "pdf").when(F.col("_text"), "text").otherwise("missing")).drop("_pdf", "_text")


def unlabelled(records: DataFrame, text: DataFrame, pdfs: DataFrame) -> DataFrame:
    """Sources without a label, by id."""
    return text.select("doc_id").union(pdfs.select("doc_id")).distinct().join(records, "doc_id", "left_anti").orderBy("doc_id")


def listing(resolved: DataFrame) -> DataFrame:
    """A row for each label of `resolve`, by id: its source, pages and numbers of fields."""
    size = lambda keep: F.size(F.filter("fields", keep))
    return resolved.select(
        "doc_id", "kind", F.coalesce("pages", F.lit(0)).alias("pages"), F.size("fields").alias("n_fields"), size(lambda f: f["value"].isNotNull()).alias("n_stated"),
        size(lambda f: F.coalesce(f["ambiguous"], F.lit(False))).alias("n_ambiguous"), F.coalesce("scanned", F.lit(False)).alias("scanned")).orderBy("doc_id")


def inventory(records: DataFrame) -> DataFrame:
    """Totals of labelled, stated, absent and ambiguous fields."""
    fields = golden_fields(records)
    return fields.agg(
        F.count_distinct("doc_id").alias("n_documents"), F.count("*").alias("n_fields"), F.count("expected").alias("n_stated"),
        F.count_if(F.col("expected").isNull()).alias("n_absent"), F.count_if("ambiguous").alias("n_ambiguous"))


def recorded_claims(spark: SparkSession, root: str) -> DataFrame:
    """Recorded claims by file name, with their position; missing files are missing rows."""
    found = _json(spark, f"{root}/*.json", schemas.CLAIMS)
    if found is None:
        return spark.createDataFrame([], schemas.CLAIM_ROWS)
    return found.select(_stem().alias("doc_id"), "latency_s", F.posexplode("fields").alias("pos", "f")).select("doc_id", "pos", "f.*", "latency_s")


def save_table(frame: DataFrame, path: str) -> None:
    """A table as JSON lines; the job's commit makes it appear whole or not at all."""
    frame.write.mode("overwrite").json(path)
