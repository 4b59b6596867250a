"""External data sets that can be imported as corpora: what they are, what their keys mean, what their licence allows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom import schemas
from veriloom.sources import imports, writers
from veriloom.sources.corpus import CorpusError


@dataclass(frozen=True)
class Dataset:
    name: str
    about: str
    url: str
    licence: str
    committable: bool
    fields: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if unknown := sorted(set(self.fields.values()) - set(schemas.ITEMS)):
            raise CorpusError(f"{self.name}: no line items: {unknown}")


# The data set's own name, place, licence and keys.
DATASETS = {
    d.name: d for d in (
        Dataset("kleister-charity", "annual reports of charities in England and Wales, scanned and digital, with several OCR texts each", "https://github.com/applicaai/kleister-charity", "none declared", False,
                {"income_annually_in_british_pounds": "revenue_ltm"}),)
}


@dataclass(frozen=True)
class Imported:
    """What an import made, in numbers."""

    dataset: Dataset
    root: str
    n_documents: int
    n_values: int
    n_absent: int

    @property
    def n_unscored(self) -> int:
        """Line items that the data set says nothing about: left out, not labelled absent."""
        return len(schemas.ITEMS) - len(set(self.dataset.fields.values()))

    def lines(self) -> list[str]:
        told = [
            f"{self.dataset.name}: {self.n_documents} documents in {self.root}",
            f"{self.n_values} values, {self.n_absent} absences (keys that were asked for and have no value)",
            f"{self.n_unscored} of {len(schemas.ITEMS)} line items have no key here; they have no label and are never scored",
        ]
        if not self.dataset.committable:
            told.append(f"Licence: {self.dataset.licence}. Keep this corpus to yourself: don't commit or publish its labels.")
        return told

    def readme(self, split: str) -> str:
        """What lies in the folder, and what it can't measure."""
        measured = [
            "Each text is one page, as the source has no page breaks: quotes are checked, cited pages mean nothing, and grounding does not compare with that of paged corpora.",
            "Values are marked ambiguous: that a key means its line item is a judgement. Read abstention precision with that in mind.",
        ]
        return "\n".join([f"# {self.dataset.name}, {split}", "", f"Imported from {self.dataset.url}: {self.dataset.about}. Import again rather than edit.", "", *(f"* {x}" for x in (*self.lines(), *measured)), ""])


def pairs_of(spark: SparkSession, source: str) -> DataFrame:
    """Rows of a split's `in.tsv.xz` with what `expected.tsv` has in the same place; blank lines don't count."""
    cells = F.split("line", "\t", -1)
    rows = imports.read_xz(spark, f"{source}/in.tsv.xz").where(F.trim("line") != "")
    rows = imports.positioned(rows.drop("path"), "position").select("position", *(F.get(cells, i).alias(c) for i, c in enumerate(imports.COLUMNS)))
    lines = spark.read.text(f"{source}/expected.tsv").select(F.monotonically_increasing_id().alias("_k"), F.col("value").alias("expected"))
    return imports.zip_by_position(rows, imports.positioned(lines, "_k").drop("_k"))


def import_split(spark: SparkSession, source: str, root: str, dataset: Dataset, limit: int | None = None) -> Imported:
    """A split of a data set as a corpus in `root`, with a README; at most `limit` rows of it, where one is given."""
    if not dataset.fields:
        raise CorpusError(f"{dataset.name}: which key is which line item?")
    pairs = pairs_of(spark, source)
    if limit is not None:
        pairs = pairs.where(F.col("position") < limit)
    documents = imports.import_rows(pairs, dataset.fields)
    fields = documents.select(F.explode("fields").alias("f")).agg(F.count("f.value").alias("n_values"), F.count_if(F.col("f.value").isNull()).alias("n_absent")).first()
    made = Imported(dataset, root, writers.save_corpus(documents, root), fields["n_values"], fields["n_absent"])
    writers.save_text(root, "README.md", made.readme(source.rstrip("/").rpartition("/")[2]))
    return made
