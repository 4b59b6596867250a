"""Importing an external data set: two tab-separated files zipped by position, and keys that were asked for or not."""

from __future__ import annotations

import lzma
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from veriloom.functions import columns as C
from veriloom.operators.selective import running

COLUMNS = ("filename", "keys", "text_djvu", "text_tesseract", "text_textract", "text_best")


class XzLines(DataSource):
    """`spark.read.format("xz_lines").option("path", ...)`: numbered lines of an xz file, which Spark has no codec for.

    Such a file is one stream, so one task reads it; several paths, comma-separated, are read side by side.
    """

    @classmethod
    def name(cls) -> str:
        return "xz_lines"

    def schema(self) -> str:
        return "path string, position bigint, line string"

    def reader(self, schema) -> DataSourceReader:
        return _XzReader(self.options["path"].split(","))


class _XzReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with lzma.open(partition.value, "rt", encoding="utf-8", newline="\n") as lines:
            for i, line in enumerate(lines):
                yield partition.value, i, line.rstrip("\n")


def read_xz(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(XzLines)
    return spark.read.format("xz_lines").option("path", path).load()


def positioned(rows: DataFrame, order: str) -> DataFrame:
    """`rows` with `position` from 0 by `order`, for files whose reader does not count; equal values get neighbouring places.

    Rows are ranked within ranges, and the sizes of the ranges before are added.
    """
    return running(rows.withColumn("_one", F.lit(1)), order, {"position": "_one"}).withColumn("position", F.col("position") - 1).drop("_one")


def zip_by_position(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of equal position; unequal numbers of rows are an error."""
    sizes = left.agg(F.count("*").alias("a")).crossJoin(right.agg(F.count("*").alias("b")))
    same = sizes.select(F.assert_true(F.col("a") == F.col("b"), F.format_string("%d rows against %d", "a", "b")).alias("_same"))
    return left.join(right, "position").crossJoin(F.broadcast(same)).where("_same is null").drop("_same")


def label_of(requested: Column, labels: Column, key: str) -> Column:
    """What one key says: `value`, `absent` (asked for and not there) or null (never asked, or no number)."""
    asked = F.array_contains(F.split(requested, " +"), key)
    return F.when(~asked, F.lit(None).cast("string")).when(labels[key].isNull(), "absent").when(C.tolerant_float(labels[key]).isNotNull(), "value")


def import_rows(pairs: DataFrame, fields: dict[str, str], text_column: str = "text_best", ambiguous: bool = True) -> DataFrame:
    """(doc_id, pages, fields) documents from rows (filename, keys, <text>, expected); those without text or fields are dropped.

    `fields` maps keys to line items. Literal `\\n` in a text is a line feed; each text is one page.
    """
    labels = C.first_of_keys(F.col("expected"))
    text = F.replace(F.col(text_column), F.lit("\\n"), F.lit("\n"))
    made = []
    for key, item in fields.items():
        kind, value = label_of(F.col("keys"), labels, key), C.tolerant_float(labels[key])
        made.append(F.when(kind.isNotNull(), F.struct(
            F.lit(item).alias("name"), F.when(kind == "value", value).alias("value"), F.when(kind == "value", 1).alias("page"),
            ((kind == "value") & F.lit(ambiguous)).alias("ambiguous"), F.concat(F.lit("imported from "), F.lit(key)).alias("note"))))
    found = pairs.select(C.safe_doc_id(F.concat(F.lit("import-"), F.col("filename"))).alias("doc_id"), F.array(text).alias("pages"), F.array_compact(F.array(*made)).alias("fields"))
    return found.where((F.size("fields") > 0) & (F.trim(F.regexp_replace(F.col("pages")[0], r"\s+", " ")) != ""))
