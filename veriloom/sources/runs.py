"""Run artifacts: a folder each, with the run as one JSON document and its documents as JSON lines; listed newest first."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = "run_id string, extractor string, corpus_root string, created_at string, alpha double, verified boolean, skipped array<string>, _corrupt string"


def save_run(artifact: DataFrame, path: str, documents: DataFrame | None = None) -> None:
    """`artifact` has one row; its columns are the run's keys. `documents` go to a folder beside it, as many files as there are
    tasks; they are written first, so that a run that can be listed is whole."""
    whole = {"ignoreNullFields": "false"}
    if documents is not None:
        documents.select(F.to_json(F.struct(*documents.columns), whole).alias("value")).write.mode("overwrite").text(f"{path}/documents")
    artifact.select(F.to_json(F.struct(*artifact.columns), whole).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/run")


def load_run(spark: SparkSession, path: str) -> DataFrame:
    """The run's document as a VARIANT, so that documents of any version can be read."""
    return spark.read.text(f"{path}/run", wholetext=True).select(F.parse_json("value").alias("run"))


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    """The run's documents: doc_id, and the whole as a VARIANT; none where a run has none or withholds them."""
    try:
        lines = spark.read.text(f"{path}/documents")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        lines = spark.createDataFrame([], "value string")
    parsed = lines.select(F.parse_json("value").alias("document"))
    return parsed.select(F.variant_get("document", "$.doc_id", "string").alias("doc_id"), "document")


def as_dict(spark: SparkSession, path: str, most_documents: int | None = None) -> dict:
    """The run as plain data, with its documents (or the first of them by id) in the list that other readers look for."""
    found = spark.read.text(f"{path}/run", wholetext=True).first()
    rows = load_documents(spark, path).orderBy("doc_id")
    rows = rows if most_documents is None else rows.limit(most_documents)
    return json.loads(found[0]) | {"documents": [json.loads(r[0]) for r in rows.select(F.to_json("document")).collect()]}


def list_runs(spark: SparkSession, path: str) -> DataFrame:
    """Headers of all artifacts, newest first; unreadable ones are listed with `error`."""
    found = spark.read.schema(HEADER).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    named = found.withColumn("file", F.col("_metadata.file_name"))
    return named.withColumn("error", F.when(F.col("run_id").isNull(), "not a run artifact")).drop("_corrupt").orderBy(F.desc_nulls_last("created_at"), "file")
