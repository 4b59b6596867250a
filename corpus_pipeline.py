"""The corpus pipeline: five stages over `documents`, each on all that the one before it kept.

Toxic documents go, then copies, then near copies (one document of each group stays); secrets are replaced in what is left,
and the texts are packed into training sequences. All stages but the last return the columns of `documents`. A stage's
result is written to the shared folder before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veriloom.llm import exact_dedup, near_dedup, packing, secret_scan, toxicity
from veriloom.llm.common import table, through_table
from veriloom.llm.queries import tokenizer_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the training rows of `labels`, does not predict to be toxic."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space."""
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near duplicates: five words, a similarity of 0.8.

    Rows that repeat an id are one document; rows without an id are in no group and stay.
    """
    return near_dedup.without_near_copies(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced."""
    return secret_scan.without_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in training sequences."""
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"), "word", 1, with_ids=False)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("MinHash near-dedup", drop_near_copies), ("secret scans", redact_secrets), ("packing", pack)]

#: SQL can neither fit the classifier nor pack; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after another, on `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = through_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
