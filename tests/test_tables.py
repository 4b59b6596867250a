"""Corpora of many documents: tables of JSON lines instead of a file a document."""

import os
from pathlib import Path

import pytest
from pyspark.errors import PySparkException

from veriloom.plans import catalogue
from veriloom.sources import corpus, scratch, writers

SF = "/root/testdata/sf0.001"
TEXTS, LABELS = "doc_id string, pages array<string>", "doc_id string, fields array<struct<name: string, value: double, page: int, ambiguous: boolean, note: string>>"


def save(spark, root, texts, labels):
    writers.save_tables(spark.createDataFrame(texts, TEXTS), spark.createDataFrame(labels, LABELS), root)


def files_of(spark, query, folder):
    """How many files a query's corpus has in a folder of it."""
    top = Path(scratch.shared_folder(spark).removeprefix("file://"))
    before = set(top.glob("corpus-*"))
    query(spark, SF)
    (made,) = set(top.glob("corpus-*")) - before
    return sum(len(names) for d, _, names in os.walk(made) if d[len(str(made)) + 1:].startswith(folder))


def test_labels_table(spark, tmp_path):
    root = str(tmp_path)
    odd = 'é "\\\t'
    save(spark, root, [("a", ["x\ny", ""]), ("b", [""]), ("c", ["z"])], [("a", [("cash", 5.0, 1, True, odd), ("cfads", None, None, None, "")]), ("b", [("cash", float("nan"), 2, False, None)]), ("none", [("cash", 1.0, 1, False, "")])])
    records = corpus.golden_records(spark, root)
    assert [(r.doc_id, r.file, r.source, r.pages, r.scanned, len(r.fields)) for r in records.collect()] == [("a", "a", "import", 2, True, 2), ("b", "b", "import", 1, True, 1), ("c", "c", "import", 1, True, 0)]
    fields = corpus.golden_fields(records).orderBy("doc_id", "pos").collect()
    assert [tuple(r) for r in fields] == [("a", 0, "cash", 5.0, 1, True, odd), ("a", 1, "cfads", None, None, False, ""), ("b", 0, "cash", None, 2, False, "")]
    writers.save_golden(root, {"doc_id": "b", "fields": [{"name": "cfads", "value": 7.0}]})
    writers.save_golden(root, {"doc_id": "d", "fields": []})
    assert [(r.file, [f["name"] for f in r.fields]) for r in corpus.golden_records(spark, root).collect()] == [("a", ["cash", "cfads"]), ("b", ["cfads"]), ("c", []), ("d", [])]


def test_bad_tables(spark, tmp_path):
    for texts, labels in (([("../x", ["a"])], []), ([("", ["a"])], []), ([(None, ["a"])], []), ([("a", ["a"])], [("a", [("sales", 1.0, 1, False, "")])])):
        with pytest.raises(PySparkException):
            save(spark, str(tmp_path), texts, labels)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
def test_labels_are_no_file_a_document(spark):
    assert 0 < files_of(spark, catalogue.golden_labels, "golden") < 40


def test_texts_table(spark, tmp_path):
    root = str(tmp_path)
    odd = 'é  "\\\r\t\x00 {"pages": []}'
    save(spark, root, [("a", [odd, ""]), ("b", [""]), ("c", ["x"]), ("e", [])], [])
    read = lambda: sorted(tuple(r) for r in corpus.text_documents(spark, root).collect())
    assert read() == [("a", [odd, ""]), ("b", [""]), ("c", ["x"]), ("e", [])]
    writers.save_page_text(root, "c", ["own"])
    (tmp_path / "text" / "d.json").write_text('{"pages": ["d"]}')
    assert read() == [("a", [odd, ""]), ("b", [""]), ("c", ["own"]), ("d", ["d"]), ("e", [])]


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
def test_texts_are_no_file_a_document(spark):
    assert 0 < files_of(spark, catalogue.page_count, "text") < 40
