import lzma

import pytest

from veriloom import cli
from veriloom.operators.extract import Heuristic, Replay
from veriloom.plans.run import run_corpus
from veriloom.sources import corpus, writers


def test_labels_and_claims_round_trip(spark, tmp_path):
    root = str(tmp_path)
    writers.save_golden(root, {"doc_id": "d", "fields": [{"name": "cash", "value": 5.0}]})
    (tmp_path / "text").mkdir()
    (tmp_path / "text" / "d.json").write_text('{"pages": ["Cash 5"]}')
    claim = {"name": "cash", "value": 5.0, "unit_scale": 1.0, "currency": None, "page": 1, "quote": "Cash 5", "confidence": 0.9}
    writers.save_claims(f"{root}/claims", "d", [claim])
    run = run_corpus(spark, root, Replay(corpus.recorded_claims(spark, f"{root}/claims")))
    assert run.report.where("scope = 'overall'").first().correct == 1
    for bad in (lambda: writers.save_golden(root, {"doc_id": "../x", "fields": []}), lambda: writers.save_golden(root, {"doc_id": "x", "fields": [{"name": "sales"}]}), lambda: writers.save_claims(root, "x", [claim | {"y": 1}])):
        with pytest.raises(corpus.CorpusError):
            bad()


def test_pdf_uploads(tmp_path):
    root = str(tmp_path)
    assert writers.save_pdf(root, "a/Über Report.PDF", b"%PDF-1") == "uber-report" and (tmp_path / "pdfs" / "uber-report.pdf").exists()
    for name, data in (("x.pdf", b""), ("x.pdf", b"PK"), ("...", b"%PDF-")):
        with pytest.raises(corpus.CorpusError):
            writers.save_pdf(root, name, data)


def test_import_verb(spark, tmp_path, capsys):
    text = "a.pdf\tincome town\t\t\t\tTotal revenue 1,000\nb.pdf\tincome\t\t\t\tnothing\nc.pdf\ttown\t\t\t\ty\n\n"
    (tmp_path / "in.tsv.xz").write_bytes(lzma.compress(text.encode()))
    (tmp_path / "expected.tsv").write_text("income=1,000\ntown=x\ntown=y\n")
    out = str(tmp_path / "corpus")
    assert cli.main(["import", out, "--source", str(tmp_path), "--field", "income=revenue_ltm"], spark) == cli.OK
    assert "2 documents" in capsys.readouterr().out
    report = run_corpus(spark, out, Heuristic()).report.where("scope = 'overall'").first()
    assert (report.n_fields, report.correct, report.correct_abstention) == (2, 1, 1)
    assert cli.main(["import", out, "--source", str(tmp_path)], spark) == cli.USAGE
