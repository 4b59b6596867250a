import base64
import hashlib
import io
import random

import pytest

from veriloom.llm import warc


@pytest.fixture()
def pages(spark):
    rng = random.Random(3)
    rows = [(i, f"http://x.example/{i}", "".join(rng.choice("ab<>é\x1f") for _ in range(rng.choice([0, 5, 400, 30_000])))) for i in range(40)]
    rows += [(100, "u", "same"), (101, "u\r\nWARC-Type: resource", "same"), (99, None, "same"), (99, None, "same"), (None, "n", "same"), (7, "again", None)]
    return rows, spark.createDataFrame([(*r, "x", 5) for r in rows], "page_id long, url string, html string, refers_to string, size int")


def expected(rows):
    newest = {}
    for page, _, html in rows:
        if page is not None:
            newest[html or ""] = max(newest.get(html or "", page), page)
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        copies = sum((h or "") == (html or "") for _, _, h in rows)
        first = newest.get(html or "")
        refers = first if copies > 1 and page != first else None
        out.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


@pytest.mark.parametrize("split", [997, 50_000, 1 << 22])
def test_archives_round_trip_at_any_split(spark, pages, tmp_path, split):
    rows, df = pages
    folder = f"file://{tmp_path}/warc"
    assert warc.write_archives(df, folder).agg({"n": "sum"}).first()[0] == len(rows)
    got = warc.read_archives(spark, folder, split)
    found = [tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(found, key=str) == expected(rows)


def test_no_pages_no_records(spark, tmp_path):
    folder = f"file://{tmp_path}/warc"
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.read_archives(spark, folder).count() == 0


class File(io.BytesIO):
    def size(self):
        return len(self.getvalue())

    def read_at(self, n, at):
        return self.getvalue()[at : at + n]


def test_candidates_that_are_no_members_are_passed_over():
    junk = b"\x1f\x8b\x08 no member" + warc.MAGIC
    good = warc.record(1, "u", b"payload", None)
    half = good[:30]
    file = File(junk + good + half + warc.record(2, "u", warc.record(9, "v", b"inner", None, 0), None, 0) + warc.MAGIC)
    for step in (16, 1000):
        cuts = [0, 5, len(junk), len(junk) + 1, len(junk) + len(good) + 3, file.size()]
        got = [at for a, b in zip(cuts, cuts[1:]) for at, _, _ in warc.records_in(file, a, b, step)]
        assert got[0] == len(junk) and len(got) == len(set(got))
        whole = [at for at, _, _ in warc.records_in(file, 0, file.size(), step)]
        assert set(whole) <= set(got)


def test_urls_of_any_length_come_back(spark, tmp_path):
    rng = random.Random(5)
    long = lambda n: "data:," + "".join(rng.choice("abcdefghijklmnop0123456789é") for _ in range(n))
    rows = [(i, long(n), f"page {i}") for i, n in enumerate([5, 65_400, 65_536, 70_000, 1_000_000])]
    folder = f"file://{tmp_path}/warc"
    written = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), folder)
    for split in (50_000, 4 << 20):
        got = warc.all_records(warc.read_archives(spark, folder, split), written).select("page_id", "target_uri").collect()
        assert sorted(map(tuple, got)) == [(i, u) for i, u, _ in rows]
    for step in (16, 65_536):
        file = File(warc.record(1, rows[3][1], b"x", None) + warc.record(2, "v", b"y", None))
        assert [fields["warc-page-id"] for _, fields, _ in warc.records_in(file, 0, file.size(), step)] == ["1", "2"]


def test_a_lost_record_is_an_error(spark, pages, tmp_path):
    rows, df = pages
    folder = f"file://{tmp_path}/warc"
    written = warc.write_archives(df, folder)
    read = warc.read_archives(spark, folder)
    assert warc.all_records(read, written).count() == len(rows)
    with pytest.raises(ValueError):
        warc.all_records(read.where("page_id <> 7 OR page_id IS NULL"), written)
