import hashlib
import re

import pytest

from veriloom.llm import exact_dedup

SPACE = re.compile("[\x20\x09-\x0d]")


def brute(rows):
    groups = {}
    for doc, text in rows:
        groups.setdefault(SPACE.sub("", text or ""), []).append((doc, text or ""))
    out = []
    for doc, text in rows:
        bare = SPACE.sub("", text or "")
        same = groups[bare]
        keep = min(same, key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0))[0]
        out.append((doc, keep, len(same), doc == keep, hashlib.sha256(bare.encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [
    (1, "a b"), (2, "ab"), (3, "a  b "), (4, "a  b "), (None, "a b      "), (5, None), (6, ""), (7, " \t\n\x0b\x0c\r"), (8, "a\xa0b"), (9, "é" * 50_000), (10, "é " * 50_000),
    (-(2**63), "min"), (2**63 - 1, "m in"), (11, "A b"), (12, "dup"), (12, "dup"), (None, "only"), (None, "only"),
]


def test_equals_brute_force(spark):
    df = spark.createDataFrame([(d, t, "x", 1, False) for d, t in ROWS], "doc_id long, text string, keep_id string, group_size int, kept boolean").repartition(5)
    assert sorted((tuple(r) for r in exact_dedup.exact_dedup(df).collect()), key=str) == brute(ROWS)


def test_empty_table(spark):
    assert exact_dedup.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_third_of_all_rows_in_one_group(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "case when id % 3 = 0 then concat('same', repeat(' ', int(id % 7))) else concat('t', id) end as text").repartition(9)
    got = exact_dedup.exact_dedup(df, salts=3)
    assert got.where("group_size = 1000 and keep_id = 6").count() == 1000 and got.where("kept").count() == 2001


def test_without_copies_keeps_one_row_and_all_columns(spark):
    schema = "doc_id long, text string, digest string, `check` int, best string, Place int, `a.b` string, tags array<string>, m map<string, int>"
    df = spark.createDataFrame([(d, t, "x", 1, "y", 2, "z", ["q"], {"k": 1}) for d, t in ROWS], schema).repartition(5)
    kept = exact_dedup.without_copies(df)
    assert kept.schema == df.schema
    rows = kept.collect()
    best = {}
    for d, t in ROWS:
        bare = SPACE.sub("", t or "")
        best[bare] = min(best.get(bare, (0, True, 0)), (-len(t or ""), d is None, d or 0))
    assert sorted((-len(r.text or ""), r.doc_id is None, r.doc_id or 0) for r in rows) == sorted(best.values()) and {r["a.b"] for r in rows} == {"z"}
    assert exact_dedup.without_copies(df.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_rows_that_repeat_an_id(spark, parts):
    """The longest of an id's own rows stays, however the rows lie; equal ones are told apart by their other columns."""
    rows = [(1, "ab", 1), (1, "a  b", 2), (1, "a b", 3), (2, "ab", 4), (3, "x", 9), (3, "x", 8), (3, "x", 8)]
    found = set()
    for turn in (rows, rows[::-1]):
        df = spark.createDataFrame(turn, "doc_id long, text string, n int").repartition(parts)
        found.add(tuple(sorted(tuple(r) for r in exact_dedup.without_copies(df).collect())))
    assert len(found) == 1 and next(iter(found))[0] == (1, "a  b", 2) and len(next(iter(found))) == 2
