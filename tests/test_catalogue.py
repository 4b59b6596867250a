import math
import os

import duckdb
import pytest

from veriloom.plans import catalogue

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        return str(v)
    return round(float(v), 6)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    return con


@needs_tables
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    result = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted((tuple(plain(v) for v in r) for r in result.fetchall()), key=str)
    assert sorted((tuple(plain(r[n]) for n in names) for r in got.collect()), key=str) == want
