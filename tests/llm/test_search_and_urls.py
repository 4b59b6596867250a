import math
import random

from pyspark.sql import functions as F

from veriloom.llm import top_k, url_filter
from veriloom.llm.queries import URL_RULES


def brute_top(rows, k):
    usable = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.append((i, [math.floor(1024 * x) for x in v]))
    asks = {}
    for i, v in usable:
        if i % 100 == 0:
            asks[i] = min(asks.get(i, v), v)
    out = []
    for q, w in asks.items():
        scored = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(w, v)))), i) for i, v in usable if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def vectors(n):
    rng = random.Random(9)
    rows = [(i, [rng.choice([0.0, 0.0, rng.uniform(-1, 1)]) for _ in range(rng.choice([8, 8, 8, 3]))]) for i in range(n)]
    rows += [(1000 + i, [0.5] * 8) for i in range(60)]  # ties
    rows += [(2000, None), (2001, [1.0, None]), (2002, [float("nan")]), (2100, [float("inf")]), (None, [0.5] * 8), (2200, []), (5, [0.25] * 8), (100, [0.5] * 8)]
    return rows


def test_top_k_equals_brute_force(spark):
    rows = vectors(400)
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, score int, block string")
    got = top_k.top_k(df, F.col("vec_id") % 100 == 0, cell_rows=90, query_rows=3)
    assert sorted(tuple(r) for r in got.collect()) == brute_top(rows, 10)
    assert top_k.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_fewer_candidates_and_huge_components(spark):
    rows = [(0, [1e15, 1e15, 1.0]), (1, [1e15, 2e14, 0.0]), (2, [-1e15, -1e15, 3.0])]
    got = top_k.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute_top(rows, 10)


def brute_url(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.partition("://")[2]
        cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: next((i for i, c in enumerate(path) if c in "?#"), len(path))]
    fits = [(len(h + p), h + p, a) for a, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


URLS = [
    None, "", "no scheme/en/7", "http://", "http://com/en/", "http://COM/en/x", "http://xcom/en/", "http://a.example.com/en/7", "http://a.example.com/en/8", "http://example.com.evil.org/en/7", "http://a.net/de/8?x",
    "http://EXAMPLE.net/de/80", "http://b.example.net/de/7", "http://é.ORG/es/#x", "http://a.org?/es/", "http://a.org/ES/", "x://y://z.com/en/7", "http://.com/en/", "http://com./en/", "http://a..com/en/7", "http://a.com:80/en/",
    "http://" + "a." * 3000 + "com/en/" + "x" * 50_000, "http://a.com/en/\nx", "http://\norg/es/", "http://İ.org/es/",
]


def test_url_filter_equals_brute_force(spark):
    rows = [*enumerate(URLS), (3, URLS[3]), (None, URLS[4])]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in rows], "page_id long, url string, host string, rule string")
    got = url_filter.filter_urls(df, url_filter.rule_table(spark, URL_RULES)).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(((i, *brute_url(u)) for i, u in rows), key=str)
    assert url_filter.filter_urls(df.limit(0), url_filter.rule_table(spark, URL_RULES)).count() == 0


def test_rules_that_fit_nothing(spark):
    rules = url_filter.rule_table(spark, [("block", "", "/"), ("block", None, "/"), ("block", "a.b", None), (None, "b", "/"), ("block", "b", "/x"), ("allow", "b", "/x")])
    df = spark.createDataFrame([(1, "http://a.b/x"), (2, "http://b/")], "page_id long, url string")
    assert {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(df, rules).collect()} == {1: ("b/x", "block"), 2: (None, "allow")}
    assert url_filter.filter_urls(df, rules.limit(0)).where("verdict = 'allow'").count() == 2
