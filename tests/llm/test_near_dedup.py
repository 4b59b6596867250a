import random

import pytest

from veriloom.llm import near_dedup as nd


def sets(rows, k):
    out = {}
    for doc, text in rows:
        words = [w for w in (text or "").encode().lower().split()]
        n = min(k, len(words))
        out.setdefault(doc, []).append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set())
    return out


def brute(rows, k, percent=80):
    own = sets([r for r in rows if r[0] is not None], k)
    top = {d: d for d in own}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(own)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in own[a] for y in own[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    while len(texts) < n:
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 20, 60, 200]))]
        for _ in range(rng.choice([1, 1, 2, 5, 25])):
            words = base[:]
            for _ in range(rng.randrange(0, max(2, len(words) // 12))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
    ids = rng.sample(range(10_000), n)
    return list(zip(ids, texts))


@pytest.mark.parametrize(("seed", "k"), [(1, 2), (2, 5)])
def test_components_equal_brute_force(spark, seed, k):
    rows = corpus(seed, 250)
    rows += [(20_001, None), (20_002, ""), (20_003, " \n"), (20_004, "one"), (20_005, "ONE"), (20_006, rows[0][1].upper()), (20_007, "long " * 40_000), (20_008, "long " * 40_001)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, component_id string, id int").repartition(3)
    got = nd.near_duplicates(df, k).collect()
    assert len(got) == len(rows)
    want, shingles = brute(rows, k), sets(rows, k)
    for r in got:
        assert (r.component_id, r.kept, r.n_shingles) == (want[r.doc_id], want[r.doc_id] == r.doc_id, len(shingles[r.doc_id][0])), r


def test_null_and_repeated_ids(spark):
    text = "a b c d e f g h i j k l m n o p q r s t"
    rows = [(None, text), (None, text), (5, text), (5, text), (5, "other words here that are not alike"), (3, "other words here that are not alike"), (9, text + " u")]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()), key=str)
    assert got == sorted([(None, None, True)] * 2 + [(5, 3, False)] * 3 + [(3, 3, True), (9, 3, False)], key=str)


def test_empty_table(spark):
    assert nd.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signatures_within_the_distance_share_a_key():
    import numpy as np

    rng = np.random.default_rng(5)
    a = rng.integers(0, 256, (200, nd.SYMBOLS), np.uint8)
    b = a.copy()
    for row in b:  # 31 symbols differ, spread as evenly as can be
        at = np.concatenate([rng.choice(nd.WIDTH, 2, replace=False) + c * nd.WIDTH for c in range(nd.CHUNKS)])[:31]
        row[at] ^= rng.integers(1, 256, 31, np.uint8)
    assert (nd.chunk_keys(a) == nd.chunk_keys(b)).any(1).all()
    assert not (nd.chunk_keys(a)[:-1] == nd.chunk_keys(a)[1:]).any()


def alike(links):
    top = {x: x for p in links for x in p}
    for _ in range(60):
        for a, b in links:
            top[a] = top[b] = min(top[a], top[b])
    return {x: t for x, t in top.items() if any(x in p and p[0] != p[1] for p in links)}


def random_links(seed):
    rng = random.Random(seed)
    return [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 560)] + [(7, 7)]


@pytest.mark.parametrize("parts", [1, 6])
def test_components(spark, parts):
    links = random_links(parts)
    df = spark.createDataFrame(links, "hub long, id long").repartition(parts)
    assert {r.id: r.label for r in nd.components(df).collect()} == alike(links)
    assert nd.components(df.limit(0)).count() == 0


def test_a_tasks_forest_goes_on_in_windows(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(nd, "_WINDOW_LINKS", 20)
    links = [(a, b) for a, b in random_links(3) if a != b]
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*links[i : i + 7])], ["hub", "id"]) for i in range(0, len(links), 7)]
    out = [x for b in nd._forest(batches) for x in zip(b.column("u").to_pylist(), b.column("v").to_pylist())]
    assert alike(out) == alike(links) and all(u > v for u, v in out)


@pytest.mark.parametrize(("rows_bound", "bytes_bound"), [(4, 4_000_000), (256, 300)])
def test_small_cells_lose_nothing(spark, monkeypatch, rows_bound, bytes_bound):
    """A family whose members chain, in cells of a few rows or bytes."""
    monkeypatch.setattr(nd, "_BLOCK_ROWS", rows_bound)
    monkeypatch.setattr(nd, "_BLOCK_BYTES", bytes_bound)
    rng = random.Random(rows_bound)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        words = words[:]
        for _ in range(rng.choice([2, 6])):
            words[rng.randrange(60)] = f"x{rng.randrange(1000)}"
        rows.append((rng.randrange(10**9), " ".join(words)))
    got = {r.doc_id: r.component_id for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 2).collect()}
    assert got == brute(rows, 2)


def test_without_near_copies_keeps_columns_of_any_name(spark):
    text = "a b c d e f g h i j k l m n o p q r s t"
    rows = [(None, text), (None, None), (5, text), (5, "again 5"), (6, text + " u"), (7, "other"), (8, None), (9, "")]
    df = spark.createDataFrame([(d, t, d, 1, "x") for d, t in rows], "doc_id long, text string, kept_id long, place int, component_id string")
    kept = nd.without_near_copies(df)
    assert kept.schema.names == df.schema.names
    assert sorted(((r.doc_id, r.text, r.kept_id) for r in kept.collect()), key=str) == sorted([(d, t, d) for d, t in rows if d != 6], key=str)
    assert nd.without_near_copies(df.limit(0)).count() == 0


def shares_a_key(similarity):
    """That two signatures whose symbols agree as often as sets of this similarity have them share a key."""
    same = similarity + (1 - similarity) / 256
    chunk = same**nd.WIDTH + nd.WIDTH * same ** (nd.WIDTH - 1) * (1 - same)
    return 1 - (1 - chunk) ** nd.CHUNKS


def within(similarity):
    """That they pass the filter on distance."""
    import math

    far = (1 - similarity) * 255 / 256
    return sum(math.comb(nd.SYMBOLS, d) * far**d * (1 - far) ** (nd.SYMBOLS - d) for d in range(nd.FARTHEST + 1))


def test_the_shares_that_the_docstring_states():
    """The formulas, held against signatures of random sets where misses are frequent; and what they give at 0.8."""
    import numpy as np

    rng = np.random.default_rng(11)
    for similarity in (0.5, 0.6):
        met = near = 0
        for _ in range(400):
            both = int(900 * similarity)
            x = rng.integers(0, 2**63, 900, np.uint64)
            pair = np.frombuffer(nd.signature(x[: (900 + both) // 2]) + nd.signature(np.concatenate((x[:both], x[(900 + both) // 2 :]))), np.uint8).reshape(2, -1)
            keys = nd.chunk_keys(pair)
            met += (keys[0] == keys[1]).any()
            near += (pair[0] != pair[1]).sum() <= nd.FARTHEST
        assert met / 400 == pytest.approx(shares_a_key(similarity), abs=0.09) and near / 400 == pytest.approx(within(similarity), abs=0.09)
    assert 1 - shares_a_key(0.8) == pytest.approx(1.3e-5, rel=0.1) and 1 - within(0.8) == pytest.approx(0.8e-5, rel=0.3)
