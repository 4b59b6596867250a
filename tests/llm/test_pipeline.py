import os
import random
import re

import pytest
from test_near_dedup import brute

import __spark_entry__
import corpus_pipeline
from veriloom.llm import near_dedup, secret_scan, toxicity

SF = "/root/testdata/sf0.001"


def small_corpus(seed=4):
    """Rows (doc_id, text) with toxic words, exact and near copies, secrets, nulls and repeated ids, and labels of most."""
    rng = random.Random(seed)
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in ("lo", "mi", "ster")]
    rows, labels = [], []
    for i in range(240):
        text = [rng.choice(words) for _ in range(rng.choice([4, 30, 80]))]
        toxic = i % 6 == 0
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(["idiot", "scum"])
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    clean = [r for r in rows if r[0] % 6]
    for n, (_, text) in enumerate(clean[:40]):
        own = text.split()
        rows.append((1000 + n, "  ".join(own)))  # an exact copy but for white space
        if len(own) == 80:
            own[3] = "other"
            rows.append((2000 + n, " ".join(own)))  # a near copy
    rows += [(3000, "the password=hunter2hunter2 of it"), (3001, "key: kX9#vT2!qLm"), (3002, None), (3003, ""), (None, "no id here"), (None, None), (3004, "one text"), (3004, "another text of its id"), (3005, "long " * 3000)]
    return rows, labels


def test_each_stage_against_brute_force(spark, tmp_path):
    rows, labels = small_corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept_id long, digest string, place string"
    docs = spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t), d, "x", "y") for d, t in rows], schema).repartition(5)
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    lab = spark.read.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    pairs = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)

    def apply(name, before):
        out = stages[name](spark, before, str(tmp_path))
        assert out.schema.names == docs.schema.names
        out.write.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
        return spark.read.parquet(f"{tmp_path}/{name.replace(' ', '-')}")

    # toxicity: the rows that have one of the two words, and no others
    after = apply("toxicity", docs)
    assert pairs(after) == sorted(((d, t) for d, t in rows if not re.search("idiot|scum", t or "")), key=str)
    judged = {r.doc_id for r in toxicity.toxicity(docs, lab).where("predicted = 0").collect()}
    assert judged == {d for d, _ in pairs(after)}

    # exact copies: of equal texts the longest, then the smallest id
    groups = {}
    for d, t in pairs(after):
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((d, t))
    want = [min(g, key=lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0)) for g in groups.values()]
    after = apply("exact dedup", after)
    assert [(d, t or "") for d, t in pairs(after)] == [(d, t or "") for d, t in sorted(want, key=str)]

    # near copies: all pairs of five-word shingle sets
    left = pairs(after)
    component = brute(left, 5)
    after = apply("MinHash near-dedup", after)
    assert pairs(after) == [(d, t) for d, t in left if d is None or component[d] == d] and len(left) > len(pairs(after))

    # secrets: replaced where the spans say so, all rows stay
    left = pairs(after)
    after = apply("secret scans", after)
    assert pairs(after) == sorted(((d, secret_scan.redact(t, secret_scan.find_secrets(t))) for d, t in left), key=str)
    found = dict(pairs(after))
    assert found[3000] == "the [SECRET] of it" and found[3001] == "key: [SECRET]"
    assert all(r.n_chars is None or r.n_chars == len(r.text) for r in after.collect())

    # packing: each id of each document in one piece, gapless in document and sequence
    pieces = stages["packing"](spark, after, str(tmp_path)).collect()
    tokens, spans, sequences = {}, {}, {}
    for p in pieces:
        tokens.setdefault(p.doc_id, set()).add(p.doc_tokens)
        spans.setdefault(p.doc_id, []).append((p.start, p.length))
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert set(spans) == {d for d, _ in pairs(after)}
    for at in sequences.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(at), sorted(at)[1:])) and sorted(at)[0][0] == 0 and sum(n for _, n in at) <= 2048
    for d, at in spans.items():
        if len(tokens[d]) == 1 and d is not None and d != 3004:
            assert all(a + n == b for (a, n), (b, _) in zip(sorted(at), sorted(at)[1:])) and sum(n for _, n in at) == next(iter(tokens[d]))


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
def test_the_run_gives_what_its_stages_give(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "MinHash near-dedup", "secret scans", "packing"]
    ids = {r.doc_id for r in docs.collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, SF)
        assert out.schema.names == docs.schema.names
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        now = [r.doc_id for r in docs.collect()]
        assert len(now) == len(set(now)) and set(now) <= ids and len(now) > 0.5 * len(ids)
        if name == "secret scans":
            assert set(now) == ids
        ids = set(now)
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == ids


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def python_functions(node):
    """(most Python functions that a task of this plan runs one after another, those of its own stage)."""
    if node.nodeName() == "AdaptiveSparkPlan":
        node = node.initialPlan()
    children = node.children()
    below = [python_functions(children.apply(i)) for i in range(children.size())]
    most, own = max((b[0] for b in below), default=0), max((b[1] for b in below), default=0)
    own += bool(re.search("InArrow|InPandas|Python", node.nodeName()))
    return max(most, own), 0 if "Exchange" in node.nodeName() else own


def test_no_task_takes_two_python_workers(spark, tmp_path, monkeypatch):
    """Workers live on: what one stage took more of, the next ones' memory is held by."""
    rng = random.Random(5)
    words, rows = [f"w{i}" for i in range(60)], []
    for i in range(80):  # a chain of near copies, so that components are compared with each other
        words = words[:]
        for _ in range(rng.choice([1, 3])):
            words[rng.randrange(60)] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(words + ["scum"] * (i % 9 == 0))))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 9 == 0)) for i in range(80)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    plans = []

    def kept(make):
        def run(df, what):
            plans.append((what, df._jdf.queryExecution().executedPlan()))
            return make(df, what)

        return run

    for module in (toxicity, near_dedup, corpus_pipeline):
        monkeypatch.setattr(module, "through_table", kept(module.through_table))
    last = corpus_pipeline.run(spark, str(tmp_path))
    plans.append(("packing", last._jdf.queryExecution().executedPlan()))
    found = [(what, python_functions(plan)[0]) for what, plan in plans]
    assert [(w, n) for w, n in found if n > 1] == []
    assert {"examples", "toxicity", "prints", "edges", "links", "family-links", "secret-scans", "packing"} <= {w for w, n in found if n}


def test_every_operator_has_a_query():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= names


def test_a_cluster_without_a_shared_folder_is_refused(monkeypatch):
    from veriloom.llm import common

    class Session:
        def __init__(self, **named):
            self.conf = {k.replace("_", "."): v for k, v in named.items()}

    assert common.shared_folder(Session(spark_checkpoint_dir="hdfs://x/y/", spark_master="yarn")) == "hdfs://x/y"
    assert common.shared_folder(Session(spark_master="local[4]")).startswith("file:")
    with pytest.raises(ValueError):
        common.shared_folder(Session(spark_master="spark://host:7077"))


def test_caches_are_bounded_by_bytes():
    from veriloom.llm.common import Kept

    kept = Kept(100_000)
    for i in range(50):
        kept.add([f"{i}" + "x" * 10_000], [b"y" * 100])
        assert kept.held <= 100_000 and sum(len(k) for k in kept) < 100_000
    kept.add(["z" * 1_000_000], [b""])
    assert not kept
