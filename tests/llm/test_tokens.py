import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from veriloom.llm import packing, token_files
from veriloom.llm.queries import tokenizer_file
from veriloom.llm.tokens import WordTokens

BYTE, WORD = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("word_bpe_49k.json")
ODD = ["", None, " a  b", "\n\nx y\n", "tab\tx y", "<|endoftext|> z", "a b c", "É é ß Σ ΣΑΣ don't I'LL x's", "\r\n a b", " ", "\n", "a\n", "\x1c a b", "日本 語 123 4,5", "x, y. Z,z.. e\u0301 é", "a.\nB, c", "\x01 b \x01", "ﬁn ª º"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    words = ["der", "Straße", "été", "the", "idiot", "x1y2", "co-op", "end.", "comma,", "—", "日本", "I'm", "WORD", "naïve."]
    return ODD + ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", "  "]) for _ in range(rng.choice([1, 30, 300]))) for _ in range(60)] + ["long word " * 30_000]


@pytest.mark.parametrize(("path", "kind"), [(BYTE, "byte"), (WORD, "word")])
def test_ids_are_the_library_s(texts, path, kind):
    tokens = WordTokens(path, kind, most_bytes=5_000)
    want = [np.asarray(x.ids, "<u4").tobytes() for x in tokens.library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for step in (7, 1000):
        got = [x for i in range(0, len(texts), step) for x in tokens.encode(pa.array(texts[i : i + step], pa.string()))]
        assert got == want


@pytest.mark.parametrize(("path", "kind"), [(BYTE, "byte"), (WORD, "word")])
def test_ids_are_those_of_a_tokenizer_loaded_afresh(texts, path, kind):
    from tokenizers import Tokenizer

    texts = [*texts, "a <|endoftext|> b", "<|startoftext|>a<|endoftext|>", "x\n<|endoftext|>\ny"]
    fresh = Tokenizer.from_file(path)
    special = {i: x.content for i, x in fresh.get_added_tokens_decoder().items()}
    fresh.encode_special_tokens = True  # as the README says: such a string in a text is plain text
    want = [x.ids for x in fresh.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    got = [np.frombuffer(x, "<u4").tolist() for x in WordTokens(path, kind).encode(pa.array(texts, pa.string()))]
    assert got == want and special and not any(special.keys() & set(x) for x in got)


@pytest.mark.parametrize("mode", ["byte", "bit"])
def test_planes_round_trip(mode):
    rng = np.random.default_rng(2)
    for n in (1, 7, 8, 1000):
        ids = rng.integers(0, 2**32, n, dtype=np.uint32).astype("<u4").tobytes()
        planes = token_files.to_planes(ids, mode)
        assert len(planes) == token_files.PLANES[mode] and token_files.from_planes(planes, n, mode) == ids


@pytest.mark.parametrize(("mode", "block"), [("byte", 65_536), ("bit", 100)])
def test_token_files_round_trip(spark, texts, tmp_path, mode, block):
    ids = random.Random(4).sample(range(-50, 1000), len(texts) - 3) + [None, 5000, 5000]
    rows = list(zip(ids, texts))
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, start int, _h string").repartition(4)
    folder = f"file://{tmp_path}/tokens"
    token_files.write_token_files(df, folder, BYTE, "byte", 2, block, mode)
    got = token_files.read_token_files(spark, folder).orderBy("start").collect()
    library = WordTokens(BYTE, "byte").library
    want = sorted((d, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in rows if d is not None)
    assert [r.doc_id for r in got] == [None, *(d for d, _ in want)]
    assert sorted((r.doc_id, r.ids) for r in got if r.doc_id is not None) == want
    at = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), zlib.crc32(np.asarray(r.ids, "<u4").tobytes()))
        at += r.n_tokens


def test_no_documents_no_tokens(spark, tmp_path):
    folder = f"file://{tmp_path}/tokens"
    token_files.write_token_files(spark.createDataFrame([], "doc_id long, text string"), folder, BYTE, "byte", 2)
    assert token_files.read_token_files(spark, folder).count() == 0


def test_a_damaged_block_is_noticed(tmp_path):
    from pyarrow import fs

    system, path = fs.LocalFileSystem(), str(tmp_path / "s.vtok")
    token_files.publish(system, path, lambda out: [w := token_files.ShardWriter(out, 4), w.add(1, bytes(range(40))), w.close()])
    raw = bytearray((tmp_path / "s.vtok").read_bytes())
    reader = token_files.ShardReader(system.open_input_file(path))
    assert reader.block(0) == bytes(range(16)) and reader.block(2) == bytes(range(32, 40))
    reader.blocks[0][2] ^= 1
    with pytest.raises(ValueError):
        reader.block(0)
    raw[:4] = b"none"
    (tmp_path / "t.vtok").write_bytes(raw)
    with pytest.raises(ValueError):
        token_files.ShardReader(system.open_input_file(str(tmp_path / "t.vtok")))


@pytest.mark.parametrize(("capacity", "window"), [(64, 300), (2048, 1_000_000)])
def test_packing_places_every_id_once(spark, texts, capacity, window):
    rows = [*enumerate(texts), (3, texts[3]), (None, "x"), (7, texts[7])]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, offset int, length string").repartition(3)
    got = packing.pack_documents(df, WORD, "word", 1, capacity, window).collect()
    library = WordTokens(WORD, "word").library
    want = sorted((str(d), [*library.encode(t or "", add_special_tokens=False).ids, 1]) for d, t in rows)
    sequences = {}
    for r in got:
        assert r.length == len(r.ids) > 0 and r.ids_crc32 == zlib.crc32(np.asarray(r.ids, "<u4").tobytes())
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == capacity or at < capacity and at & (at - 1) == 0
    by_doc = {}
    for r in sorted(got, key=lambda r: r.start):
        by_doc.setdefault(str(r.doc_id), []).append(r)
    once = {d: ids for d, ids in want if sum(x == d for x, _ in want) == 1}
    for d, ids in once.items():
        assert [i for r in by_doc[d] for i in r.ids] == ids and {r.doc_tokens for r in by_doc[d]} == {len(ids)}
    assert sum(r.length for r in got) == sum(len(ids) for _, ids in want)


def test_packing_balances_cost():
    packer = packing.Packer(100, 1.0, 0.01, 0)
    packer.window([packing.Piece(i, 0, bytes(4 * n), n) for i, n in enumerate([90, 60, 40, 35, 30, 20, 15, 10])])
    first = {p.doc_id: s for p, s, _ in packer.placed if p.start == 0}
    assert first[0] != first[1] != first[2] and len({s for _, s, _ in packer.placed}) == 3
    packer.finish()
    assert packer.rest == []


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), WORD, "word", 1).count() == 0
