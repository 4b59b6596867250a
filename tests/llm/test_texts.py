import hashlib
import math
import pickle
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from veriloom.llm import pieces, secret_scan, toxicity
from veriloom.llm.queries import tokenizer_file

MODEL = tokenizer_file("piece_bpe_32k.model")


# secrets


def brute_base(text):
    text = text or ""
    assign = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [("assign", m.start(), m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda x: (x[1], secret_scan.KINDS.index(x[0])))


TEXTS = [
    None, "", "é password=abcdef12", "PassWord :  'short' token=\"abc\" api-key=1234567 apikey='1234567'", "AKIA" + "A1" * 8, "AKIA" + "A1" * 7 + "A", "AKIAAKIA" + "B" * 16, "f" * 23 + " " + "0" * 24,
    "token = ce0cc631f6559e745b37cb8be6fc63ae2d235c5f", "ſecret=abcdefgh toKen=abcdefgh", "password=\nabcdefgh", "secret = token=abcdefgh", "password: kX9#vT2!qLm.", "pwd: P@ssword2024", "x" * 100_000 + " secret:aaaaaa", "\U0001f600 token=abcdefg",
    "token=" + "aB3$" * 20_000,
]


def test_secret_scan_equals_brute_force(spark):
    rows = [*enumerate(TEXTS), (None, TEXTS[2])]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in [*rows, rows[2]]], "doc_id long, text string, n_hex int, spans string")
    got = secret_scan.scan_secrets(df).collect()
    assert len(got) == len(rows) + 1
    by = {r.doc_id: r for r in got}
    for i, text in rows:
        base, r = brute_base(text), by[i]
        joined = [f"{k}:{a}:{b}" for k, a, b in base]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[0] == k for x in base) for k in ("assign", "access", "hex")]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x and not x.startswith("guess")] == joined
    guessed = {i for i, r in by.items() if r.n_guess}
    assert 12 in guessed and 13 not in guessed
    assert secret_scan.scan_secrets(df.limit(0)).count() == 0


ROWS_OF_KEYS = ["`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz", "0123456789"]
SIGNS = dict(zip("013457@$!|", "oieastasil"))


def follows(a, b):
    return any(a + b in row or b + a in row for row in ROWS_OF_KEYS)


def brute_word(part):
    """Bits of a part of a value as a word, in any case and with signs for letters; infinite if it is none."""
    letters = "".join(SIGNS.get(c, c) for c in part.lower())
    bits = secret_scan._ranked()[0].get(letters, math.inf)
    upper = sum(c.isupper() for c in part)
    cases = (upper > 0) + (math.log2(math.comb(len(part), min(upper, 2))) if 1 < upper < len(part) else 0)
    return bits + cases + sum(a != b for a, b in zip(part.lower(), letters))


def brute_date(part):
    """Bits of a part of a value as a date, read by its digits and signs."""
    cuts = "[-/._]?"
    year, month, day = "(19|20)[0-9][0-9]", "(0[1-9]|1[0-2])", "(0[1-9]|[12][0-9]|3[01])"
    kinds = (year, year + cuts + month, year + cuts + month + cuts + day, day + cuts + month + cuts + year)
    if not any(re.fullmatch(k, part) for k in kinds):
        return math.inf
    return math.log2(150) + (math.log2(12) if len(part) > 4 else 0) + (math.log2(31) if len(part) > 7 else 0)


def brute_char(c):
    return math.log2(10) if c.isdigit() else math.log2(26) if c.isascii() and c.isalpha() else math.log2(33) if c.isascii() else 16


def brute_bits(value):
    """Least cost over all ways to cut a value, each part priced as everything that it may be, all by themselves."""

    def price(a, b):
        part = value[a:b]
        best = min(sum(map(brute_char, part)), brute_word(part))
        if longest_date.get(a) == b:
            best = min(best, brute_date(part))
        if 3 <= b - a <= 64 and all(follows(x, y) for x, y in zip(part.lower(), part.lower()[1:])):
            best = min(best, math.log2(47) + 2 * math.log2(b - a))
        for size in range(1, min(32, (b - a) // 2) + 1):
            unit, times = part[:size], (b - a) // size
            whole = unit * times == part
            repeats_itself = any(unit == unit[:n] * (size // n) for n in range(1, size) if size % n == 0)
            more = value[:a].endswith(unit)
            if whole and not repeats_itself and (times <= 16 or not more):
                best = min(best, cost(unit) + math.log2(times))
        return best + 1

    # of the dates that start in a place, the one that goes farthest
    longest_date = {a: max((b for b in range(a + 4, min(len(value), a + 10) + 1) if brute_date(value[a:b]) < math.inf), default=0) for a in range(len(value))}
    best = [0.0]
    for b in range(1, len(value) + 1):
        best.append(min(best[a] + price(a, b) for a in range(b)))
    return best[-1]


def cost(value):
    return brute_bits(value)


@pytest.mark.parametrize("value", [
    "a", "password", "P@ssword2024", "abcabcabc", "qwertyuiop!1", "kX9#vT2!qLm", "monkey1999-12-31dragon", "aaaabbbbaaaabbbb", "zxcvbn123321", "ééé日本", "20240101admin", "mastertyuiop", "passwordpasswordpassword",
    "a" * 40, "31.12.1999x", "DRAGON", "DrAgOn", "xyzzyxyzabc", "qwqwqwqwqwqwqwqwqwqwqwqwqwqwqwqwqwqwqwqw", "19991231", "1999123",
])
def test_guess_cost_equals_brute_force(value):
    assert secret_scan.guess_bits(value) == pytest.approx(brute_bits(value))


def test_guess_cost_of_random_values_equals_brute_force():
    rng = random.Random(3)
    parts = ["dragon", "Qwe", "aa", "2023", "12", "x", "#", "tyu", "abcab", "s3cr3t", "é", "0-0", "31"]
    for _ in range(60):
        value = "".join(rng.choices(parts, k=rng.randrange(1, 6)))
        assert secret_scan.guess_bits(value) == pytest.approx(brute_bits(value)), value


@pytest.mark.parametrize("enough", [10, 36, 80])
def test_reading_on_changes_no_verdict(enough):
    rng = random.Random(enough)
    for _ in range(150):
        value = "".join(rng.choice(["dragon", "a" * 40, "ab" * 50, "qwertyuiop", "kX9#", "7", "password"]) for _ in range(rng.randrange(1, 12)))
        assert (secret_scan.guess_bits(value, enough) >= enough) == (secret_scan.guess_bits(value) >= enough), value


def test_walks_and_repeats_from_any_start():
    assert secret_scan.guess_bits("mastertyuiop") <= 16.5
    assert secret_scan.guess_bits("passwordpassword") < secret_scan.guess_bits("password") + 4


def test_many_matches_take_no_long_time():
    import time

    text = " ".join(f"password=abcdef{i} key: dragon" for i in range(20_000))
    for text in (text, "key=" + "a" * 50_000, "token: " + "kX9#vT2!qLm" * 10_000):
        began = time.process_time()
        secret_scan.find_secrets(text)
        assert time.process_time() - began < 15


def test_guess_costs_rank_secrets():
    cheap, dear = ("password", "P@ssword2024", "qwertyuiop", "aaaaaaaaaaaa", "changeme123", "2024-01-31"), ("kX9#vT2!qLm", "b7db7aa4a5fcc78305")
    assert max(map(secret_scan.guess_bits, cheap)) < 36 <= min(map(secret_scan.guess_bits, dear))


@pytest.mark.parametrize("context", [
    "password: ", "passwd=", "pass: ", "pwd := ", "pwd => '", "pwd == ", "passphrase=", "key=", "KEY: ", "bearer ", "Bearer: ", "Authorization: Bearer ", "Authorization: Basic ", "secret_key = ", "encryption_key: ",
    "ENCRYPTION-KEY=", "encryptionKey: ", "dbPass=", "\"key\": \"", "mypassword: ", "key: token: ", "key: pwd = ", "api_keys\t=\t", "credentials: ", "auth=", "ſecret pwd=", "Bearer\n",
])
def test_values_of_every_context_are_guessed(context):
    text = f"é {context}kX9#vT2!qLm. end"
    assert [text[a:b] for k, a, b in secret_scan.find_secrets(text) if k == "guess"] == ["kX9#vT2!qLm"]


@pytest.mark.parametrize("text", [
    "Compass: northwest", "credentials: available", "Compass: kX9#vT2!qLm", "monkey: kX9#vT2!qLm", "key: Administration", "the bearer congratulations", "secret: extraordinary", "Token: internationally", "pass: verfügbar",
    "key: disponible", "password: erforderlich", "credential: unavailable.", "auth: authentication", "api_key: documentation",
])
def test_ordinary_words_are_no_guesses(text):
    assert not [x for x in secret_scan.find_secrets(text) if x[0] == "guess"]


def test_random_values_stay_dear():
    rng = random.Random(6)
    for alphabet in ("abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdef"):
        values = ["".join(rng.choice(alphabet) for _ in range(16)) for _ in range(300)]
        assert sum(secret_scan.guess_bits(v) >= 36 for v in values) >= 298


def test_many_contexts_in_one_value_take_no_long_time():
    assert len(secret_scan.find_secrets("key=" * 30_000 + " " + "key: " * 30_000)) <= 1


def test_redaction(spark):
    df = spark.createDataFrame([(1, "a password=abcdef12 b", 20, "s"), (2, None, None, "s"), (3, "clean", 99, "s")], "doc_id long, text string, n_chars long, source string")
    got = {r.doc_id: (r.text, r.n_chars) for r in secret_scan.without_secrets(df).collect()}
    assert got == {1: ("a [SECRET] b", 12), 2: (None, None), 3: ("clean", 99)}


# pieces


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(MODEL)


def best_score(model, word):
    """The least loss over all segmentations, by plain dynamic programming over a dictionary of pieces."""
    names = dict(_names(model))
    best = [0.0] + [-math.inf] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end):
            piece = word[start:end]
            if piece in names:
                best[end] = max(best[end], best[start] + names[piece])
            elif end - start == 1:
                best[end] = max(best[end], best[start] + model.unknown_score)
    return best[-1]


def _names(model):
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    return [(s.id_to_piece(i), s.get_score(i)) for i in range(s.get_piece_size()) if not (s.is_byte(i) or s.is_control(i) or s.is_unknown(i))]


def test_segmentations_are_best(model):
    rng = random.Random(3)
    for word in ["▁the", "▁idiot", "straße", "▁▁▁x", "日本語", "▁" + "ab" * 20, "\U0001f600", "▁Anthn.", *("▁" + "".join(rng.choice("aeinrstü.") for _ in range(rng.randrange(1, 14))) for _ in range(60))]:
        ids = model.segment(word)
        got, k = 0.0, 0
        while k < len(ids):
            if ids[k] in set(model.byte_ids.values()):
                first = model.texts[ids[k]][0]
                got += model.unknown_score
                k += 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            else:
                got += model.scores[ids[k]]
                k += 1
        assert got == pytest.approx(best_score(model, word)), word


def test_trie_holds_every_piece_and_nothing_else(model):
    names = [n for n, _ in _names(model)]
    for name in names[::37]:
        assert any(end == len(name) and model.texts[i].decode() == name.replace("▁", " ") for end, i in model.trie.prefixes(name))
    known = set(names)
    for word in ("qzqzq", "▁zzzzqqq", "xxyyzz"):
        assert all(word[:end] in known for end, _ in model.trie.prefixes(word))


def test_pieces_round_trip(spark, model):
    import pyarrow as pa

    texts = [None, "", " ", "a", " a  b\n c ", "line\n\nline", "日本 \U0001f600", "tab\tx", "é" * 40_000, "has ▁ mark", "a\n b", "x y\nz"]
    assert model.encode_all(pa.array(texts, pa.string())) == [model.encode(t) for t in texts]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(1, "", 1), (None, "a", 1)], "doc_id long, text string, n_tokens int")
    encoded = pieces.encode_documents(df, MODEL)
    back = {r.doc_id: r.text for r in pieces.decode_documents(encoded, MODEL).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in enumerate(texts))
    flags = {r.doc_id: (r.round_trip, r.n_tokens == len(r.ids)) for r in encoded.collect()}
    assert flags[9] == (False, True) and all(f == (True, True) for i, f in flags.items() if i != 9)
    assert pieces.encode_documents(df.limit(0), MODEL).count() == 0


# toxicity


def labelled(n=900):
    rng = random.Random(8)
    filler = [f"wort{c}{d}" for c in "abcdefgh" for d in "klmnopqr"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(filler) for _ in range(rng.choice([5, 40]))]
        toxic = i % 6 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["Idiot", "clown.", "lowenix" + rng.choice("abc"), "scum"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = labelled()
    extra = [(10_000, None), (10_001, ""), (10_002, "idiot " * 20_000), (10_003, "nothing at all"), (None, "idiot"), (3, rows[3][1])]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows + extra], "doc_id long, text string, score int, evidence string")
    lab = spark.createDataFrame([(i, y, y) for i, y in labels] + [(None, 1, 1), (5, None, 1), (7, 9, 1), (77_777, 1, 1)], "doc_id long, toxic int, held_out int")
    got = toxicity.toxicity(df, lab).collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    by = {r.doc_id: r for r in got}
    assert by[10_002].predicted == 1 and by[10_003].predicted == by[10_000].predicted == by[10_001].predicted == 0
    assert set(by[10_002].evidence) <= set(truth) and "idiot" in by[10_002].evidence_terms
    kept = {r.doc_id for r in toxicity.without_toxic(df.select("doc_id", "text"), lab).collect()}
    assert 10_003 in kept and 10_002 not in kept


def test_labels_without_documents_take_no_places(spark, monkeypatch):
    rows, labels = labelled(300)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(i, i % 2) for i in range(1000, 6000)], "doc_id long, toxic int")
    train = [(i, y) for i, y in labels if not toxicity.held_out(i)]
    monkeypatch.setattr(toxicity, "MOST_EXAMPLES", 30)
    # a hot id with many texts, and a hot text with many ids, stay within the bound
    hot = spark.createDataFrame([(train[0][0], f"other {i}") for i in range(200)] + [(20_000 + i, "same") for i in range(200)], "doc_id long, text string")
    more = spark.createDataFrame([(20_000 + i, 0) for i in range(200)], "doc_id long, toxic int")
    for docs, known in ((df, lab), (df.union(hot), lab.union(more))):
        examples, prior = toxicity._sample(docs, known, "toxic")
        got = examples.collect()
        assert [sum(r.y == k for r in got) for k in (0, 1)] == [30, 30] and len({r.content for r in got}) == 60
        if docs is df:
            assert {(r.doc_id, r.y) for r in got} <= set(train) and prior == pytest.approx(sum(y for _, y in train) / len(train))


def test_toxicity_without_evidence(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.toxicity(df, none).collect()] == [0.0, 0.0]
    assert toxicity.toxicity(df.limit(0), none).count() == 0


def test_no_row_votes_on_itself(spark):
    """Of equal texts, with whatever label, all score alike, and a text's score is the same with its own label turned."""
    rows, labels = labelled(400)
    copies = [(1000 + i, t) for i, t in rows[:40]]
    df = spark.createDataFrame(rows + copies, "doc_id long, text string")
    scores = []
    for turn in (False, True):
        lab = spark.createDataFrame([(i, 1 - y if turn and i == 2 else y) for i, y in labels], "doc_id long, toxic int")
        got = {r.doc_id: r for r in toxicity.toxicity(df, lab).collect()}
        assert all(got[i].score == got[1000 + i].score and got[i].evidence == got[1000 + i].evidence and i not in got[i].evidence for i in range(40))
        scores.append(got[2].predicted)
    assert scores == [0, 0] and not toxicity.held_out(2)


def brute_neighbours(texts, examples, weight, names, k=15):
    """All cosines of all terms, one by one."""

    def vector(text):
        raw = {t: (1 + math.log(n)) * weight[names[t]] for t, n in toxicity.terms(text).items() if t in names}
        length = math.sqrt(sum(x * x for x in raw.values()))
        return {t: x / length for t, x in raw.items()}

    own = [vector(t) for t in examples]
    out = []
    for text in texts:
        v = vector(text)
        scored = ((-round(sum(x * e.get(t, 0.0) for t, x in v.items()), 9), i) for i, e in enumerate(own) if examples[i] != text and v.keys() & e.keys())
        out.append(sorted(scored)[:k])
    return out


@pytest.mark.parametrize("block", [4, 32, 512])
def test_neighbours_are_exact_over_all_terms(monkeypatch, block):
    monkeypatch.setattr(toxicity, "BLOCK", block)
    rng = random.Random(block)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.choice([1, 2, 5, 8]))) for _ in range(400)]
    text = lambda n: " ".join(rng.choices(words, k=n)) + rng.choice(["", ".", " 12", " the the"])
    examples = sorted({text(rng.choice([1, 3, 20, 200])) for _ in range(300)} | {"", "77"}, key=toxicity.content_digest)
    names: dict = {}
    owner, term, count = [], [], []
    for i, t in enumerate(examples):
        for name, n in toxicity.terms(t).items():
            owner.append(i), term.append(names.setdefault(name, len(names))), count.append(n)
    weight = np.array([rng.uniform(1, 9) for _ in names])
    index = toxicity.Index(pa.array(list(names)), weight, [toxicity.content_digest(t) for t in examples], np.arange(len(examples)), np.zeros(len(examples)), 0.1, np.array(owner), np.array(term), np.array(count))
    texts = [text(rng.choice([0, 1, 4, 50])) for _ in range(60)] + examples[:20] + ["", "unheard"]
    index = pickle.loads(pickle.dumps(index))  # as workers get it
    cosines, found = index.nearest(len(texts), *toxicity.TermNumbers(list(names))(pa.array(texts)), [toxicity.content_digest(t) for t in texts])
    got = [[(-round(c, 9), i) for c, i in zip(cs, es) if i >= 0] for cs, es in zip(cosines.tolist(), found.tolist())]
    for mine, want in zip(got, brute_neighbours(texts, examples, weight, names)):
        assert [c for c, _ in mine] == pytest.approx([c for c, _ in want], abs=2e-9)
        assert all(a == b or abs(x - y) < 3e-9 for (x, a), (y, b) in zip(mine, want))


def test_term_numbers_agree_with_terms():
    vocabulary = ["idiot", "~idio", "été", "~clown", "a", "~clow"]
    texts = ["Idiot idiots xidiot idiot_ IDIOT2 été étés a aa clown clowns clowning cloWned", "", None, "1 2", "a" * 100_000 + " a"]
    text, term, count = toxicity.TermNumbers(vocabulary)(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        want = {n: c for n, c in toxicity.terms(t).items() if n in vocabulary}
        assert {vocabulary[k]: c for x, k, c in zip(text.tolist(), term.tolist(), count.tolist()) if x == i} == want


def test_words_of_any_script_are_cut_alike():
    rng = random.Random(7)
    signs = ["a", "B", "z", "é", "É", "ß", "İ", "ñ", "Ж", "字", "の", "𝒜", "😀", "—", "“", "\xa0", "\u0301", "ª", "²", "٣", "_", "-", "7", " ", "\n", "\0", "\u200b"]
    texts = ["", None, "é", "—", "a—b", "—a—a—", "", "été—idiot", *("".join(rng.choices(signs, k=rng.choice([0, 1, 5, 40, 300]))) for _ in range(300)), None, ""]
    vocabulary = sorted(set().union(*map(toxicity.terms, texts)))
    for array, own in ((pa.array(texts, pa.string()), texts), (pa.array(texts, pa.string())[5:90], texts[5:90]), (pa.array([None, ""], pa.string()), [None, ""])):
        text, term, count = toxicity.TermNumbers(vocabulary)(array)
        assert (np.diff(text * len(vocabulary) + term) > 0).all()
        for i, t in enumerate(own):
            assert {vocabulary[k]: c for k, c in zip(term[text == i].tolist(), count[text == i].tolist())} == toxicity.terms(t)


def test_words_that_share_a_beginning_look_it_up_once(monkeypatch):
    """Documents hold many words that no other has: their beginnings are looked up once, and each word is found once."""
    import pyarrow.compute as pc

    looked_up, index_in = [], pc.index_in
    monkeypatch.setattr(pc, "index_in", lambda values, **of: looked_up.extend(values.to_pylist()) or index_in(values, **of))
    words = ["common" + a + b for a in "abcdefghij" for b in "abcdefghij"]
    text, term, count = toxicity.TermNumbers(["~comm", "~commo", "commonaa"])(pa.array([" ".join(words)]))
    assert (term.tolist(), count.tolist()) == ([0, 1, 2], [100, 100, 1]) and len(looked_up) == len(words) + 3


def test_a_blocks_postings_lie_together(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 2)
    monkeypatch.setattr(toxicity, "_COMMON", 2)  # all terms have lists
    owner, term = np.repeat(np.arange(6), 9), np.tile(np.arange(9), 6)
    index = toxicity.Index(pa.array([f"t{i}" for i in range(9)]), np.linspace(1, 2, 9), [str(i) for i in range(6)], np.arange(6), np.zeros(6), 0.1, owner, term, np.ones(54, int))
    assert (np.diff(index.run_block[np.argsort(index.run_start)]) >= 0).all() and index.run_size.sum() == len(index.values) == 54


def test_the_curve_rises():
    curve = toxicity.fit_curve(np.array([0.1, 0.1, 0.2, 0.5, 0.6, 0.9]), np.array([0, 0, 1, 0, 1, 1]), 0.5)
    scores = curve.scores(np.array([0.0, 0.1, 0.2, 0.5, 0.6, 1.0, np.nan]))
    assert (np.diff(scores[:-1]) >= 0).all() and scores[0] == 0 and scores[5] == 1 and scores[6] == 0.5
