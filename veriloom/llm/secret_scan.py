"""Secret scans: three patterns, and guess-cost dynamic programming over values in a credential context.

Patterns are leftmost and non-overlapping within a kind; matches that are too short are dropped:

* `assign`: a credential word, `:` or `=`, and a value of 6 or more of `[A-Za-z0-9+/_.=-]`; letters of the word in any case.
* `access`: `AKIA[A-Z0-9]+` of 20 or more characters. * `hex`: `[0-9a-f]+` of 24 or more.

The method adds `guess` spans: values behind a wider set of credential words (pass, pwd, passphrase, key, bearer, ..., also at
the end of a longer name as in `encryption_key`), of any characters but white space, quotes and angle brackets, whose guess
cost is at least `min_bits`. Between them is `:`, `=`, `:=`, `=>` or `==`; white space is enough after `bearer`. Values that a
pattern found already get no second span.

The cost of a value is the least, over all ways to cut it into spans, of the bits that it takes to guess every span, and one
bit a span for its kind. Spans are

* a ranked word, in whatever letter case and with digits or signs for letters: the bits of its rank, of its capitals and of
  each sign that stands for a letter;
* a date, or a year with or without month and day;
* a walk of 3 to 64 characters over neighbouring keys, or along the alphabet or the digits, from any start, either way;
* a unit of up to 32 characters, itself no repeat, 2 to 16 times or as often as it stands there: its own least cost and the
  bits of the number;
* brute force, as many bits as each character's kind has.

So `P@ssword2024` is cheap and no secret, `kX9#vT2!qLm` costs what its characters cost.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.llm.common import place_of, positional, slices

KINDS = ("assign", "access", "hex", "guess")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Words that other words end in (compass, monkey) count behind no letter, or as a part of their own in camelCase.
_CONTEXT = re.compile(
    r"""(?:(?ai:password|passwd|passphrase|passcode|secret|token|credential|(?:api|access|private|secret|encryption|signing)[_-]?key)
    |(?:(?<![^\W\d_])|(?<=[a-z])(?=[A-Z]))(?ai:pwd|pass|auth(?:orization)?|key|bearer))(?ai:s?)
    (?:["'`]?[\x20\t]*(?::=|=>|==?|:)[\x20\t]*(?:(?ai:bearer|basic|token)[\x20\t]+)?|(?<=(?ai:bearer))(?a:\s+))["'`]?(?a:([^\s"'`<>]+))""",
    re.VERBOSE)
#: Every match holds one of these in lower case.
_STEMS = ("pass", "pwd", "secret", "token", "credential", "auth", "key", "bearer")
#: No context word is longer, with its separator.
_LONGEST_CONTEXT = 24

#: Common words of passwords and of placeholders, most frequent first; the words of `_ranked` come behind them.
WORDS = (
    "password", "admin", "user", "test", "example", "secret", "token", "login", "welcome", "changeme", "default", "master",
    "root", "guest", "letmein", "dragon", "monkey", "shadow", "sunshine", "princess", "football", "baseball", "iloveyou",
    "superman", "batman", "trustno", "access", "pass", "key", "api", "your", "here", "none", "null", "true", "false", "demo",
    "sample", "placeholder", "insert", "hidden", "redacted", "summer", "winter", "spring", "autumn", "hello", "world",
    "love", "star", "king", "queen", "server", "database", "public", "private", "config", "string", "value", "name",
)
_PLAIN = str.maketrans("013457@$!|", "oieastasil")
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz", "0123456789")
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d", re.ASCII)
#: Bits for saying what kind a span is.
_SPAN_BITS = 1.0
_LONGEST_UNIT, _MOST_TIMES, _LONGEST_WALK = 32, 16, 64
#: No span but a repeat or brute force is longer.
_LONGEST_SPAN = 64


@lru_cache(1)
def _ranked() -> tuple[dict[str, float], set[str]]:
    """Bits of each word by its rank, and all beginnings of the words.

    `WORDS` come first, then words and parts of words of 3 to 64 letters in the order in which the four public vocabularies of
    `public_tokenizers` (MIT and Apache 2.0 licences, see its LICENSES.txt) learnt them from large corpora, most frequent
    first: mostly English, and in two of them the other languages of the corpus too.
    """
    import public_tokenizers
    import sentencepiece

    ranks = {w: i for i, w in enumerate(WORDS)}
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        lists = [[w.removesuffix("</w>") for w, _ in sorted(json.load(file)["model"]["vocab"].items(), key=lambda x: x[1])]]
    for name in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"):
        with open(public_tokenizers.path(name), "rb") as file:
            lists.append([base64.b64decode(line.split()[0]).decode("utf-8", "replace").strip() for line in file])
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    lists.append([model.id_to_piece(i).strip("\u2581") for i in range(model.get_piece_size())])
    for words in lists:
        rank = len(WORDS)
        for word in dict.fromkeys(w.lower() for w in words):
            if 3 <= len(word) <= _LONGEST_SPAN and word.isalpha():
                ranks[word] = min(ranks.get(word, rank), rank)
                rank += 1
    return {w: math.log2(i + 2) for w, i in ranks.items()}, {w[:n] for w in ranks for n in range(1, len(w) + 1)}


@lru_cache(1)
def _neighbours() -> frozenset[tuple[str, str]]:
    """Pairs of keys or characters that follow one another, either way."""
    pairs = {(a, b) for row in _ROWS for a, b in zip(row, row[1:])}
    return frozenset(pairs | {(b, a) for a, b in pairs})


def _brute_bits(char: str) -> float:
    if char.isdigit():
        return math.log2(10)
    if char.isascii() and char.isalpha():
        return math.log2(26)
    return math.log2(33) if char.isascii() else 16.0


def _walk_bits(size: int) -> float:
    return math.log2(47) + 2 * math.log2(size)


def _word_bits(bits: float, part: str, plain: str) -> float:
    """Bits of a ranked word as `part` writes it; `plain` is its letters, in lower case."""
    upper, size = sum(c.isupper() for c in part), len(part)
    signs = sum(a != b for a, b in zip(part.lower(), plain))
    return bits + (upper > 0) + (math.log2(math.comb(size, min(upper, 2))) if 1 < upper < size else 0.0) + signs


def _date_bits(size: int) -> float:
    return math.log2(150) + (size > 4) * math.log2(12) + (size > 7) * math.log2(31)


def guess_bits(value: str, enough: float = math.inf) -> float:
    """The least bits over all segmentations of a value, in time linear in its length.

    Once the result is sure to be `enough` or more, a number as large is returned without reading on.
    """
    low = value.lower()
    low = low if len(low) == len(value) else value
    plain = low.translate(_PLAIN)
    ranked, beginnings = _ranked()
    pairs = _neighbours()
    dates: dict[int, list[int]] = {}
    for start in range(len(value)):
        if value[start].isdigit() and (m := _DATE.match(value, start)):
            dates.setdefault(m.end(), []).append(start)
    words: dict[int, list[tuple[int, float]]] = {}
    units: dict[str, float | None] = {}
    least, brute, walk = [0.0], math.inf, 1
    alike = [0] * (_LONGEST_UNIT + 1)
    for end in range(1, len(value) + 1):
        # a brute-force span goes on, or opens here
        brute = best = min(brute, least[end - 1] + _SPAN_BITS) + _brute_bits(value[end - 1])
        for stop in range(end, len(plain) + 1):
            if (part := plain[end - 1 : stop]) not in beginnings:
                break
            if (bits := ranked.get(part)) is not None:
                words.setdefault(stop, []).append((end - 1, _word_bits(bits, value[end - 1 : stop], part)))
        for start, bits in words.pop(end, ()):
            best = min(best, least[start] + _SPAN_BITS + bits)
        for start in dates.get(end, ()):
            best = min(best, least[start] + _SPAN_BITS + _date_bits(end - start))
        # walk: characters up to here of which each follows its neighbour
        walk = walk + 1 if end > 1 and (low[end - 2], low[end - 1]) in pairs else 1
        for size in range(3, min(walk, _LONGEST_WALK) + 1):
            best = min(best, least[end - size] + _SPAN_BITS + _walk_bits(size))
        # alike: characters up to here that equal those a unit before
        for size in range(1, min(_LONGEST_UNIT, end - 1) + 1):
            alike[size] = alike[size] + 1 if value[end - 1] == value[end - 1 - size] else 0
            if alike[size] >= size:
                unit, most = value[end - size : end], alike[size] // size + 1
                if unit not in units:
                    units[unit] = guess_bits(unit) if (unit + unit).find(unit, 1) == size else None
                if units[unit] is None:
                    continue
                for times in {*range(2, min(most, _MOST_TIMES) + 1), most}:
                    best = min(best, least[end - size * times] + _SPAN_BITS + units[unit] + math.log2(times))
        least.append(best)
        # a later span starts in the last places, unless it is brute force or a repeat that has long begun
        if end % 32 == 0 and min(brute, *least[-_LONGEST_SPAN - _LONGEST_UNIT :]) >= enough and max(alike) < _LONGEST_SPAN:
            return enough
    return least[-1]


def find_secrets(text: str | None, min_bits: float = 36.0) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then in the order of KINDS."""
    text = text or ""
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    low = text.lower()
    at = 0 if any(x in low for x in _STEMS) else len(text)
    # values come in ascending order: what covers one starts at or before it, and the farthest end of those says so
    base, next_, covered = sorted((a, b) for _, a, b in found), 0, -1
    while m := _CONTEXT.search(text, at):
        start, end = m.span(1)
        at = end
        while next_ < len(base) and base[next_][0] <= start:
            covered = max(covered, base[next_][1])
            next_ += 1
        if end <= covered:
            continue
        value = m[1].rstrip(".,;:)")
        if guess_bits(value, min_bits) >= min_bits:
            found.append(("guess", start, start + len(value)))
            covered = max(covered, start + len(value))
        else:
            at = max(start, end - _LONGEST_CONTEXT)  # the value may itself be the context of another
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def redact(text: str | None, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str | None:
    """`text` with each stretch that spans cover replaced by `mark`."""
    if not spans:
        return text
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _joined(spans: Iterable[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scan(min_bits: float):
    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                spans = find_secrets(text, min_bits)
                base = [x for x in spans if x[0] != "guess"]
                counts = [sum(x[0] == kind for x in spans) for kind in KINDS]
                rows.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
            columns = [pa.array(x, k) for x, k in zip(zip(*rows), [pa.int64()] * 4 + [pa.string()] * 2)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return run


def scan_secrets(docs: DataFrame, min_bits: float = 36.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of `docs`: doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans.

    Whole texts are scanned where they are read, without a shuffle. Null and empty texts have no spans (the digest is that of
    the empty string). Repeated rows and null ids are rows like any other; other columns are left out.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return own.mapInArrow(_scan(min_bits), f"doc_id bigint, {counts}, base_sha256 string, spans string")


def without_secrets(docs: DataFrame, min_bits: float = 36.0, mark: str = "[SECRET]", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """`docs` with every secret in `text` replaced by `mark`, and n_chars, where there is such a column, after it.

    Every row stays, in its columns and with their names whatever these are. Null and empty texts stay as they are; texts of any
    length are scanned whole; spans that overlap are replaced together; repeated rows are alike; an empty table stays empty.
    """
    rows, text = positional(docs), place_of(docs, text_col)
    size = place_of(docs, size_col) if size_col.lower() in map(str.lower, docs.columns) else None

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches, text=text):
            texts = batch.column(text).to_pylist()
            clean = [redact(t, find_secrets(t, min_bits), mark) for t in texts]
            at = batch.schema.get_field_index(text)
            batch = batch.set_column(at, batch.schema.field(at), pa.array(clean, batch.schema.field(at).type))
            if size:
                at, old = batch.schema.get_field_index(size), batch.column(size).to_pylist()
                new = [n if a == b else len(b) for n, a, b in zip(old, texts, clean)]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))
            yield batch

    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)
