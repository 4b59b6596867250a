"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

A text gets a white-space marker in front and for every space. The segmentation with the largest sum of piece scores wins; of
equal sums, the one whose last piece starts earliest. A character that no piece covers costs the least score less 10 and
becomes byte pieces. Pieces and their scores come from a SentencePiece model file; whatever they were trained as, they are
taken as log scores here. Decoding joins pieces and bytes, turns markers into spaces and drops the one in front.

No piece has a marker behind another character, so a text's best segmentation is its words' best ones, each word with the
markers before it; a worker keeps those of the words it has met.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.llm.common import Kept, resident, slices

MARK = "▁"
_WORDS = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
_ODD = f"  |^ | $| \\n|\\n |{MARK}"
#: Bytes of words and their ids that a worker keeps.
_MOST_BYTES = 160_000_000


class DoubleArray:
    """A trie of strings in two arrays: the child of node s by character code c is base[s] + c if check says s.

    Codes are given by frequency, so that common characters share small offsets; value[s] is an entry's number plus 1.
    """

    def __init__(self, entries: list[tuple[str, int]]):
        counts: dict[str, int] = {}
        for text, _ in entries:
            for c in text:
                counts[c] = counts.get(c, 0) + 1
        self.codes = {c: i + 1 for i, c in enumerate(sorted(counts, key=lambda c: (-counts[c], c)))}
        tree: dict = {}
        for text, number in entries:
            node = tree
            for c in text:
                node = node.setdefault(self.codes[c], {})
            node[0] = number + 1
        # places for the children of a state are sought from where the last ones were found, so some cells stay free
        base, check, value = [0] * len(self.codes), [-1] * len(self.codes), [0] * len(self.codes)
        check[0] = 0
        waiting, tried = [(0, tree)], [1] * 9
        while waiting:
            state, node = waiting.pop()
            value[state] = node.pop(0, 0)
            children = sorted(node)
            if not children:
                continue
            first, rest, kind = children[0], [c - children[0] for c in children[1:]], min(len(children), 8)
            at, span = max(tried[kind], first + 1), children[-1] - first + 1
            while True:
                if at + span > len(check):
                    more = at + span + 4096
                    base += [0] * more
                    check += [-1] * more
                    value += [0] * more
                if check[at] < 0 and all(check[at + d] < 0 for d in rest):
                    break
                at += 1
            base[state] = at - first
            if kind < 8:
                tried[kind] = at
            for c in children:
                check[at - first + c] = state
                waiting.append((at - first + c, node[c]))
        self.base, self.check, self.value = base, check, value

    def prefixes(self, text: str, start: int = 0) -> Iterator[tuple[int, int]]:
        """(end, number) of every entry that `text` has at `start`."""
        base, check, value, codes, state, limit = self.base, self.check, self.value, self.codes, 0, len(self.check)
        for end in range(start, len(text)):
            code = codes.get(text[end])
            if code is None:
                return
            child = base[state] + code
            if child >= limit or check[child] != state or not child:
                return
            state = child
            if value[state]:
                yield end + 1, value[state] - 1


class Pieces:
    """A model's pieces; encodes and decodes."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.scores = [model.get_score(i) for i in range(n)]
        self.unknown_score = min(self.scores[i] for i in normal) - 10.0
        self.trie = DoubleArray([(model.id_to_piece(i), i) for i in normal])
        self.byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.unknown = model.unk_id()
        of_byte = {i: bytes([b]) for b, i in self.byte_ids.items()}
        self.texts = [of_byte.get(i, model.id_to_piece(i).replace(MARK, " ").encode()) for i in range(n)]
        for i in range(n):
            if model.is_control(i) or model.is_unknown(i):
                self.texts[i] = b""
        words = [model.id_to_piece(i) for i in normal]
        if any(MARK in w.lstrip(MARK) or "\n" in w for w in words):
            raise ValueError("a piece has a marker or a line feed inside: words can't be segmented one by one")
        self.kept = Kept(_MOST_BYTES)

    def segment(self, word: str) -> list[int]:
        """Ids of the best segmentation."""
        n = len(word)
        best, from_, by = [float("-inf")] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        scores, base, check, value = self.scores, self.trie.base, self.trie.check, self.trie.value
        codes, limit = list(map(self.trie.codes.get, word)), len(check)
        for start in range(n):
            here, state, single = best[start], 0, False
            for end in range(start, n):
                code = codes[end]
                if code is None:
                    break
                child = base[state] + code
                if child >= limit or check[child] != state:
                    break
                state = child
                if number := value[state]:
                    single |= end == start
                    score = here + scores[number - 1]
                    if score > best[end + 1]:
                        best[end + 1], from_[end + 1], by[end + 1] = score, start, number - 1
            if not single and (score := here + self.unknown_score) > best[start + 1]:
                best[start + 1], from_[start + 1], by[start + 1] = score, start, -1
        out: list[int] = []
        end = n
        while end:
            start, piece = from_[end], by[end]
            if piece >= 0:
                out.append(piece)
            else:
                out.extend(self.byte_ids.get(b, self.unknown) for b in reversed(word[start:end].encode("utf-8", "surrogatepass")))
            end = start
        return out[::-1]

    def _of_words(self, words: list[str]) -> list[bytes]:
        out = list(map(self.kept.get, words))
        if missing := [i for i, x in enumerate(out) if x is None]:
            new = list(dict.fromkeys(words[i] for i in missing))
            segments = map(self.segment, new)
            found = dict(zip(new, [struct.pack(f"<{len(ids)}I", *ids) for ids in segments]))
            self.kept.add(new, list(found.values()))
            for i in missing:
                out[i] = found[words[i]]
        return out

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian 32-bit bytes."""
        return b"".join(self._of_words(_WORDS.findall(MARK + text.replace(" ", MARK)))) if text else b""

    def encode_all(self, texts) -> list[bytes]:
        """As `encode`, for an Arrow string array: each distinct word of the batch once."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts, "")
        odd = pc.or_(pc.match_substring_regex(texts, _ODD), pc.equal(texts, "")).to_numpy(zero_copy_only=False)
        plain = texts.filter(pa.array(~odd))
        ids = iter(())
        if len(plain):
            cut = pc.replace_substring(pc.replace_substring(plain, " ", " " + MARK), "\n", " \n ")
            lists = pc.split_pattern(pc.binary_join_element_wise(MARK, cut, ""), " ")
            coded = lists.flatten().dictionary_encode()
            of = self._of_words(coded.dictionary.to_pylist())
            which, sizes = coded.indices.to_pylist(), pc.list_value_length(lists).to_pylist()
            ends = np.cumsum([0, *sizes]).tolist()
            ids = iter([b"".join(map(of.__getitem__, which[a:b])) for a, b in zip(ends, ends[1:])])
        strange = iter([self.encode(t) for t in texts.filter(pa.array(odd)).to_pylist()])
        return [next(strange if x else ids) for x in odd.tolist()]

    def decode(self, ids: bytes) -> str:
        import numpy as np

        raw = b"".join(map(self.texts.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        text = raw.decode("utf-8", "surrogatepass" if b"\xed" in raw else "strict")
        return text.removeprefix(" ")


def pieces(model_file: str) -> Pieces:
    """This worker's pieces of the file; kept between tasks."""
    return resident(("pieces", model_file), lambda: Pieces(model_file))


_COLUMNS = ["n_tokens", "n_byte_tokens", "ids_crc32", "decoded_sha256", "round_trip"]


def _encode(model_file: str, with_ids: bool):
    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        model = pieces(model_file)
        is_byte = np.zeros(len(model.texts), bool)
        is_byte[list(model.byte_ids.values())] = True
        for batch in slices(batches, 2048, 4_000_000):
            rows, texts, encoded = [], batch.column("text").to_pylist(), model.encode_all(batch.column("text"))
            for text, ids in zip(texts, encoded):
                decoded = model.decode(ids)
                rows.append((len(ids) // 4, int(is_byte[np.frombuffer(ids, "<u4")].sum()), zlib.crc32(ids), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest(), decoded == (text or "")))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            columns = [pa.array(x, k) for x, k in zip(zip(*rows), kinds)]
            if with_ids:
                columns.append(pa.array([np.frombuffer(x, "<i4") for x in encoded], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *_COLUMNS, *["ids"] * with_ids])

    return run


def encode_documents(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """A row for each row of `docs`: doc_id, n_tokens, n_byte_tokens, ids_crc32, decoded_sha256, round_trip, and ids if wanted.

    Whole texts are encoded where they are read and decoded again. A null or empty text has no ids. round_trip is false only
    for texts that hold the marker itself, which decodes as a space. Repeated rows and null ids are rows like any other;
    other columns are left out, so their names can't clash.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id bigint, n_tokens bigint, n_byte_tokens bigint, ids_crc32 bigint, decoded_sha256 string, round_trip boolean"
    return own.mapInArrow(_encode(model_file, with_ids), schema + ", ids array<int>" * with_ids)


def _decode(model_file: str):
    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        model = pieces(model_file)
        for batch in batches:
            texts = [None if x is None else model.decode(np.asarray(x, "<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decode_documents(encoded: DataFrame, model_file: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids give a null text, no ids an empty one."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(model_file), "doc_id bigint, text string")
