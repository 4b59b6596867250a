"""Token ids of whole texts, a batch at a time."""

from __future__ import annotations

import struct
from itertools import chain

from veriloom.llm.common import Kept, resident

#: White space other than single spaces and line feeds: texts with any go to the library whole.
_ODD = "  |^ | $|^\\n|\\n$|\\n\\n| \\n|\\n |[\\t\\x0b\\x0c\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


#: Byte-level vocabularies write printable bytes as themselves and the others, in order, from U+0100 on.
_PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_CHARS = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}


class WordTokens:
    """Ids of whole texts from a file of the tokenizers library, as little-endian 32-bit bytes.

    The library encodes each distinct piece once and its ids are kept; a text is then the pieces' ids joined. Texts are
    cut only where the library's own pre-tokenizer always cuts, so the ids are those of the whole text:

    * `word`: its vocabulary drops white space, so every space or line feed is a cut.
    * `byte`: a token takes at most one leading space and none spans from a letter into a space. A text is cut before
      single spaces and around single line feeds; texts with any other white space go to the library whole.

    `most_bytes` bounds the memory of the pieces kept, however long they are; when full they are dropped and gathered anew.
    """

    def __init__(self, path: str, kind: str, most_bytes: int = 160_000_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # a text's "<|...|>" is plain text
        self.kind, self.kept = kind, Kept(most_bytes)
        #: What parts new pieces in one text for the library: a token of its own, of one id, that no piece has.
        self.mark, self.between = ("\x01", " \x01 ") if kind == "word" else ("\n", "\n")
        self.ends = dict(zip(".,", self.whole([".", ","])))
        self.mark_ids = self.library.encode(self.mark, add_special_tokens=False).ids

    def whole(self, texts: list[str]) -> list[bytes]:
        """The library's ids of each text."""
        import numpy as np

        out: list[bytes] = []
        for at in range(0, len(texts), 20_000):
            ids = [x.ids for x in self.library.encode_batch_fast(texts[at : at + 20_000], add_special_tokens=False)]
            ends = np.cumsum([0, *map(len, ids)])
            flat = np.fromiter(chain.from_iterable(ids), "<u4", ends[-1]).tobytes()
            bounds = (4 * ends).tolist()
            out += [flat[a:b] for a, b in zip(bounds, bounds[1:])]
        return out

    def _each(self, pieces: list[str]) -> list[bytes]:
        """As `whole`, for many short pieces: the library gets them as one text."""
        import numpy as np

        ids = np.asarray(self.library.encode_batch_fast([self.between.join(pieces)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(ids == self.mark_ids[0])
        if len(self.mark_ids) != 1 or len(cuts) != len(pieces) - 1 or any(self.mark in x for x in pieces):
            return self.whole(pieces)
        flat = ids.tobytes()
        return [flat[a:b] for a, b in zip([0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), len(flat)])]

    def _new(self, pieces: list[str]) -> list[bytes]:
        """As `whole`; words of letters up to U+00FF, which the library's normalizer and pre-tokenizer pass as one piece, go
        straight to its model, with a full stop or comma behind them taken for itself."""
        out: list[bytes] = [b""] * len(pieces)
        rest: list[int] = []
        model, lower = self.library.model.tokenize, self.kind == "word"
        for i, piece in enumerate(pieces):
            end = self.ends.get(piece[-1:], b"")
            word = piece[:-1] if end else piece
            spaced = word[:1] == " "
            letters = word[1:] if spaced else word
            if letters.isalpha() and max(letters) < "\u0100":
                chars = letters.lower() if lower else letters
                if not chars.isascii():
                    chars = chars.encode().decode("latin-1").translate(_BYTE_CHARS)
                ids = [t.id for t in model("\u0120" + chars if spaced else chars)]
                out[i] = struct.pack(f"<{len(ids)}I", *ids) + end
            else:
                rest.append(i)
        for at in range(0, len(rest), 256):
            part = rest[at : at + 256]
            for i, x in zip(part, self._each([pieces[i] for i in part])):
                out[i] = x
        return out

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        ids = list(map(self.kept.get, pieces))
        if missing := [i for i, x in enumerate(ids) if x is None]:
            new = [pieces[i] for i in missing]
            # in `byte` texts a piece has a leading space unless it is a line feed or comes marked with a carriage return
            plain = new if self.kind == "word" else [x[1:] if x[0] == "\r" else x if x == "\n" else " " + x for x in new]
            found = self._new(plain)
            self.kept.add(new, found)
            for i, x in zip(missing, found):
                ids[i] = x
        return ids

    def encode(self, texts) -> list[bytes]:
        """Ids of each text of an Arrow string array; null counts as empty."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts, "")
        if self.kind == "word":
            return self._joined(pc.replace_substring(texts, "\n", " "))
        odd = pc.or_(pc.match_substring_regex(texts, _ODD), pc.equal(texts, "")).to_numpy(zero_copy_only=False)
        plain = texts.filter(pa.array(~odd))
        ids = iter(self._joined(pc.binary_join_element_wise("\r", pc.replace_substring(plain, "\n", " \n \r"), "")))
        strange = iter(self.whole(texts.filter(pa.array(odd)).to_pylist()))
        return [next(strange if x else ids) for x in np.asarray(odd).tolist()]

    def _joined(self, texts) -> list[bytes]:
        import numpy as np
        import pyarrow.compute as pc

        if not len(texts):
            return []
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        ids = self._pieces(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        pool, starts = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
        which = coded.indices.to_numpy(zero_copy_only=False)
        lengths = sizes[which]
        ends = np.cumsum(lengths)
        flat = pool[np.repeat(starts[which] - ends + lengths, lengths) + np.arange(ends[-1])].tobytes()
        last = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        bounds = [0, *(4 * ends[last - 1]).tolist()]
        return [flat[a:b] for a, b in zip(bounds, bounds[1:])]


def word_tokens(path: str, kind: str) -> WordTokens:
    """This worker's tokens of the file; kept between tasks."""
    return resident(("tokens", path, kind), lambda: WordTokens(path, kind))
