"""Cost-balanced packing of token ids into training sequences.

A piece of n tokens costs `linear * n + quadratic * n * n` (attention sees one document only). Within a window of documents,
pieces in descending length go each to the cheapest sequence that has room for it; what fits nowhere is cut to fill what is
left. A window opens as many sequences as its tokens fill, so all of them end up full, and fewer than one sequence's tokens
pass on to the next window. What the last window leaves is cut into sequences of powers of two, which need no padding.

Each task packs the partition that it reads, as it reads it: no shuffle, memory bounded by the window and the longest text,
and a task that runs again makes the same sequences.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.llm.common import slices
from veriloom.llm.tokens import word_tokens

SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


class Piece(NamedTuple):
    doc_id: int | None
    start: int
    ids: bytes
    doc_tokens: int

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return self._replace(ids=self.ids[: 4 * n]), self._replace(start=self.start + n, ids=self.ids[4 * n :])


class Packer:
    """Packs windows of pieces; `placed` gets (piece, sequence, offset) triples."""

    def __init__(self, capacity: int, linear: float, quadratic: float, first_sequence: int):
        self.capacity, self.linear, self.quadratic, self.next = capacity, linear, quadratic, first_sequence
        self.rest: list[Piece] = []
        self.placed: list[tuple[Piece, int, int]] = []

    def cost(self, n: int) -> float:
        return self.linear * n + self.quadratic * n * n

    def window(self, pieces: list[Piece]) -> None:
        short = self.rest
        for piece in pieces:
            while len(piece.ids) >= 4 * self.capacity:
                head, piece = piece.cut(self.capacity)
                self.placed.append((head, self.next, 0))
                self.next += 1
            if piece.ids:
                short.append(piece)
        short.sort(key=lambda p: -len(p.ids))
        n_open = sum(len(p.ids) for p in short) // (4 * self.capacity)
        used, first = [0] * n_open, self.next
        self.next += n_open
        cheapest = [(0.0, s) for s in range(n_open)]  # a heap; sequences without room for the piece at hand wait aside
        left: list[Piece] = []
        for piece in short:
            n, aside = len(piece.ids) // 4, []
            while cheapest and used[cheapest[0][1]] + n > self.capacity:
                aside.append(heapq.heappop(cheapest))
            if cheapest:
                spent, s = heapq.heappop(cheapest)
                self.placed.append((piece, first + s, used[s]))
                used[s] += n
                if used[s] < self.capacity:
                    heapq.heappush(cheapest, (spent + self.cost(n), s))
            else:
                left.append(piece)
            for x in aside:
                heapq.heappush(cheapest, x)
        left.reverse()
        while cheapest:
            spent, s = heapq.heappop(cheapest)
            while used[s] < self.capacity:
                piece = left.pop()
                room = self.capacity - used[s]
                if len(piece.ids) > 4 * room:
                    piece, more = piece.cut(room)
                    left.append(more)
                self.placed.append((piece, first + s, used[s]))
                used[s] += len(piece.ids) // 4
        self.rest = left

    def finish(self) -> None:
        left = self.rest[::-1]
        total = sum(len(p.ids) for p in left) // 4
        for bit in reversed(range(total.bit_length())):
            size = total & (1 << bit)
            used = 0
            while used < size:
                piece = left.pop()
                if len(piece.ids) > 4 * (size - used):
                    piece, more = piece.cut(size - used)
                    left.append(more)
                self.placed.append((piece, self.next, used))
                used += len(piece.ids) // 4
            self.next += size > 0
        self.rest = []


def _pack(tokenizer: str, kind: str, end_id: int, capacity: int, window: int, linear: float, quadratic: float, with_ids: bool):
    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        tokens, end = word_tokens(tokenizer, kind), struct.pack("<I", end_id)
        packer = Packer(capacity, linear, quadratic, TaskContext.get().partitionId() << 32)
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        def flush() -> Iterator:
            for at in range(0, len(packer.placed), 10_000):
                part = packer.placed[at : at + 10_000]
                rows = [(p.doc_id, p.start, len(p.ids) // 4, zlib.crc32(p.ids), p.doc_tokens, s, o) for p, s, o in part]
                columns = [pa.array(x, pa.int64()) for x in zip(*rows)]
                ids = [pa.array([np.frombuffer(p.ids, "<i4") for p, _, _ in part], pa.list_(pa.int32()))] if with_ids else []
                yield pa.RecordBatch.from_arrays(columns + ids, names + ["ids"] * with_ids)
            packer.placed.clear()

        waiting, held = [], 0
        for batch in slices(batches, 4096, 6_000_000):
            ids = tokens.encode(batch.column("text"))
            for doc_id, x in zip(batch.column("doc_id").to_pylist(), ids):
                waiting.append(Piece(doc_id, 0, x + end, len(x) // 4 + 1))
                held += len(x) // 4 + 1
                if held >= window:
                    packer.window(waiting)
                    waiting, held = [], 0
                    yield from flush()
        packer.window(waiting)
        packer.finish()
        yield from flush()

    return run


def pack_documents(
    docs: DataFrame, tokenizer: str, kind: str, end_id: int, capacity: int = 2048, window: int = 1_000_000,
    linear: float = 1.0, quadratic: float = 1 / 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True,
) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and its ids if wanted.

    Every id of every document lies in one piece, `end_id` closes each document; a null or empty text is `end_id` alone.
    Offsets in a sequence run from 0 without gaps. Sequences have `capacity` ids or, at a partition's end, a smaller power of
    two. Repeated rows are packed as documents of their own; null ids are kept. Equal lengths keep their order of reading;
    of equally cheap sequences the first opened takes a piece. Other columns are left out, so their names can't clash.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(_pack(tokenizer, kind, end_id, capacity, window, linear, quadratic, with_ids), SCHEMA + ", ids array<int>" * with_ids)
