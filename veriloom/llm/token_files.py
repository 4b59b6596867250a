"""Token-id files by bit-plane shuffling.

A shard is `VTOK` + version, then blocks of a fixed number of ids, then the documents of the shard, then a chunk index and a
fixed-size footer that points to both. A block of n ids is transposed into byte planes (all lowest bytes, then the next
ones) or bit planes (bit k of every id), and each plane is compressed with zstandard by itself; planes that are all zero
take a few bytes. The index has, per block, its place, its number of ids and the size of each plane, so that any block can
be read alone. A folder of shards with `index.json` (written last) is a data set in ascending id order.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.llm.common import open_folder, publish, slices
from veriloom.llm.tokens import word_tokens

MAGIC = b"VTOK0001"
_FOOTER = struct.Struct("<QQQQ8s")
PLANES = {"byte": 4, "bit": 32}
_MANIFEST = "shard int, file string, n_docs bigint, n_ids bigint"


def to_planes(ids: bytes, mode: str) -> list[bytes]:
    """The planes of a block of little-endian 32-bit ids."""
    import numpy as np

    raw = np.frombuffer(ids, np.uint8).reshape(-1, 4)
    if mode == "byte":
        return [raw[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, mode: str) -> bytes:
    import numpy as np

    if mode == "byte":
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).tobytes()
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").tobytes()


class ShardWriter:
    """Writes one shard to a stream, a block at a time."""

    def __init__(self, out, block_ids: int = 65_536, mode: str = "byte", level: int = 3):
        import zstandard

        self.out, self.size, self.mode, self.block_ids = out, len(MAGIC), mode, block_ids
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.open, self.held = [], 0
        self.blocks: list[tuple] = []
        self.docs: list[tuple[int | None, int]] = []
        self.n_ids = 0
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id, len(ids) // 4))
        self.open.append(ids)
        self.held += len(ids)
        if self.held >= 4 * self.block_ids:
            joined, step = b"".join(self.open), 4 * self.block_ids
            for at in range(0, len(joined) - step + 1, step):
                self._block(joined[at : at + step])
            rest = joined[len(joined) // step * step :]
            self.open, self.held = [rest], len(rest)

    def _put(self, data: bytes) -> int:
        self.out.write(data)
        self.size += len(data)
        return len(data)

    def _block(self, ids: bytes) -> None:
        at = self.size
        sizes = [self._put(self.pack(p)) for p in to_planes(ids, self.mode)]
        self.blocks.append((at, len(ids) // 4, zlib.crc32(ids), *sizes))
        self.n_ids += len(ids) // 4

    def close(self) -> None:
        import numpy as np

        if self.held:
            self._block(b"".join(self.open))
        known = np.array([d is not None for d, _ in self.docs], np.uint8)
        ids = np.array([d or 0 for d, _ in self.docs], "<i8")
        lengths = np.array([n for _, n in self.docs], "<u8")
        docs_at = self.size
        docs_len = self._put(self.pack(known.tobytes() + ids.tobytes() + lengths.tobytes()))
        index = json.dumps({"mode": self.mode, "block_ids": self.block_ids, "n_docs": len(self.docs), "blocks": self.blocks}).encode()
        index_at = self.size
        self._put(index)
        self._put(_FOOTER.pack(docs_at, docs_len, index_at, len(index), MAGIC))


class ShardReader:
    """Reads a shard from a random-access file of pyarrow, a block at a time."""

    def __init__(self, file):
        import numpy as np
        import zstandard

        self.file, size = file, file.size()
        self.unpack = zstandard.ZstdDecompressor().decompress
        docs_at, docs_len, index_at, index_len, magic = _FOOTER.unpack(file.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != MAGIC or file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError("not a token-id shard")
        index = json.loads(file.read_at(index_len, index_at))
        self.mode, self.blocks, n = index["mode"], index["blocks"], index["n_docs"]
        raw = self.unpack(file.read_at(docs_len, docs_at))
        known, ids, lengths = np.frombuffer(raw, np.uint8, n), np.frombuffer(raw, "<i8", n, n), np.frombuffer(raw, "<u8", n, 9 * n)
        self.docs = [(d if k else None, m) for k, d, m in zip(known.tolist(), ids.tolist(), lengths.tolist())]

    def block(self, k: int) -> bytes:
        at, n, crc, *sizes = self.blocks[k]
        raw, planes, start = self.file.read_at(sum(sizes), at), [], 0
        for size in sizes:
            planes.append(self.unpack(raw[start : start + size]))
            start += size
        ids = from_planes(planes, n, self.mode)
        if zlib.crc32(ids) != crc:
            raise ValueError(f"block {k} is damaged")
        return ids

    def documents(self) -> Iterator[tuple[int | None, int, Iterator[bytes]]]:
        """(doc_id, number of ids, the ids in pieces); pieces must be taken before the next document."""
        k, held = 0, b""

        def pieces(left: int) -> Iterator[bytes]:
            nonlocal k, held
            while left:
                if not held:
                    held, k = self.block(k), k + 1
                piece, held = held[:left], held[left:]
                left -= len(piece)
                yield piece

        for doc_id, n in self.docs:
            yield doc_id, n, pieces(4 * n)


def _write_shards(folder: str, tokenizer: str, kind: str, end_id: int, block_ids: int, mode: str):
    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        system, root = open_folder(folder)
        shard, name = TaskContext.get().partitionId(), None
        end = struct.pack("<I", end_id)
        tokens = word_tokens(tokenizer, kind)
        writers: list[ShardWriter] = []

        def write(out):
            writer = ShardWriter(out, block_ids, mode)
            for batch in slices(batches, 4096, 6_000_000):
                ids = tokens.encode(batch.column("text"))
                for doc_id, x in zip(batch.column("doc_id").to_pylist(), ids):
                    writer.add(doc_id, x + end)
            writer.close()
            writers.append(writer)

        name = f"shard-{shard:06d}.vtok"
        publish(system, f"{root}/{name}", write)
        if writers[0].docs:
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "file": [name], "n_docs": [len(writers[0].docs)], "n_ids": [writers[0].n_ids]})

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, kind: str, end_id: int, block_ids: int = 65_536, mode: str = "byte") -> None:
    """Encode every whole text of `docs` (doc_id, text), append `end_id` and write the ids in ascending doc_id order.

    Rows are dealt by ranges of (doc_id, hash of the text, position), so that not even one id's rows must meet in a task, and
    the order is the same when a lost task runs again. Null ids come first; a null or empty text has `end_id` alone. The
    driver gets one row per shard.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumns({"_h": F.xxhash64("text"), "_k": F.monotonically_increasing_id()})
    dealt = own.repartitionByRange("doc_id", "_h", "_k").sortWithinPartitions("doc_id", "_h", "_k").select("doc_id", "text")
    system, root = open_folder(folder)
    system.create_dir(root, recursive=True)
    found = sorted(dealt.mapInArrow(_write_shards(folder, tokenizer, kind, end_id, block_ids, mode), _MANIFEST).collect())
    shards, start = [], 0
    for x in found:
        shards.append({"file": x["file"], "start": start, "n_docs": x["n_docs"], "n_ids": x["n_ids"]})
        start += x["n_ids"]
    publish(system, f"{root}/index.json", lambda out: out.write(json.dumps({"end_id": end_id, "n_ids": start, "shards": shards}).encode()))


def _read_shards(folder: str, with_ids: bool):
    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        system, root = open_folder(folder)
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]

        def batch_of(rows: list[tuple], ids: list) -> pa.RecordBatch:
            columns = [pa.array(x, pa.int64()) for x in zip(*rows)]
            return pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []), names + ["ids"] * with_ids)

        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                with system.open_input_file(f"{root}/{name}") as file:
                    rows, ids, held = [], [], 0
                    for doc_id, n, pieces in ShardReader(file).documents():
                        crc, kept = 0, []
                        for piece in pieces:
                            crc = zlib.crc32(piece, crc)
                            if with_ids:
                                kept.append(piece)
                        rows.append((doc_id, start, n, crc))
                        if with_ids:
                            ids.append(np.frombuffer(b"".join(kept), "<i4"))
                        start += n
                        held += n * with_ids + 1
                        if held > 500_000 or len(rows) >= 20_000:
                            yield batch_of(rows, ids)
                            rows, ids, held = [], [], 0
                    if rows:
                        yield batch_of(rows, ids)

    return run


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """A row for each document of a folder of shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and ids if wanted.

    An empty data set gives an empty result. A damaged block fails its task.
    """
    system, root = open_folder(folder)
    with system.open_input_file(f"{root}/index.json") as file:
        shards = json.loads(file.read())["shards"]
    files = spark.createDataFrame([(x["file"], x["start"]) for x in shards], "file string, start bigint")
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return files.repartition(max(1, len(shards))).mapInArrow(_read_shards(folder, with_ids), schema)
