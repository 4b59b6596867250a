"""Exact dedup by skew-safe combining.

Texts are equal when they are identical without the characters `[\\x20\\x09-\\x0D]`. Copies are first combined within a
task, then per (digest, salt), then per digest; at each stage the whole normalised content is part of the key, carried
zstd-compressed (compression is injective, and equal contents compress alike at one level and version). Whatever share of
the rows one group holds, a stage gets a row of it from each task at most, or from each salt. Rows then find their group by
the sha256 and a second 128-bit digest of their content. Every row's content took part in the stages before, so that is
exact as long as no two contents have both digests in common, which is verified: two that had would fail the job.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriloom.llm.common import ASCII_SPACE, place_of, positional, slices

#: A winner as one number that a hash aggregate can take the maximum of: code points first, then the smaller id; a null id
#: is behind all others. 2 ** 65 leaves room for 2 ** 63 - id of any long.
_STEP = 2**65
_LOCAL_BYTES = 24_000_000
_CONTENT = "digest binary, check binary, salt int, content binary, n bigint, best decimal(38,0)"


def normalised(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(None, ASCII_SPACE)


def _local_winners(salts: int):
    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa
        import xxhash
        import zstandard

        from pyspark import TaskContext

        salt = TaskContext.get().partitionId() % salts
        pack = zstandard.ZstdCompressor(level=1).compress
        names = ["digest", "check", "salt", "content", "n", "best"]
        kinds = [pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.decimal128(38, 0)]

        def flush(groups: dict[bytes, list[list]]):
            rows = [(digest, xxhash.xxh3_128_digest(g[0]), salt, pack(g[0]), g[1], Decimal(g[2])) for digest, same in groups.items() for g in same]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

        groups: dict[bytes, list[list]] = {}
        held = 0
        for batch in slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                content = normalised(text)
                best = _best(doc_id, text)
                same = groups.setdefault(hashlib.sha256(content).digest(), [])
                for g in same:
                    if g[0] == content:
                        g[1] += 1
                        g[2] = max(g[2], best)
                        break
                else:
                    same.append([content, 1, best])
                    held += len(content) + 200
            if held > _LOCAL_BYTES:
                yield flush(groups)
                groups, held = {}, 0
        if groups:
            yield flush(groups)

    return run


def _best(doc_id: int | None, text: str | None) -> int:
    return len(text or "") * _STEP + (0 if doc_id is None else 2**63 - doc_id)


def _digests(id_col: str, text_col: str, *names: str):
    """Rows with the digests of their content, and how they rank in their group, under three `names`."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa
        import xxhash

        for batch in slices(batches, text=text_col):
            texts = batch.column(text_col).to_pylist()
            contents = [normalised(t) for t in texts]
            made = [
                pa.array([hashlib.sha256(c).digest() for c in contents], pa.binary()),
                pa.array([xxhash.xxh3_128_digest(c) for c in contents], pa.binary()),
                pa.array([Decimal(_best(d, t)) for d, t in zip(batch.column(id_col).to_pylist(), texts)], pa.decimal128(38, 0)),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *names])

    return run


def group_winners(docs: DataFrame, salts: int = 16) -> DataFrame:
    """One row for each group of equal texts: digest, check, group_size, keep_id, best. `docs` has doc_id and text."""
    local = docs.select("doc_id", "text").mapInArrow(_local_winners(salts), _CONTENT)
    salted = local.groupBy("digest", "check", "salt", "content").agg(F.sum("n").alias("n"), F.max("best").alias("best"))
    # by digests alone, so that the next two aggregates need one exchange; it gets a row of a group from each salt
    whole = salted.repartition("digest", "check").groupBy("digest", "check", "content").agg(F.sum("n").alias("n"), F.max("best").alias("best"))
    one = whole.groupBy("digest", "check").agg(F.count("*").alias("contents"), F.max("n").alias("group_size"), F.max("best").alias("best"))
    size = F.when(F.col("contents") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two contents have the same digests")).cast("bigint"))
    # the id is within 2 ** 63 of 2 ** 63: decimals hold it, longs might not
    from_top = F.col("best") % F.lit(Decimal(_STEP)).cast("decimal(20,0)")
    keep = F.when(from_top != 0, (F.lit(Decimal(2**63)).cast("decimal(20,0)") - from_top).cast("long"))
    return one.select("digest", "check", size.alias("group_size"), keep.alias("keep_id"), "best")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """A row for each row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts, the row with the most code points in its original text stays, then the one with the smallest id.
    A null text counts as empty; all empty and blank texts are one group. Null ids are kept as they are and lose every
    tie; a group of null ids only has a null keep_id, and those rows count as kept. Rows that repeat an id and a text are
    rows of their own: each counts in group_size and, where that id stays, each is marked kept. Other columns of `docs` are
    left out, so their names can't clash; an empty table gives an empty result.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    each = own.mapInArrow(_digests("doc_id", "text", "digest", "check", "best"), "doc_id bigint, text string, digest binary, check binary, best decimal(38,0)").select("doc_id", "digest", "check")
    # a join key of its own gives both sides an exchange of their own, whose large partitions Spark may split
    place = F.xxhash64("digest").alias("place")
    return each.select("*", place).join(group_winners(own, salts).select("*", place), ["digest", "check", "place"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """`docs` with one row of each group of equal texts, all columns as they were, whatever their names.

    The row that stays is the one with the most code points in its original text, then the one with the smallest id; a null
    id loses every tie. Rows that agree in both (they repeat an id, or have none) are told apart by the digest of their text
    and then by a hash of their other columns but maps; beyond that they are alike and one stays. Null, empty and blank texts
    are one group, of which one row stays; texts of any length are compared whole; an empty table stays empty.
    """
    rows, doc, text = positional(docs), place_of(docs, id_col), place_of(docs, text_col)
    place = F.xxhash64("digest").alias("place")
    read = rows.withColumns({"id": F.col(doc).cast("long"), "content": F.col(text)})
    keep = group_winners(read.select(F.col("id").alias("doc_id"), F.col("content").alias("text")), salts).select("digest", "check", "best", place)
    made = [T.StructField("digest", T.BinaryType()), T.StructField("check", T.BinaryType()), T.StructField("best", T.DecimalType(38, 0))]
    marked = read.mapInArrow(_digests("id", "content", "digest", "check", "best"), T.StructType([*read.schema.fields, *made])).drop("id", "content")
    stay = marked.select("*", place).join(keep, ["digest", "check", "best", "place"], "left_semi")
    hashable = [f.name for f in rows.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    order = F.struct(F.sha2(F.coalesce(text, F.lit("")), 256), F.xxhash64(*hashable))
    first = stay.groupBy("digest", "check").agg(F.min_by(F.struct(*rows.columns), order).alias("row"))
    return first.select("row.*").toDF(*docs.columns)
