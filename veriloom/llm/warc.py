"""WARC archives: a writer with revisit records, and a splittable reader.

Every record is a gzip member of its own. The reader lists archives, cuts each into byte ranges and gives every range to a
task. A task looks for gzip magic in its range, validates each candidate by decompressing its start and parsing the WARC
header in it, and owns the records whose members start inside its range; it reads on past the range's end to finish the
last one. Any split of a file therefore yields each record once. Members that hold several records, or records without
compression, are not read. A task goes on
behind each record that it read. Where a payload holds whole members of another archive in stored form, a range that starts
inside that payload takes those for records; pages of text in UTF-8 can't, as `1f 8b` is no UTF-8.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.llm.common import open_folder, publish, slices, through_table

MAGIC = b"\x1f\x8b\x08"
_VERSION = b"WARC/1.1\r\n"
#: A payload of at least so many bytes that equals another's is written as a revisit.
LEAST_BYTES = 0
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id bigint, target_uri string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, file string, at bigint"


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None, key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{key}')}>"


def _clean(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, level: int = 6) -> bytes:
    """A record as one gzip member; a revisit holds the HTTP headers of the payload but not the payload."""
    digest = payload_digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _record_id(page_id, digest)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", _clean(url or "")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Page-ID", "" if page_id is None else str(page_id)),
    ]
    if refers_to is not None:
        headers += [("WARC-Profile", _REVISIT), ("WARC-Refers-To", _record_id(refers_to, digest)), ("WARC-Refers-To-Page-ID", str(refers_to))]
    headers += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    raw = _VERSION + "".join(f"{k}: {v}\r\n" for k, v in headers).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


def _write(folder: str):
    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        system, root = open_folder(folder)
        name, counts = f"part-{TaskContext.get().partitionId():06d}.warc.gz", []

        def write(out):
            n = size = 0
            for batch in slices(batches, text="html"):
                for page_id, url, html, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                    size += out.write(member := record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers_to)) or len(member)
                    n += 1
            counts.append((n, size))

        publish(system, f"{root}/{name}", write)
        yield pa.RecordBatch.from_pydict({"file": [name], "n": pa.array([counts[0][0]], pa.int64()), "size": pa.array([counts[0][1]], pa.int64())})

    return run


def write_archives(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write a record for every row of `pages` (page_id, url, html) and return the archives: file, n records, size.

    The payload is html in UTF-8, a null is empty. Of records with equal payloads of at least `least_bytes`, the row with the
    largest page_id is the response and the others revisit it; smaller payloads are responses all. Which page stays is found
    by a combining aggregate on digest and length, and pages join its result by a key of their own, whose large partitions
    Spark may split, so a third of the pages may share a payload. Rows that repeat the
    response's id are responses too. A null page_id is written and, unless all of its group are null, is a revisit.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(payload).alias("key"), F.octet_length(payload).alias("size"))
    newest = keyed.where(F.col("size") >= least_bytes).groupBy("key", "size").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # a join key of its own gives both sides an exchange of their own, whose large partitions Spark may split
    place = F.xxhash64("key", "size").alias("place")
    linked = keyed.select("*", place).join(newest.select("*", place), ["key", "size", "place"], "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    system, root = open_folder(folder)
    system.create_dir(root, recursive=True)
    written = linked.select("page_id", "url", "html", refers.alias("refers_to")).mapInArrow(_write(folder), "file string, n bigint, size bigint")
    return pages.sparkSession.createDataFrame(written.collect(), "file string, n bigint, size bigint")  # a row per file


class _Window:
    """Bytes of a file from a moving start, read in steps."""

    def __init__(self, file, at: int, step: int):
        self.file, self.at, self.step, self.held, self.size = file, at, step, bytearray(), file.size()

    def reach(self, n: int) -> bool:
        """Hold at least n bytes from `at` on, if the file has them."""
        while len(self.held) < n and self.at + len(self.held) < self.size:
            self.held += self.file.read_at(min(self.step, self.size - self.at - len(self.held)), self.at + len(self.held))
        return len(self.held) >= n

    def skip(self, n: int) -> None:
        del self.held[:n]
        self.at += n


def _headers(raw: bytes) -> tuple[dict[str, str], int] | None:
    """Header fields by lower-case name and where the block starts; None if it is no WARC header."""
    end = raw.find(b"\r\n\r\n")
    if end < 0 or not raw.startswith(b"WARC/"):
        return None
    fields = (line.partition(b":") for line in raw[:end].split(b"\r\n")[1:])
    found = {k.decode("ascii", "replace").strip().lower(): v.decode("utf-8", "surrogatepass").strip() for k, _, v in fields}
    return (found, end + 4) if found.get("content-length", "").isdigit() and "warc-type" in found else None


def _member(window: _Window) -> tuple[dict[str, str], bytes, int] | None:
    """The record whose member starts where the window does: headers, block, size of the member; None if there is none."""
    unpack, out, used = zlib.decompressobj(31), bytearray(), 0
    parsed, sought = None, 0
    while not unpack.eof:
        if not window.reach(used + 1):
            return None
        part = bytes(window.held[used : used + window.step])
        try:
            out += unpack.decompress(part)
        except zlib.error:
            return None
        used += len(part)
        if parsed is None:
            if not b"WARC/".startswith(out[:5]):
                return None
            # a header has any length; what was sought in is not sought in again
            if (end := out.find(b"\r\n\r\n", sought)) >= 0:
                parsed = _headers(bytes(out[: end + 4]))
                if parsed is None:
                    return None
            sought = max(0, len(out) - 3)
    used -= len(unpack.unused_data)
    if parsed is None:
        return None
    fields, start = parsed
    block = bytes(memoryview(out)[start : start + int(fields["content-length"])])
    return (fields, block, used) if len(block) == int(fields["content-length"]) else None


def records_in(file, start: int, end: int, step: int = 262_144) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of the records whose members start in [start, end)."""
    window = _Window(file, start, step)
    while window.at < end:
        window.reach(len(MAGIC))
        found = window.held.find(MAGIC)
        if found < 0:
            keep = min(len(MAGIC) - 1, len(window.held))
            window.skip(len(window.held) - keep)
            if not window.reach(keep + 1):
                return
            continue
        window.skip(found)
        if window.at >= end:
            return
        if (got := _member(window)) is None:
            window.skip(1)
            continue
        fields, block, used = got
        yield window.at, fields, block
        window.skip(used)


def _read(folder: str):
    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        system, root = open_folder(folder)
        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        number = lambda x: int(x) if x else None
        for batch in batches:
            for name, start, end in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "end"))):
                rows = []
                with system.open_input_file(f"{root}/{name}") as file:
                    for at, fields, block in records_in(file, start, end):
                        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                        head, _, payload = block.partition(b"\r\n\r\n")
                        size = len(payload)
                        if fields["warc-type"] == "response":
                            if payload_digest(payload) != digest:
                                raise ValueError(f"{name} at {at}: the payload isn't what its digest says")
                        else:
                            size = next(int(v) for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")) if k.lower() == b"content-length")
                        rows.append((number(fields.get("warc-page-id")), fields.get("warc-target-uri"), size, digest, fields["warc-type"], number(fields.get("warc-refers-to-page-id")), name, at))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

    return run


def read_archives(spark: SparkSession, folder: str, split_bytes: int = 4 << 20) -> DataFrame:
    """A row for each record of the `.warc.gz` files of a folder: page_id, target_uri, payload_bytes, payload_digest,
    record_type, refers_to, file, at. A payload that does not match its digest fails the task; no files, no rows."""
    from pyarrow import fs

    system, root = open_folder(folder)
    files = [(x.base_name, x.size) for x in system.get_file_info(fs.FileSelector(root)) if x.base_name.endswith(".warc.gz")]
    ranges = spark.createDataFrame(files, "file string, size bigint").select(
        "file", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split_bytes).cast("bigint"))).alias("start"))
    n = sum(-(-size // split_bytes) for _, size in files)
    dealt = ranges.withColumn("end", F.col("start") + split_bytes).repartition(max(1, n))
    return dealt.mapInArrow(_read(folder), RECORD)


def all_records(records: DataFrame, written: DataFrame) -> DataFrame:
    """`records`, of `read_archives`, if every archive gave as many of them as `write_archives` says that it holds.

    The records are read once, through a table in the shared folder. A count that differs is an error.
    """
    records = through_table(records, "warc-records")
    want = {r["file"]: r["n"] for r in written.where("n > 0").collect()}  # a row per file
    got = {r["file"]: r["n"] for r in records.groupBy("file").agg(F.count("*").alias("n")).collect()}
    if wrong := sorted(f for f in want.keys() | got.keys() if want.get(f) != got.get(f)):
        raise ValueError(f"{len(wrong)} archives gave other counts of records than were written, {wrong[0]}: {got.get(wrong[0], 0)} of {want.get(wrong[0], 0)}")
    return records
