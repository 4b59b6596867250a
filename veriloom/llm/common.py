"""What the operators of this subpackage share: tables, the shared scratch folder, batches."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

from veriloom.sources.scratch import discard, scratch, shared_folder, through_table

__all__ = ["ASCII_SPACE", "LOWER", "UPPER", "Kept", "discard", "open_folder", "place_of", "positional", "publish", "resident", "scratch", "shared_folder", "slices", "table", "through_table"]

#: The characters `[\x20\x09-\x0D]`; str/bytes methods of Python take the same ones from ASCII text.
ASCII_SPACE = b" \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def positional(df: DataFrame) -> DataFrame:
    """`df` with its columns named c0, c1, ...: so no name clashes, and none with a dot stops Arrow functions of Spark."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def place_of(df: DataFrame, column: str) -> str:
    """What `positional` calls the first column of this name, whatever its letter case."""
    return f"c{[c.lower() for c in df.columns].index(column.lower())}"


def open_folder(uri: str):
    """(filesystem, path) of a folder for pyarrow, from a task or from the driver."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system, path


def publish(system, path: str, write) -> None:
    """Write a file under a name of its own, then rename: attempts of a task never see each other's half files."""
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(own) as out:
        write(out)
    system.move(own, path)


_resident: dict[object, object] = {}


def resident(name, make=dict):
    """What a worker keeps between tasks under a name. A worker keeps one operator's at a time: the last one's memory goes
    when another operator comes."""
    if name not in _resident:
        if _resident:
            _resident.clear()
            _give_back()
        _resident[name] = make()
    return _resident[name]


def _give_back() -> None:
    """Return freed memory to the system, where the C library can: workers live on, and the next operator needs the room."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU library
        pass


class Kept(dict):
    """Values by text, kept for a worker's next texts. Bounded by bytes: when full, all go and are gathered anew."""

    def __init__(self, most_bytes: int):
        super().__init__()
        self.most, self.held = most_bytes, 0

    def add(self, keys: list, values: list) -> None:
        """Keep these from now on; a caller has the values at hand, whether they are kept or not."""
        more = sum(map(sys.getsizeof, keys)) + sum(map(sys.getsizeof, values)) + 100 * len(keys)
        if self.held + more > self.most:
            self.clear()
            self.held = 0
            if more > self.most:
                return
        self.update(zip(keys, values))
        self.held += more


def slices(batches: Iterable, most_rows: int = 512, most_chars: int = 8_000_000, text: str = "text") -> Iterator:
    """Record batches cut so that each holds few rows and few bytes of `text` (one row at least)."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and (held + n > most_chars or i - start >= most_rows):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)
