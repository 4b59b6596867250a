"""Scratch tables in the folder that a cluster's executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_own_shared: list[str] = []
#: Scratch paths of this driver that nothing has deleted yet.
_scratch: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only a session on this machine alone may name none, as in tests; it gets a temporary folder. Anywhere else that is an
    error: executors could not see such a folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir names no shared folder for the executors of {master}")
    if not _own_shared:
        _own_shared.append("file://" + tempfile.mkdtemp(prefix="veriloom-"))
    return _own_shared[0]


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder; `discard` deletes it, or the end of this driver."""
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    _scratch.add(path)
    return path


def _delete(path: str) -> None:
    context = SparkContext._active_spark_context
    jvm = SparkContext._jvm
    if jvm is None:
        return
    place = jvm.org.apache.hadoop.fs.Path(path)
    conf = context._jsc.hadoopConfiguration() if context is not None else jvm.org.apache.hadoop.conf.Configuration()
    place.getFileSystem(conf).delete(place, True)


def discard(*tables: DataFrame | str) -> None:
    """Delete tables of `through_table`, or scratch paths, that nothing will read any more."""
    for x in tables:
        path = x if isinstance(x, str) else getattr(x, "scratch_path", None)
        if path in _scratch:
            _scratch.discard(path)
            _delete(path)


@atexit.register
def _discard_all() -> None:
    for path in list(_scratch):
        try:
            discard(path)
        except Exception:  # the gateway may be gone by now; what stays is the folder's owner's to sweep
            return


def through_table(df: DataFrame, what: str) -> DataFrame:
    """`df` written to the shared folder and read back: a cut of the lineage that outlives executors."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.scratch_path = path
    return back
