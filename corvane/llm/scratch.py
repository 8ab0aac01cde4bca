"""Shared-folder tables that cut lineage.

Every intermediate that must survive a lost executor is a Parquet table below
``spark.checkpoint.dir``, which driver and executors share. Only a local session
without that setting (tests) gets a folder of its own.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_noted = threading.local()


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own[app] = "file://" + tempfile.mkdtemp(prefix="corvane-")
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    for held in getattr(_noted, "open", []):
        held.append(path)
    return path


@contextmanager
def noted() -> Iterator[list[str]]:
    """The paths that this thread makes inside the block."""
    held: list[str] = []
    _noted.open = [*getattr(_noted, "open", []), held]
    try:
        yield held
    finally:
        _noted.open = [x for x in _noted.open if x is not held]


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._corvane_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete the files of tables made by :func:`store` once nothing reads them."""
    for df in frames:
        path = getattr(df, "_corvane_path", None)
        if path:
            remove(df.sparkSession, path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete tables by path; what is gone already is passed over."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def free_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of plans that nothing refers to any more; it does so when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def give_back() -> None:
    """Return free memory of a Python worker, which later stages use again, to the system; where the C library cannot, Arrow's alone."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
