"""Helpers that the corpus operators share: durable intermediate tables and Arrow column access."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: White space that separates words everywhere in this package: space and U+0009 to U+000D.
SPACE = "\x20\x09-\x0d"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LEAN: list[Callable[[int], int] | None] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where it is unset, a temporary one stands in if all run in this one process; on a cluster that is an error.
    """
    got = spark.conf.get("spark.checkpoint.dir", None)
    if got:
        return got.rstrip("/")
    own = getattr(spark, "_frameflow_dir", None)
    if own is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="frameflow-")
        spark._frameflow_dir = own
    return own


def _file_system(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


class Scratch:
    """Paths that are to be deleted."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def keep(self, *tables: DataFrame) -> None:
        for df in tables:
            self.paths.remove(df._frameflow_path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Deletes at its end the tables that were stored inside and not kept, those that results made inside still read
    included. Results of the operators are to be written or read before it ends."""
    own = Scratch()
    open_ones = spark.__dict__.setdefault("_frameflow_scratches", [])
    open_ones.append(own)
    try:
        yield own
    finally:
        open_ones.remove(own)
        for path in own.paths:
            fs, jpath = _file_system(spark, path)
            fs.delete(jpath, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the session's JVM ends, if not before."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, jpath = _file_system(spark, path)
    fs.deleteOnExit(jpath)
    for own in getattr(spark, "_frameflow_scratches", []):
        own.paths.append(path)
    return path


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that are run inside leave no shuffle files behind once they have ended."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: cuts lineage and survives lost executors.

    The shuffle files of the write go with its end; the table stays until discard() or the session's end.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with shuffles_removed(spark):
        df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._frameflow_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of stored() that nothing reads any more."""
    for df in tables:
        fs, jpath = _file_system(df.sparkSession, df._frameflow_path)
        fs.delete(jpath, True)


def lean() -> None:
    """Lets a Python worker give memory back: large blocks return to the system when they are freed."""
    if _LEAN:
        return
    _LEAN.append(None)
    pa.set_memory_pool(pa.system_memory_pool())
    if sys.platform == "linux":
        try:
            libc = ctypes.CDLL(None)
            libc.mallopt(-3, 16 << 20)  # M_MMAP_THRESHOLD, which otherwise grows with what is freed
            libc.mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD
            _LEAN[0] = libc.malloc_trim
        except (OSError, AttributeError):
            pass


def trim() -> None:
    """Returns to the system what a task has freed: workers are used again, by stages that need other memory."""
    if _LEAN and _LEAN[0]:
        _LEAN[0](0)


def limit_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Sets the session's Arrow batches to `most` bytes, if they may be larger: rows here hold texts of any length."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if now <= 0 or now > most:
        spark.conf.set(key, str(most))


def mapped(df: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """df.mapInArrow(step, schema) in batches of bounded size and workers that give memory back."""
    limit_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        yield from step(batches)
        trim()

    return df.mapInArrow(run, schema)
