"""Intermediate tables: written once to the folder that all executors share, then read as often as needed.

A stored table cuts lineage and survives lost executors, and what has to be evaluated just once (an order that later
steps count on) is. It goes to spark.checkpoint.dir and stays until discard(), the end of scratch(), or the session's.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Unset, a temporary folder stands in where all runs in this process; elsewhere it is an error."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not hasattr(spark, "_frameflow_folder"):
        spark._frameflow_folder = tempfile.mkdtemp(prefix="frameflow-")
    return spark._frameflow_folder


def _delete(spark: SparkSession, path: str, at_end: bool = False) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.deleteOnExit(where) if at_end else fs.delete(where, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _delete(spark, path, at_end=True)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._frameflow_table = path
    for held in getattr(spark, "_frameflow_scratch", []):
        held.append(path)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df._frameflow_table)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end all tables that were stored inside, those that results made inside still read included."""
    held: list[str] = []
    open_ones = spark.__dict__.setdefault("_frameflow_scratch", [])
    open_ones.append(held)
    try:
        yield
    finally:
        open_ones.remove(held)
        for path in held:
            _delete(spark, path)
