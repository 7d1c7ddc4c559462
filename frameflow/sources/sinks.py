"""Sinks: JSON lines, small JSON documents, reports, statistics and manifests, through Hadoop file systems.

Tables of any size are written by tasks, a file each. Documents are for what one reader takes in whole (a report, the
statistics of a tag): they are put together in the driver, from `most` rows at most, and replace their target by one
rename, so that a reader sees the old one or the new one.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
import uuid
from collections.abc import Sequence
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@contextmanager
def _opened(spark: SparkSession, path: str):
    """A file system of its own, without checksum files, and the path in it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsc.hadoopConfiguration()
    fs = spark._jvm.org.apache.hadoop.fs.FileSystem.newInstance(where.toUri(), conf)
    fs.setVerifyChecksum(False)
    fs.setWriteChecksum(False)
    try:
        yield fs, where
    finally:
        fs.close()


def _replace(spark: SparkSession, source, target) -> None:
    """Renames source to target, over what is there: one step of the file system, so no reader misses both."""
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = getattr(jvm.org.apache.hadoop.fs.Options, "Rename").OVERWRITE
    context.rename(source, target, options)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file, by a temporary file beside it and a rename."""
    with _opened(spark, path) as (fs, target):
        beside = target.suffix(f".tmp-{uuid.uuid4().hex}")
        out = fs.create(beside, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        _replace(spark, beside, target)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file; None if there is none."""
    with _opened(spark, path) as (fs, where):
        if not fs.exists(where):
            return None
        source = fs.open(where)
        try:
            return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode("utf-8", "replace")
        finally:
            source.close()


def write_document(spark: SparkSession, path: str, document: Any) -> None:
    write_text(spark, path, json.dumps(document, ensure_ascii=False, indent=2))


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per row, nulls included, in files of a new folder; all there once the job has ended."""
    df.write.option("ignoreNullFields", "false").json(path)


def few(df: DataFrame, most: int) -> list[dict[str, Any]]:
    """The rows of a table that is known to be small; more than `most` are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows for one document")
    return [r.asDict(True) for r in rows]


def append_entries(spark: SparkSession, path: str, entries: Sequence[dict[str, Any]]) -> int:
    """Adds entries to the array of a JSON document and tells how many there are; a missing one starts anew.

    So does one that is no JSON array, but its text is first put aside, at path.corrupt-<hash of the text>.
    """
    text = read_text(spark, path) or "[]"
    try:
        had = json.loads(text)
    except json.JSONDecodeError:
        had = None
    if not isinstance(had, list):
        write_text(spark, f"{path}.corrupt-{hashlib.sha256(text.encode()).hexdigest()[:12]}", text)
        had = []
    all_of_them = [*had, *entries]
    write_document(spark, path, all_of_them)
    return len(all_of_them)


def write_report(rows: DataFrame, path: str, label: str, figures: Sequence[str], source: str = "", most: int = 10_000) -> None:
    """An evaluation report as path.json, path.csv and path.md: a row per label, best mean first, and its figures."""
    found = few(rows.select(label, *figures), most)
    found.sort(key=lambda r: (-sum(r[f] for f in figures) / len(figures), r[label]))
    spark = rows.sparkSession
    write_document(spark, f"{path}.json", {"manifest": source, "rows": found})
    text = io.StringIO()
    writer = csv.DictWriter(text, [label, *figures], lineterminator="\n")
    writer.writeheader()
    writer.writerows(found)
    write_text(spark, f"{path}.csv", text.getvalue())
    lines = [f"| {' | '.join([label, *figures])} |", f"|---|{'---:|' * len(figures)}"]
    lines += [f"| {' | '.join([str(r[label]), *(f'{r[f]:.4f}' for f in figures)])} |" for r in found]
    write_text(spark, f"{path}.md", "\n".join(lines) + "\n")


def write_statistics(exported: DataFrame, path: str, tag: str, counts: DataFrame | None = None, most: int = 10_000) -> None:
    """Statistics by tag (rows of stats.exported()) as one JSON document; counts, by tag, go in beside them."""
    document = {str(r.pop(tag)): {"action": r} for r in few(exported, most)}
    for r in few(counts, most) if counts is not None else []:
        document.setdefault(str(r.pop(tag)), {}).update(r)
    write_document(exported.sparkSession, path, document)


def write_shards(df: DataFrame, path: str, episode: str, per_shard: int, writers: int = 8) -> None:
    """Results in a folder per `per_shard` episodes, each written by up to `writers` tasks, and manifest.jsonl with what
    each shard holds."""
    sharded = df.withColumn("shard", F.floor(F.col(episode) / per_shard).cast("long"))
    sharded.repartition("shard", F.pmod(F.xxhash64(*df.columns), F.lit(writers))).write.partitionBy("shard").json(f"{path}/shards")
    held = df.sparkSession.read.schema(sharded.schema).json(f"{path}/shards")
    manifest = held.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(episode).alias("n_episodes"), F.min(episode).alias("first"), F.max(episode).alias("last"))
    write_jsonl(manifest.coalesce(1), f"{path}/manifest.jsonl")
