"""Datasets of frames on disk: two layouts, their metadata, and readers of trace and label files."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameflow.operators.sampling import positions
from frameflow.sources.byte_files import created, exists, move, opened, remove
from frameflow.tables import stored


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _document(spark: SparkSession, path: str) -> dict[str, Any]:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def version(spark: SparkSession, root: str, given: str | None = None, default: str = "v2.0") -> str:
    """The layout: as given, else by the metadata files there, else the default."""
    if given:
        return given
    if _exists(spark, f"{root}/meta/tasks.parquet"):
        return "v3.0"
    if _exists(spark, f"{root}/meta/episodes.jsonl"):
        return "v2.0"
    return default


def jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A file of JSON lines; a line that is no JSON stops the job, blank lines don't count."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


class Dataset:
    """One dataset: `frames`, `episodes`, `tasks` as DataFrames, `info` and `modality` as dictionaries."""

    def __init__(self, spark: SparkSession, root: str, given: str | None = None):
        self.spark, self.root, self.version = spark, root.rstrip("/"), version(spark, root.rstrip("/"), given)

    @property
    def frames(self) -> DataFrame:
        """All frames; a filter on episode_index reaches the scan."""
        return self.spark.read.option("recursiveFileLookup", "true").parquet(f"{self.root}/data")

    def episode(self, index: int) -> DataFrame:
        if self.version.startswith("v2"):
            size = self.info.get("chunks_size", 1000)
            template = self.info.get("data_path", "data/chunk-{episode_chunk:03d}/episode_{episode_index:06d}.parquet")
            return self.spark.read.parquet(f"{self.root}/" + template.format(episode_chunk=index // size, episode_index=index))
        return self.frames.where(F.col("episode_index") == index)

    @property
    def tasks(self) -> DataFrame:
        if self.version.startswith("v2"):
            return jsonl(self.spark, f"{self.root}/meta/tasks.jsonl", "task_index long, task string")
        df = self.spark.read.parquet(f"{self.root}/meta/tasks.parquet")
        other = [c for c in df.columns if c != "task_index"]
        return df if "task" in df.columns or not other else df.withColumnRenamed(other[0], "task")

    @property
    def episodes(self) -> DataFrame:
        if self.version.startswith("v2"):
            return jsonl(self.spark, f"{self.root}/meta/episodes.jsonl")
        return self.spark.read.option("recursiveFileLookup", "true").parquet(f"{self.root}/meta/episodes")

    @property
    def info(self) -> dict[str, Any]:
        return _document(self.spark, f"{self.root}/meta/info.json")

    @property
    def modality(self) -> dict[str, Any]:
        return _document(self.spark, f"{self.root}/meta/modality.json")

    def view(self, frames: DataFrame, kind: str, *keys: str) -> DataFrame:
        """Adds `kind.key` columns, each the slice of a physical vector that the modality metadata gives it."""
        meta = self.modality[kind]
        default = {"state": "observation.state", "action": "action"}[kind]
        for k in keys:
            if k not in meta:
                raise KeyError(f"{kind}.{k} is not in the modality metadata")
            m = meta[k]
            frames = frames.withColumn(f"{kind}.{k}", F.slice(F.col(f"`{m.get('original_key') or default}`"), m["start"] + 1, m["end"] - m["start"]))
        return frames


#: Element types of feature leaves.
LEAF_TYPES = {"bool": T.BooleanType(), "int32": T.IntegerType(), "int64": T.LongType(), "float32": T.FloatType(), "float64": T.DoubleType(), "string": T.StringType()}


def leaf_type(dtype: str, width: int = 1) -> T.DataType:
    """The column type of a leaf; other floats are float, anything else long; wider ones are arrays."""
    element = LEAF_TYPES.get(dtype) or (T.FloatType() if dtype.startswith("float") else T.LongType())
    return element if width == 1 else T.ArrayType(element)


def leaves(features: dict[str, Any], prefix: str = "") -> list[tuple[str, str, int]]:
    """(path, dtype, width) of the leaves of a nested feature description, in order of path."""
    out: list[tuple[str, str, int]] = []
    for name, child in sorted(features.items()):
        path = f"{prefix}/{name}" if prefix else name
        if "dtype" in child:
            width = 1
            for n in child.get("shape") or []:
                width *= int(n)
            out.append((path, child["dtype"], width))
        else:
            out += leaves(child.get("features", child), path)
    return out


def traces(spark: SparkSession, path: str) -> DataFrame:
    """(suite, episode, step, x, y) with coordinates scaled to 0..100 from a trace document per suite."""
    schema = "suite string, image_size array<int>, view string, episodes map<string, struct<coords: array<array<double>>>>"
    d = spark.read.schema(schema).json(path, multiLine=True).select("suite", "image_size", F.explode("episodes").alias("episode", "e"))
    p = d.select("suite", "image_size", F.col("episode").cast("long").alias("episode"), F.posexplode("e.coords").alias("step", "p"))
    scaled = lambda k: F.col("p")[k] / F.greatest(F.col("image_size")[k] - 1, F.lit(1)) * 100
    return p.select("suite", "episode", F.col("step").cast("long").alias("step"), scaled(0).alias("x"), scaled(1).alias("y"))


def labels(spark: SparkSession, path: str) -> DataFrame:
    """Sparse labels of JSON lines, the last of equal keys in file order."""
    d = jsonl(spark, path, "dataset_name string, episode_index long, step_index long, indices array<long>").withColumn("__at", F.monotonically_increasing_id())
    keys = ["dataset_name", "episode_index", "step_index"]
    return d.groupBy(*keys).agg(F.max_by("indices", "__at").alias("indices"))


def conversations(spark: SparkSession, *paths: str) -> DataFrame:
    """Annotation files, JSON or JSON lines by their ending, one after another."""
    out = None
    for p in paths:
        d = jsonl(spark, p) if p.endswith(".jsonl") else spark.read.json(p, multiLine=True)
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def write_frames(df: DataFrame, path: str, episode: str = "episode_index", per_chunk: int = 1000) -> None:
    """Frames as Parquet, a folder per chunk of episodes, rows in order within files."""
    chunked = df.withColumn("chunk", F.floor(F.col(episode) / per_chunk).cast("long"))
    chunked.repartitionByRange("chunk", episode).sortWithinPartitions("chunk", episode, "frame_index").write.partitionBy("chunk").parquet(path)


def footer_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(path, mb): what the columns of each Parquet file take uncompressed, by its footer, in units of 1024 * 1024 bytes."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with opened(name) as file:  # Parquet reads the end of the file alone
                    meta = pq.read_metadata(file)
                groups = [meta.row_group(k) for k in range(meta.num_row_groups)]
                total = sum(g.column(c).total_uncompressed_size for g in groups for c in range(g.num_columns))
                yield pa.RecordBatch.from_pydict({"path": [name], "mb": [total / 1024**2]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    return files.select("path").mapInArrow(step, "path string, mb double")  # without content: only listed


def in_file_order(spark: SparkSession, folder: str, to: str = "index") -> DataFrame:
    """All rows of the Parquet files under a folder, numbered by path and place in the file; reads a stored table."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(folder)
    at = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    return positions(at, "__file", "__row", to=to).drop("__file", "__row")


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value) of the lines of JSON-lines files that are neither blank nor JSON, lines numbered from 1.

    Files are read in splits; lines before a split are counted by file, a row for each split.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    blocks = rows.groupBy("path", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).drop("n")
    bad = rows.where((F.trim("value") != "") & F.try_parse_json("value").isNull())
    return bad.join(starts, ["path", "block"]).select("path", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line"), "value")


def write_episodes(df: DataFrame, root: str, template: str = "data/chunk-{episode_chunk:03d}/episode_{episode_index:06d}.parquet", chunk_size: int = 1000, episode: str = "episode_index", frame: str = "frame_index", overwrite: bool = False) -> DataFrame:
    """Frames as one Parquet file for each episode, named by the template; (episode, path, n_rows) of what was written.

    Each file is written beside its place and takes its name by a rename, so readers see the old one or the new one
    whole, and an episode that is written again, by a retried task too, replaces itself. A file that is there is an
    error without overwrite. A task streams its episodes one after the other, with a batch of rows in memory.
    """
    place = df.columns.index(episode)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, now, rows, beside, path = None, None, 0, "", ""

        def end() -> pa.RecordBatch:
            writer.close()
            move(beside, path)
            return pa.RecordBatch.from_pydict({"episode": [now], "path": [path], "n_rows": [rows]}, schema=pa.schema([("episode", pa.int64()), ("path", pa.string()), ("n_rows", pa.int64())]))

        try:
            for batch in batches:
                ids = batch.column(place).to_numpy(zero_copy_only=False)
                cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)] if len(ids) else [0]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if writer is None or ids[a] != now:
                        if writer is not None:
                            yield end()
                        now, rows = int(ids[a]), 0
                        path = f"{root}/" + template.format(episode_chunk=now // chunk_size, episode_index=now)
                        if not overwrite and exists(path):
                            raise FileExistsError(path)
                        beside = f"{path}.{uuid.uuid4().hex}.tmp"
                        writer = pq.ParquetWriter(created(beside), batch.schema)
                    writer.write_batch(batch.slice(a, b - a))
                    rows += b - a
            if writer is not None:
                yield end()
                writer = None
        finally:
            if writer is not None:
                writer.close()
                remove(beside)

    known = df.where(F.col(episode).isNotNull()).repartition(episode).sortWithinPartitions(episode, frame)
    return stored(known.mapInArrow(write, "episode long, path string, n_rows long"), "episodes")
