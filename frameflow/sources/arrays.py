"""NumPy files: traces of many episodes end to end with offsets, and archives of one episode each."""

from __future__ import annotations

import io
import os
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameflow.operators.sampling import positions, running
from frameflow.sources.byte_files import exists, opened
from frameflow.sources.npy_ranges import write_npy
from frameflow.tables import scratch


def write_traces(df: DataFrame, folder: str, name: str, episodes: int, episode: str = "episode", step: str = "step", x: str = "x", y: str = "y", allow_null: bool = False, overwrite: bool = False) -> dict[str, Any]:
    """name_coords.npy (float32 pairs), name_offsets.npy and name_present.npy in a folder that the driver and all tasks
    can write; tells what was written.

    A first pass numbers the points of the episodes 0..episodes-1 by episode and step, a second one writes them to their
    places, each task its own byte range. What the second one wrote is checked against the first, and a file takes its
    name only if it agrees. Points without both coordinates are left out with allow_null, else an error, as are
    episodes out of range, and files that are there already unless they may be replaced. The summary has counts of
    points and episodes, the first 50 episodes without points, points per episode, bounds of the coordinates, and up to
    20 points whose step is not their place in the episode.
    """
    paths = {k: os.path.join(folder, f"{name}_{k}.npy") for k in ("coords", "offsets", "present")}
    for path in paths.values():
        if os.path.exists(path) and not overwrite:
            raise FileExistsError(path)
    os.makedirs(folder, exist_ok=True)
    points = df.select(F.col(episode).cast("long").alias("episode"), F.col(step).cast("long").alias("step"), F.col(x).cast("float").alias("x"), F.col(y).cast("float").alias("y"))
    missing = F.col("x").isNull() | F.col("y").isNull()
    if allow_null:
        points = points.where(~missing)
    with scratch(df.sparkSession):
        placed = positions(points, "episode", "step")
        bad = F.coalesce(~F.col("episode").between(0, episodes - 1), F.lit(True)) | missing
        if wrong := placed.where(bad).first():
            raise ValueError(f"no place in the file for {wrong}")
        counts = placed.groupBy("episode").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
        slots = df.sparkSession.range(episodes + 1).join(counts, F.col("id") == F.col("episode"), "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))
        offsets = running(slots, F.col("n"), "id", to="start")
        figures = placed.agg(F.count(F.lit(1)), *(f(c) for f in (F.min, F.max) for c in ("x", "y"))).first()
        write_npy(placed.select("pos", "x", "y"), paths["coords"], "<f4", figures[0], 2)
        write_npy(offsets.select("id", "start"), paths["offsets"], "<i8", episodes + 1)
        write_npy(offsets.where(F.col("id") < episodes).select("id", F.col("n") > 0), paths["present"], "|b1", episodes)
        per = counts.agg(F.count(F.lit(1)), F.min("n"), F.median("n"), F.max("n")).first()
        absent = offsets.where((F.col("n") == 0) & (F.col("id") < episodes)).select("id").orderBy("id").limit(50).collect()
        place = F.col("pos") - F.col("first")
        odd = placed.join(counts, "episode").where(F.col("step") != place).select("episode", place.alias("expected"), "step").orderBy("episode", "expected").limit(20).collect()
    return {
        "row_count": figures[0], "coordinate_min": list(figures[1:3]), "coordinate_max": list(figures[3:5]), "present_episodes": per[0], "missing_episode_count": episodes - per[0], "missing_episodes_preview": [r.id for r in absent],
        "rows_per_present_episode": {"min": per[1] or 0, "median": per[2] or 0.0, "max": per[3] or 0}, "step_mismatches_preview": [r.asDict() for r in odd],
    }


def traces(spark: SparkSession, folder: str, name: str, scale: float = 0.01, tasks: int = 64) -> DataFrame:
    """(episode, step, x, y) of such files, coordinates times `scale`; the files stay where they are and are mapped.

    Episodes that name_present.npy denies are left out; where that file is missing, those without points are.
    """
    path = lambda k: os.path.join(folder, f"{name}_{k}.npy")
    episodes = len(np.load(path("offsets"), mmap_mode="r")) - 1

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coords, offsets = np.load(path("coords"), mmap_mode="r"), np.load(path("offsets"), mmap_mode="r")
        present = np.load(path("present"), mmap_mode="r") if os.path.exists(path("present")) else offsets[1:] > offsets[:-1]
        for batch in batches:
            for e in np.asarray(batch.column("id")).tolist():
                if present[e] and offsets[e + 1] > offsets[e]:
                    points = np.asarray(coords[offsets[e] : offsets[e + 1]], np.float64) * scale
                    columns = [np.full(len(points), e), np.arange(len(points)), points[:, 0], points[:, 1]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["episode", "step", "x", "y"])

    return spark.range(0, episodes, 1, max(1, min(tasks, episodes))).mapInArrow(step, "episode long, step long, x double, y double")


def trace_windows(spark: SparkSession, folder: str, name: str, size: int = 12, scale: float = 0.01) -> DataFrame:
    """traces() with, per step, the `size` points that end with it, the episode's first one in front if need be."""
    from frameflow.operators.windows import trailing

    return trailing(traces(spark, folder, name, scale), ["x", "y"], size)


def episodes(spark: SparkSession, listed: DataFrame, root: str, action_keys: Sequence[str], length: str = "length") -> DataFrame:
    """(episode_name, step, action) of archives (.npz), one per row of `listed`: episode_name, task, tag, length and,
    if it has that, source_npz.

    An archive is looked for at source_npz, then at root/task/tag/episodes/episode_name.npz. Its actions are under the
    first of `action_keys` that it has. A missing archive or key and a length other than the listed one are errors.
    """
    source = F.col("source_npz").cast("string") if "source_npz" in listed.columns else F.lit(None).cast("string")
    rows = listed.select(F.col("episode_name").cast("string"), F.col("task").cast("string"), F.col("tag").cast("string"), F.col(length).cast("long").alias("n"), source.alias("source"))
    keys = tuple(action_keys)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                file = r["episode_name"] if r["episode_name"].endswith(".npz") else f"{r['episode_name']}.npz"
                tried = [p for p in (r["source"], os.path.join(root, r["task"], r["tag"], "episodes", file)) if p]
                found = next((p for p in tried if exists(p)), None)
                if found is None:
                    raise FileNotFoundError(f"no archive at {', '.join(tried)}")
                with opened(found) as f, np.load(io.BytesIO(f.read())) as data:
                    key = next((k for k in keys if k in data), None)
                    if key is None:
                        raise KeyError(f"{found} has none of {keys}; it has {data.files}")
                    actions = np.asarray(data[key], np.float32)
                if len(actions) != r["n"]:
                    raise ValueError(f"{found} has {len(actions)} steps, not {r['n']}")
                columns = [pa.array([r["episode_name"]] * len(actions)), pa.array(np.arange(len(actions))), pa.array(actions.reshape(len(actions), -1).tolist(), pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays(columns, ["episode_name", "step", "action"])

    return rows.mapInArrow(step, "episode_name string, step long, action array<float>")
