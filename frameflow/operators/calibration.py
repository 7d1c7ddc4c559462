"""The calibration that belongs to a recording, resolved stage by stage over tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameflow.operators.joins import serial_of

#: Why a recording has no calibration, in the order of the stages.
REASONS = ("missing_calibration_entry", "missing_camera_serial", "missing_intrinsic", "missing_extrinsic")


def _one_each(df: DataFrame, keys: Sequence[str], values: Sequence[str], to: str) -> DataFrame:
    """One row a key, with its values as one column; of repeated keys the least values."""
    named = [F.col(k).alias(f"__{k}") for k in keys]
    there = df.where(" and ".join(f"`{k}` is not null" for k in keys))
    return there.groupBy(*named).agg(F.min(F.struct(*values)).alias(to))


def _stage(df: DataFrame, table: DataFrame, keys: dict[str, Column], reason: str, fine: Column) -> DataFrame:
    """Left outer join of the rows that have not failed; those without a match, or with one that is not fine, fail."""
    alive = F.col("reason").isNull()
    on = [F.when(alive, value) == F.col(f"__{name}") for name, value in keys.items()]
    joined = df.join(table, on, "left").drop(*(f"__{name}" for name in keys))
    return joined.withColumn("reason", F.when(alive & ~F.coalesce(fine, F.lit(False)), reason).otherwise(F.col("reason")))


def calibrated(recordings: DataFrame, entries: DataFrame, cameras: DataFrame, intrinsics: DataFrame, extrinsics: DataFrame, names: Sequence[str], path: str = "path") -> DataFrame:
    """recordings with episode_id, serial, intrinsic, extrinsic and reason, which is null where all of them were found
    and else names the first stage that failed.

    entries: (path, episode_id). cameras: (episode_id, cameras map<string, string>), from which the serial is taken by
    the camera's `names` (joins.serial_of). intrinsics: (episode_id, serial, fx, fy, cx, cy, width, height).
    extrinsics: (episode_id, serial, matrix). Rows that failed have null keys from then on and match nothing; where
    they are many, adaptive execution splits their partition, as these are left outer joins.
    """
    r = recordings.withColumn("reason", F.lit(None).cast("string"))
    r = _stage(r, _one_each(entries.select(F.col(path).alias("p"), "episode_id"), ["p"], ["episode_id"], "__e"), {"p": F.col(path)}, REASONS[0], F.col("__e.episode_id").isNotNull())
    r = r.withColumn("episode_id", F.col("__e.episode_id")).drop("__e")
    known = cameras.select("episode_id", serial_of(F.col("cameras"), *names).alias("serial"))
    r = _stage(r, _one_each(known, ["episode_id"], ["serial"], "__c"), {"episode_id": F.col("episode_id")}, REASONS[1], F.col("__c.serial").isNotNull())
    r = r.withColumn("serial", F.col("__c.serial")).drop("__c")
    both = {"episode_id": F.col("episode_id"), "serial": F.col("serial")}
    r = _stage(r, _one_each(intrinsics, list(both), ["fx", "fy", "cx", "cy", "width", "height"], "intrinsic"), both, REASONS[2], F.col("intrinsic.fx").isNotNull())
    r = _stage(r, _one_each(extrinsics, list(both), ["matrix"], "__x"), both, REASONS[3], F.col("__x.matrix").isNotNull())
    return r.withColumn("extrinsic", F.col("__x.matrix")).drop("__x")


def rescaled(intrinsic: Column, width: Column, height: Column) -> Column:
    """Intrinsics as they are for frames of this size; a source without a size has that of the frames."""
    x = F.when(intrinsic["width"] > 0, width / intrinsic["width"]).otherwise(1.0)
    y = F.when(intrinsic["height"] > 0, height / intrinsic["height"]).otherwise(1.0)
    return F.when(intrinsic.isNotNull(), F.struct((intrinsic["fx"] * x).alias("fx"), (intrinsic["fy"] * y).alias("fy"), (intrinsic["cx"] * x).alias("cx"), (intrinsic["cy"] * y).alias("cy"), width.alias("width"), height.alias("height")))


def positions_reason(n_frames: Column, n_numbers: Column) -> Column:
    """Why a recording's flat positions can't be cut into points of its frames; null if they can."""
    width = n_numbers / F.nullif(n_frames, F.lit(0))
    return (
        F.when(F.coalesce(n_frames, F.lit(0)) == 0, "no_frames").when(F.coalesce(n_numbers, F.lit(0)) == 0, "no_positions")
        .when(n_numbers % F.nullif(n_frames, F.lit(0)) != 0, "length_mismatch").when(width < 3, "positions_too_short")
    )
