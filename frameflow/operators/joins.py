"""Joins of frames with tasks, labels, traces and files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameflow.operators.sampling import positions, running


def lookup(df: DataFrame, dim: DataFrame, on: str | Sequence[str], strict: bool = True) -> DataFrame:
    """Many-to-one join with a dimension table; a row without a match is an error if strict, else it goes.

    The check is part of the plan: no extra pass.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if not strict:
        return df.join(dim, keys)
    found = df.join(dim.withColumn("__found", F.lit(True)), keys, "left")
    ok = F.assert_true(F.col("__found").isNotNull(), F.concat(F.lit("no match for "), F.to_json(F.struct(*keys))))
    return found.withColumn("__ok", ok).where(F.col("__ok").isNull()).drop("__found", "__ok")


def first_of(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row per key, the first in this order (descending order for the last)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def label_join(df: DataFrame, labels: DataFrame, label: str, policy: str = "error", episode: str = "episode", step: str = "step", width: int = 4096) -> DataFrame:
    """Adds the label of each frame from a sparse table (episode, step, label).

    error: the frame's own; clip: the latest one so far, before the first label the first; nearest: the closer of the
    neighbours, the earlier of equals. A null label is none. Without labels in the episode: null.

    Neighbours are sought within stretches of `width` steps, and beyond these in a row a stretch with its first and last
    label. So no task takes a whole episode, and time grows in proportion to frames.
    """
    own = labels.select(F.col(episode), F.col(step), F.col(label))
    j = df.join(own, [episode, step], "left")
    if policy == "error":
        return j
    if policy not in ("clip", "nearest"):
        raise ValueError(f"unknown policy {policy!r}")
    known = F.when(F.col(label).isNotNull(), F.struct(F.col(step).alias("at"), F.col(label).alias("label")))
    j = j.withColumn("__known", known).withColumn("__b", F.floor(F.col(step) / width))
    # Spark evaluates a frame that ends at unbounded following anew for each row, one that begins at unbounded
    # preceding goes on from row to row: what lies ahead is looked up in descending order
    so_far = lambda keys, order, end: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, end)
    ends = j.groupBy(episode, "__b").agg(F.min_by("__known", "__known.at").alias("__first"), F.max_by("__known", "__known.at").alias("__last"))
    before = F.last("__last", True).over(so_far([episode], F.asc("__b"), -1))
    after = F.last("__first", True).over(so_far([episode], F.desc("__b"), -1))
    beyond = ends.select(episode, "__b", before.alias("__before"), after.alias("__after"))
    near = j.withColumn("__l", F.last("__known", True).over(so_far([episode, "__b"], F.asc(step), 0))).withColumn("__r", F.last("__known", True).over(so_far([episode, "__b"], F.desc(step), 0)))
    near = near.join(beyond, [episode, "__b"], "left")  # no label has a null episode
    left, right = F.coalesce("__l", "__before"), F.coalesce("__r", "__after")
    value = F.coalesce(left, right)
    if policy == "nearest":
        value = F.when(F.col(step) - left["at"] > right["at"] - F.col(step), right).otherwise(value)
    return near.select(*(c for c in j.columns if c not in (label, "__known", "__b")), value["label"].alias(label))


def range_join(df: DataFrame, key: str, ranges: DataFrame, width: int) -> DataFrame:
    """Rows with key in [start, end) of ranges (disjoint). Buckets of `width` keys make it an equi-join."""
    buckets = ranges.where("end > start").withColumn("__b", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    return df.withColumn("__b", F.floor(F.col(key) / width)).join(buckets, "__b").where(f"{key} >= start and {key} < end").drop("__b")


def prefix_ranges(lengths: DataFrame, order: str, length: str) -> DataFrame:
    """Adds start and end of each row in the running total of lengths."""
    return running(lengths, F.col(length), order, to="start").withColumn("end", F.col("start") + F.col(length))


def attach(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join of two tables that have to have the same rows; a key in one only is an error."""
    j = df.withColumn("__l", F.lit(True)).join(other.withColumn("__r", F.lit(True)), list(on), "full_outer")
    ok = F.assert_true(F.col("__l").isNotNull() & F.col("__r").isNotNull(), F.lit("the tables differ in their rows"))
    return j.withColumn("__ok", ok).where(F.col("__ok").isNull()).drop("__l", "__r", "__ok")


def compact_ids(df: DataFrame, *keys: str, to: str = "new_id") -> DataFrame:
    """Distinct keys with numbers 0, 1, ... in their order."""
    return positions(df.select(*keys).distinct(), *keys, to=to)


def first_failure(checks: Sequence[tuple[str, Column]], fine: str = "ok") -> Column:
    """The name of the first check, in order, that holds."""
    out = F.lit(fine)
    for name, bad in reversed(list(checks)):
        out = F.when(bad, F.lit(name)).otherwise(out)
    return out


def serials(calibration: Column) -> Column:
    """The serials of a map from serial to extrinsics: keys of digits only whose value has six numbers."""
    good = F.map_filter(calibration, lambda k, v: k.rlike("^[0-9]+$") & v.isNotNull() & (F.size(v) == 6))
    return F.array_sort(F.map_keys(good))


def serial_of(cameras: Column, *names: str) -> Column:
    """A camera's serial: that of the first of these names that has one, else the only serial of digits there is."""
    named = F.coalesce(*(F.nullif(F.element_at(cameras, F.lit(n)), F.lit("")) for n in names))
    digits = F.filter(F.map_values(cameras), lambda s: F.trim(s).rlike("^[0-9]+$"))
    return F.coalesce(named, F.when(F.size(digits) == 1, F.get(digits, F.lit(0))))


def state_for_action(action: str, states: Sequence[str], given: dict[str, str] | None = None) -> str | None:
    """The state key that an action key goes with: the one given for it, else that of the same base name."""
    if given and action in given:
        return given[action]
    base = action.removeprefix("action.")
    found = f"state.{base}"
    return found if action.startswith("action.") and found in states else None
