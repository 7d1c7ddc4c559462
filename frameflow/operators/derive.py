"""Columns derived from raw leaves, batches of vectors, and what a loader's configuration says."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Per dataset, the vectors that are put together from leaves, each leaf with how many of its numbers.
RECIPES: dict[str, dict[str, tuple[tuple[str, int], ...]]] = {
    "bcz": {
        "action": (("steps/action/future/xyz_residual", 3), ("steps/action/future/axis_angle_residual", 3), ("steps/action/future/target_close", 1)),
        "observation.state": (("steps/observation/present/xyz", 3), ("steps/observation/present/axis_angle", 3), ("steps/observation/present/sensed_close", 1)),
    },
    "fractal": {
        "action": (("steps/action/world_vector", 3), ("steps/action/rotation_delta", 3), ("steps/action/gripper_closedness_action", 1)),
        "observation.state": (("steps/observation/base_pose_tool_reached", 7),),
    },
    "droid_56k": {"observation.state": (("steps/observation/cartesian_position", 6), ("steps/observation/gripper_position", 1))},
}


def derived(df: DataFrame, dataset: str, recipes: dict[str, dict[str, tuple[tuple[str, int], ...]]] = RECIPES) -> DataFrame:
    """df with the dataset's derived vectors, of floats, where they are absent and all their leaves are there.

    Leaves are columns named by their paths, arrays or single numbers; of each the first numbers are taken, in the
    recipe's order.
    """
    have = dict(df.dtypes)

    def numbers(leaf: str) -> Column:
        c = F.col(f"`{leaf}`")
        return (c if have[leaf].startswith("array") else F.array(c)).cast("array<float>")

    for name, leaves in recipes.get(dataset, {}).items():
        if name not in have and all(leaf in have for leaf, _ in leaves):
            parts = [F.slice(numbers(leaf), 1, n) for leaf, n in leaves]
            df = df.withColumn(name, F.concat(*parts))
    return df


def _arms(v: Column, *parts: tuple[int, int]) -> Column:
    return F.when(F.size(v) == 14, F.concat(*(F.slice(v, first, n) for first, n in parts))).otherwise(v)


def arms_to_model(v: Column) -> Column:
    """[left 6, left gripper, right 6, right gripper] -> [left 6, right 6, left gripper, right gripper]; vectors of any
    other length stay as they are."""
    return _arms(v, (1, 6), (8, 6), (7, 1), (14, 1))


def arms_to_robot(v: Column) -> Column:
    """The way back from arms_to_model()."""
    return _arms(v, (1, 6), (13, 1), (7, 6), (14, 1))


def in_range(index: Column, length: Column) -> Column:
    """The index; one outside 0..length-1 stops the job."""
    fine = (index >= 0) & (index < length)
    return F.when(F.assert_true(F.coalesce(fine, F.lit(False)), F.concat(F.lit("frame index "), index.cast("string"), F.lit(" is out of range"))).isNull(), index)


def collated(df: DataFrame, batch: str, order: str, column: str, pad: Column) -> DataFrame:
    """Per batch: `items`, the arrays of a column in order, padded to the longest; their lengths, and `starts`, which is
    where each would begin if they lay end to end, with the total last. Batches are of bounded size."""
    rows = df.groupBy(batch).agg(F.sort_array(F.collect_list(F.struct(order, column))).alias("r")).withColumn("x", F.transform("r", lambda r: r[column]))
    lengths = F.transform("x", F.size)
    longest = F.array_max(lengths)
    filled = F.transform("x", lambda a: F.concat(a, F.array_repeat(pad, F.array_max(F.transform("x", F.size)) - F.size(a))))
    starts = F.aggregate(lengths, F.array(F.lit(0)), lambda s, n: F.concat(s, F.array(F.element_at(s, -1) + n)))
    return rows.select(batch, filled.alias("items"), lengths.alias("lengths"), starts.alias("starts"), longest.alias("longest"))


def as_bool(value: Any, default: bool = False) -> bool:
    """A setting as a truth value: 0, false, no, off and nothing are false as text."""
    if value is None:
        return default
    return value.strip().lower() not in ("0", "false", "no", "off", "") if isinstance(value, str) else bool(value)


def as_list(value: str | Sequence[Any] | None) -> list[str] | None:
    """A setting as a list of texts: parts between commas, trimmed; None if there are none."""
    if isinstance(value, str):
        return [p.strip() for p in value.split(",") if p.strip()] or None
    return None if value is None else [str(x) for x in value]


def schedule(chunk: int, fps: float = 20.0, horizon: int = 4) -> dict[str, float | int]:
    """How often a policy is asked that predicts `chunk` steps of which `horizon` are carried out."""
    if not 0 < horizon <= chunk:
        raise ValueError(f"the horizon has to lie in 1..{chunk}, not at {horizon}")
    return {"dataset_fps": float(fps), "action_chunk_size": chunk, "execute_horizon": horizon, "query_hz": fps / horizon, "control_dt": 1.0 / fps}
