"""What a robot type's data looks like to a model: views, horizons and transforms, as a table that becomes a projection.

A configuration names the leaves of each modality, how each is normalised, and which rotations are rewritten. Compiled
with the statistics of a dataset it is one chain of column expressions, forward and back.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameflow.functions.rotations import convert, size_of
from frameflow.operators.transforms import Compose, Concat, Normalise
from frameflow.operators.windows import chunk

INSTRUCTION = "annotation.human.action.task_description"


@dataclass(frozen=True)
class Config:
    video: tuple[str, ...]
    state: tuple[str, ...]
    action: tuple[str, ...]
    modes: Mapping[str, str]
    rotations: Mapping[str, str] = field(default_factory=dict)
    language: str = INSTRUCTION
    action_steps: int = 16

    def leaves(self, modality: str) -> tuple[str, ...]:
        return tuple(f"{modality}.{k}" for k in getattr(self, modality))


_POSE = ("x", "y", "z", "roll", "pitch", "yaw")
_EACH = lambda mode, *leaves: {leaf: mode for leaf in leaves}

#: By robot type, the leaves, their modes and rotations, and how many steps of action go with a frame.
ROBOTS: dict[str, Config] = {
    "libero_franka": Config(
        video=("primary_image", "wrist_image"), state=(*_POSE, "pad", "gripper"), action=(*_POSE, "gripper"),
        modes=_EACH("min_max", "action.x", "action.y", "action.z", "action.roll", "action.pitch", "action.yaw"), action_steps=8,
    ),
    "oxe_droid": Config(
        video=("exterior_image_1", "exterior_image_2", "wrist_image"), state=("eef_position", "eef_rotation", "gripper_position"), action=("eef_position_delta", "eef_rotation_delta", "gripper_position"),
        modes=_EACH("min_max", "state.eef_position", "state.gripper_position") | _EACH("binary", "action.gripper_position"),
        rotations={"state.eef_rotation": "rotation_6d", "action.eef_rotation_delta": "axis_angle"}, language="annotation.language.language_instruction",
    ),
    "oxe_bridge": Config(
        video=("image_0",), state=(*_POSE, "pad", "gripper"), action=(*_POSE, "gripper"),
        modes=_EACH("q99", *(f"state.{k}" for k in (*_POSE, "pad")), *(f"action.{k}" for k in _POSE)) | _EACH("binary", "state.gripper", "action.gripper"),
    ),
    "oxe_rt1": Config(
        video=("image",), state=("x", "y", "z", "rx", "ry", "rz", "rw", "gripper"), action=(*_POSE, "gripper"),
        modes=_EACH("q99", *(f"state.{k}" for k in ("x", "y", "z", "rx", "ry", "rz", "rw")), *(f"action.{k}" for k in _POSE)) | _EACH("binary", "state.gripper", "action.gripper"),
    ),
    "demo_sim_franka_delta_joints": Config(
        video=("base_view", "ego_view"), state=("joints",), action=("delta_joints", "gripper_close"),
        modes=_EACH("min_max", "state.joints", "action.delta_joints") | _EACH("binary", "action.gripper_close"),
    ),
    "custom_robot_config": Config(
        video=("base_view", "ego_view"), state=("eef_position", "eef_rotation"), action=("delta_eef_position", "delta_eef_rotation", "gripper_close"),
        modes=_EACH("min_max", "state.eef_position", "state.eef_rotation", "action.delta_eef_position", "action.delta_eef_rotation") | _EACH("binary", "action.gripper_close"),
    ),
}
#: Which two statistics a mode takes.
STATISTICS = {"q99": ("q01", "q99"), "min_max": ("min", "max"), "mean_std": ("mean", "std"), "scale": ("min", "max"), "binary": ()}


class Rotate:
    """A vector column from one representation of rotations to another, and back."""

    def __init__(self, column: str, source: str, target: str):
        size_of(source), size_of(target)
        self.column, self.source, self.target = column, source, target

    def _as(self, df: DataFrame, source: str, target: str) -> DataFrame:
        return df if source == target else df.withColumn(self.column, convert(F.col(f"`{self.column}`"), source, target))

    def apply(self, df: DataFrame, train: bool = True) -> DataFrame:
        return self._as(df, self.source, self.target)

    def unapply(self, df: DataFrame) -> DataFrame:
        return self._as(df, self.target, self.source)


class Rename:
    """A leaf's column under a name without dots, and back; single numbers become vectors of one."""

    def __init__(self, leaf: str, plain: bool):
        self.leaf, self.plain = leaf, plain

    @property
    def column(self) -> str:
        return self.leaf.replace(".", "__")

    def apply(self, df: DataFrame, train: bool = True) -> DataFrame:
        c = F.col(f"`{self.leaf}`")
        return df.withColumn(self.column, (F.array(c) if self.plain else c).cast("array<double>")).drop(F.col(f"`{self.leaf}`"))

    def unapply(self, df: DataFrame) -> DataFrame:
        c = F.col(self.column)
        return df.withColumn(self.leaf, c[0] if self.plain else c).drop(self.column)


def compiled(config: Config | str, df: DataFrame, statistics: Mapping[str, Mapping[str, Sequence[float]]], rotations: Mapping[str, str] | None = None) -> Compose:
    """The transforms of a configuration for df, whose columns are named by the leaves (`state.x`), to `state` and `action`.

    statistics: by leaf, those that its mode takes, a number for each dimension. rotations: by leaf, the representation
    that the data has where the configuration names a target; a leaf that is rotated and normalised at once is an
    error, as statistics belong to what is stored. Leaves are concatenated in order; unapply() restores df's columns.
    """
    config = ROBOTS[config] if isinstance(config, str) else config
    kinds = dict(df.dtypes)
    steps: list = []
    for modality in ("state", "action"):
        widths: dict[str, int] = {}
        for leaf in config.leaves(modality):
            if leaf not in kinds:
                raise KeyError(f"{leaf} is not a column")
            rename = Rename(leaf, not kinds[leaf].startswith("array"))
            steps.append(rename)
            mode, target = config.modes.get(leaf), config.rotations.get(leaf)
            if target:
                if mode:
                    raise ValueError(f"{leaf} is rotated and can't be normalised as well")
                source = (rotations or {}).get(leaf, target)
                steps.append(Rotate(rename.column, source, target))
                widths[rename.column] = size_of(target)
                continue
            own = statistics.get(leaf, {})
            width = 1 if rename.plain else len(next(iter(own.values()), ()))
            if mode:
                needed = [own.get(name) for name in STATISTICS[mode]]
                if any(x is None for x in needed):
                    raise KeyError(f"{mode} of {leaf} takes {' and '.join(STATISTICS[mode])}")
                low, high = needed or ([0.0] * width, [0.0] * width)
                steps.append(Normalise(rename.column, mode, low, high))
            if not width:
                raise KeyError(f"how wide {leaf} is has to be known from its statistics")
            widths[rename.column] = width
        steps.append(Concat(widths, modality))
    return Compose(*steps)


def with_actions(df: DataFrame, config: Config | str, episode: str = "episode", step: str = "step", action: str = "action") -> DataFrame:
    """Adds action_chunk: the actions of as many steps as the configuration asks for, from the frame's own on, the
    episode's last one repeated."""
    config = ROBOTS[config] if isinstance(config, str) else config
    return chunk(df, action, config.action_steps, "last", episode=episode, step=step, to="action_chunk")
