"""Control state along an episode that no window expresses; machines.py has its streaming form."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame


class Sticky:
    """A gripper signal that, once it leaves its reference by more than a threshold, is held for some steps.

    Each step gives reference minus value. The first value is the reference; what triggers a hold becomes the new one.
    """

    def __init__(self, threshold: float = 0.5, repeats: int = 3, state: tuple[float | None, float | None, int] = (None, None, 0)):
        self.threshold, self.repeats = threshold, repeats
        self.reference, self.held, self.told = state

    def step(self, value: float) -> float:
        if self.reference is None:
            self.reference = value
        move = self.reference - value
        if self.held is None and abs(move) > self.threshold:
            self.held, self.reference = move, value
        if self.held is not None:
            move = self.held
            self.told += 1
            if self.told == self.repeats:
                self.held, self.told = None, 0
        return move

    @property
    def state(self) -> tuple[float | None, float | None, int]:
        return self.reference, self.held, self.told


def sticky(df: DataFrame, value: str, threshold: float = 0.5, repeats: int = 3, episode: str = "episode", step: str = "step") -> DataFrame:
    """(episode, step, sticky) by running the automaton along each episode, one episode in a task at a time."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by(step)
        machine = Sticky(threshold, repeats)
        out = [machine.step(float(x)) for x in t.column(value).to_pylist()]
        return pa.table([t.column(episode), t.column(step), pa.array(out, pa.float64())], [episode, step, "sticky"])

    kinds = dict(df.dtypes)
    return df.select(episode, step, value).groupBy(episode).applyInArrow(run, f"{episode} {kinds[episode]}, {step} {kinds[step]}, sticky double")
