"""Control state over streams by event time: rows may come late and in any order, results are those of the batch form.

Each episode keeps the rows that the watermark has not reached yet. Once it has, they leave in the order of their steps
through the episode's machine, whose own state is a few numbers or the last chunks. An event-time timer wakes an episode
for its next row; one that has had no row for `idle` is forgotten, with all it kept. Rows later than the watermark
are dropped by Spark. Sessions need the RocksDB state store (frameflow.session sets it).
"""

from __future__ import annotations

from abc import abstractmethod
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from frameflow.streaming.control import Sticky


class Machine(StatefulProcessor):
    """Rows (episode, step, frame_us, frame_value array<double>, frame_width) in order of time and step through advance()."""

    #: Schema of what advance() gets and returns besides the row.
    memory: str

    def __init__(self, names: tuple[str, str, str], idle_ms: int):
        self.names, self.idle_ms = names, idle_ms

    @abstractmethod
    def advance(self, memory: tuple | None, step: int, value: np.ndarray) -> tuple[tuple | None, Any]:
        """The next memory, and the output of this row."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "step long", "t long, v array<double>, w int")
        self.kept = handle.getValueState("kept", self.memory)
        self.newest = handle.getValueState("newest", "ms long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        newest = self.newest.get()[0] if self.newest.exists() else -1
        first = None
        for part in rows:
            for step, t, v, w in zip(part[self.names[1]], part["frame_us"], part["frame_value"], part["frame_width"], strict=True):
                self.waiting.updateValue((int(step),), (int(t), [float(x) for x in v], int(w)))
                ms = -(-int(t) // 1000)
                first = ms if first is None else min(first, ms)
                newest = max(newest, ms)
        if first is not None:
            self.newest.update((newest,))
            self.handle.registerTimer(first)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        due, left = [], None
        for (step,), (t, v, w) in self.waiting.iterator():
            if t <= 1000 * now:
                due.append((t, step, v, w))
            else:
                left = t if left is None else min(left, t)
        memory = tuple(self.kept.get()) if self.kept.exists() else None
        out = []
        for _, step, v, w in sorted(due, key=lambda r: r[:2]):
            memory, said = self.advance(memory, step, np.asarray(v, float).reshape(-1, w) if w else np.asarray(v, float))
            out.append((key[0], step, said))
            self.waiting.removeKey((step,))
        if due and memory is not None:
            self.kept.update(memory)
        if left is not None:
            self.handle.registerTimer(-(-left // 1000))
        elif self.newest.exists() and now >= self.newest.get()[0] + self.idle_ms:
            self.waiting.clear()
            self.kept.clear()
            self.newest.clear()
        else:
            self.handle.registerTimer((self.newest.get()[0] if self.newest.exists() else now) + self.idle_ms)
        yield pd.DataFrame(out, columns=list(self.names)) if out else pd.DataFrame()

    def close(self) -> None:
        pass


class StickyMachine(Machine):
    memory = "reference double, held double, told long"

    def __init__(self, names: tuple[str, str, str], idle_ms: int, threshold: float, repeats: int):
        super().__init__(names, idle_ms)
        self.threshold, self.repeats = threshold, repeats

    def advance(self, memory: tuple | None, step: int, value: np.ndarray) -> tuple[tuple, float]:
        reference, held, told = memory or (None, 0.0, 0)
        machine = Sticky(self.threshold, self.repeats, (reference, held if told else None, int(told)))
        said = machine.step(float(value[0]))
        reference, held, told = machine.state
        return (float(reference), float(held or 0.0), int(told)), float(said)


class ReplayMachine(Machine):
    memory = "chunk array<double>, width int"

    def __init__(self, names: tuple[str, str, str], idle_ms: int, size: int):
        super().__init__(names, idle_ms)
        self.size = size

    def advance(self, memory: tuple | None, step: int, value: np.ndarray) -> tuple[tuple | None, list[float] | None]:
        if step % self.size == 0:
            memory = ([float(x) for x in value.ravel()], value.shape[1])
        held = np.asarray(memory[0]).reshape(-1, memory[1]) if memory else np.zeros((0, 1))
        at = step % self.size
        return memory, held[at].tolist() if at < len(held) else None


class EnsembleMachine(Machine):
    memory = "chunks array<array<double>>, width int"

    def __init__(self, names: tuple[str, str, str], idle_ms: int, horizon: int, alpha: float):
        super().__init__(names, idle_ms)
        self.horizon, self.alpha = horizon, alpha

    def advance(self, memory: tuple | None, step: int, value: np.ndarray) -> tuple[tuple, list[float]]:
        before = [np.asarray(c, float).reshape(-1, memory[1]) for c in memory[0]] if memory else []
        chunks = [value, *before][: self.horizon]
        now = value[0]
        said = [c[k] for k, c in enumerate(chunks) if k < len(c)]
        weights = [np.exp(self.alpha * (p @ now) / (np.sqrt(p @ p) * np.sqrt(now @ now) + 1e-7)) for p in said]
        mean = sum(w * p for w, p in zip(weights, said, strict=True)) / sum(weights)
        return ([[float(x) for x in c.ravel()] for c in chunks[: self.horizon - 1]], value.shape[1]), mean.tolist()


def _run(df: DataFrame, make: Any, value: Any, width: Any, out: str, kind: str, episode: str, step: str, time: str, late: str, idle: str) -> DataFrame:
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    rows = df.withWatermark(time, late).select(F.col(episode), F.col(step).cast("long").alias(step), F.col(time).alias("frame_time"), F.unix_micros(time).alias("frame_us"), value.alias("frame_value"), width.cast("int").alias("frame_width"))
    key = rows.schema[episode].dataType.simpleString()
    schema = StructType.fromDDL(f"`{episode}` {key}, `{step}` long, `{out}` {kind}")
    return rows.groupBy(episode).transformWithStateInPandas(make((episode, step, out), idle_ms), schema, "append", "eventTime")


def sticky_stream(df: DataFrame, value: str, time: str, threshold: float = 0.5, repeats: int = 3, episode: str = "episode", step: str = "step", late: str = "10 seconds", idle: str = "1 hour") -> DataFrame:
    """(episode, step, sticky): control.sticky() over a stream."""
    return _run(df, lambda n, i: StickyMachine(n, i, threshold, repeats), F.array(F.col(value).cast("double")), F.lit(0), "sticky", "double", episode, step, time, late, idle)


def _chunks(chunk: str) -> tuple[Any, Any]:
    return F.flatten(F.col(chunk).cast("array<array<double>>")), F.size(F.element_at(chunk, 1))


def replay_stream(df: DataFrame, chunk: str, time: str, size: int, episode: str = "episode", step: str = "step", late: str = "10 seconds", idle: str = "1 hour") -> DataFrame:
    """(episode, step, replay): windows.replayed() over a stream of chunks of vectors."""
    return _run(df, lambda n, i: ReplayMachine(n, i, size), *_chunks(chunk), "replay", "array<double>", episode, step, time, late, idle)


def ensemble_stream(df: DataFrame, chunk: str, time: str, horizon: int, alpha: float, episode: str = "episode", step: str = "step", late: str = "10 seconds", idle: str = "1 hour") -> DataFrame:
    """(episode, step, ensemble): windows.ensemble() over a stream; the state is the last horizon - 1 chunks."""
    return _run(df, lambda n, i: EnsembleMachine(n, i, horizon, alpha), *_chunks(chunk), "ensemble", "array<double>", episode, step, time, late, idle)
