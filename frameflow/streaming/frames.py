"""Streams of frames: statistics by event time, and trailing windows with state per episode."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_stats(df: DataFrame, value: str, time: str, every: str, late: str, *keys: str) -> DataFrame:
    """n, mean, population std, min and max per time window and keys; rows later than `late` don't count."""
    w = df.withWatermark(time, late).groupBy(F.window(time, every).alias("w"), *keys)
    g = w.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    return g.select(F.col("w.start").alias("start"), *keys, "n", "mean", "std", "min", "max")


def streaming_trailing(df: DataFrame, x: str, y: str, size: int = 12, episode: str = "episode", step: str = "step") -> DataFrame:
    """(episode, step, xs, ys): the last `size` points at each step, padded on the left with the episode's first.

    State per episode: at most `size` points. Steps have to arrive in order of micro-batches.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(step)
        xs, ys = (list(v) for v in state.get) if state.exists else ([], [])
        out = []
        for s, a, b in zip(rows[step], rows[x], rows[y]):
            xs, ys = ([a] * size, [b] * size) if not xs else (xs[1:] + [a], ys[1:] + [b])
            out.append((key[0], s, list(xs), list(ys)))
        state.update((xs, ys))
        yield pd.DataFrame(out, columns=[episode, step, "xs", "ys"])

    schema = f"{episode} long, {step} long, xs array<double>, ys array<double>"
    return df.groupBy(episode).applyInPandasWithState(run, schema, "xs array<double>, ys array<double>", "append", GroupStateTimeout.NoTimeout)
