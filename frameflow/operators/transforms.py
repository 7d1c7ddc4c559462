"""Transforms that fit to statistics, apply to frames and can be undone; composed in order, undone in reverse."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameflow.operators.sampling import hash_unit
from frameflow.operators.stats import denormalise, normalise


class Transform(Protocol):
    def apply(self, df: DataFrame, train: bool = True) -> DataFrame: ...


def _each(v: str, low: Sequence[float], high: Sequence[float], f: Callable[[Column, Column, Column], Column]) -> Column:
    pairs = F.array(*(F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for a, b in zip(low, high)))
    return F.zip_with(v, pairs, lambda x, p: f(x, p["a"], p["b"]))


class Normalise:
    """A vector column by the statistics of its dimensions (see stats.normalise for which ones a mode takes)."""

    def __init__(self, column: str, mode: str, low: Sequence[float], high: Sequence[float]):
        self.column, self.mode, self.low, self.high = column, mode, low, high

    def apply(self, df: DataFrame, train: bool = True) -> DataFrame:
        return df.withColumn(self.column, _each(self.column, self.low, self.high, lambda x, a, b: normalise(x, self.mode, a, b)))

    def unapply(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.column, _each(self.column, self.low, self.high, lambda x, a, b: denormalise(x, self.mode, a, b)))


class Concat:
    """Vector columns joined into one, in order, with their widths checked; undone by slices."""

    def __init__(self, columns: dict[str, int], to: str):
        self.columns, self.to = columns, to

    def apply(self, df: DataFrame, train: bool = True) -> DataFrame:
        parts = [F.when(F.size(c) == n, F.col(c)).otherwise(F.raise_error(F.lit(f"{c} is not {n} wide"))) for c, n in self.columns.items()]
        return df.withColumn(self.to, F.concat(*parts)).drop(*self.columns)

    def unapply(self, df: DataFrame) -> DataFrame:
        at = 1
        for c, n in self.columns.items():
            df, at = df.withColumn(c, F.slice(self.to, at, n)), at + n
        return df.drop(self.to)


class Dropout:
    """In training, the whole vector becomes zeros with probability p, by a hash of the row's keys and the seed."""

    def __init__(self, column: str, p: float, keys: Sequence[str], seed: int = 0):
        self.column, self.p, self.keys, self.seed = column, p, keys, seed

    def apply(self, df: DataFrame, train: bool = True) -> DataFrame:
        if not train or self.p <= 0:
            return df
        gone = hash_unit(F.lit(self.seed), *(F.col(k) for k in self.keys)) < self.p
        return df.withColumn(self.column, F.when(gone, F.transform(self.column, lambda x: x * 0)).otherwise(F.col(self.column)))


class Noise:
    """In training, one Gaussian shift per row, kept between the vector's own least and greatest values.

    The shift comes from hashes of the row's keys and the seed (Box-Muller), so that partitioning doesn't change it.
    """

    def __init__(self, column: str, std: float, keys: Sequence[str], seed: int = 0):
        self.column, self.std, self.keys, self.seed = column, std, keys, seed

    def apply(self, df: DataFrame, train: bool = True) -> DataFrame:
        if not train or self.std <= 0:
            return df
        c = self.column
        draw = lambda k: hash_unit(F.lit(self.seed), F.lit(k), *(F.col(x) for x in self.keys))
        normal = F.sqrt(-2 * F.log(1 - draw(0))) * F.cos(2 * math.pi * draw(1))
        noisy = df.withColumn("__n", normal * self.std)
        return noisy.withColumn(c, F.transform(c, lambda x: F.least(F.greatest(x + F.col("__n"), F.array_min(c)), F.array_max(c)))).drop("__n")


class Cast:
    """Casts a vector's elements on the way in, and back to what they were on the way out."""

    def __init__(self, column: str, kind: str):
        self.column, self.kind, self.before = column, kind, None

    def apply(self, df: DataFrame, train: bool = True) -> DataFrame:
        self.before = df.schema[self.column].dataType.simpleString()
        return df.withColumn(self.column, F.col(self.column).cast(f"array<{self.kind}>"))

    def unapply(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.column, F.col(self.column).cast(self.before)) if self.before else df


class Compose:
    """Transforms in order; unapply() goes backwards over those that can be undone. Errors name the step."""

    def __init__(self, *steps: Transform):
        self.steps = steps

    def apply(self, df: DataFrame, train: bool = True) -> DataFrame:
        for k, s in enumerate(self.steps):
            try:
                df = s.apply(df, train)
            except Exception as e:
                raise ValueError(f"transform {k} ({type(s).__name__}): {e}") from e
        return df

    def unapply(self, df: DataFrame) -> DataFrame:
        for s in reversed(self.steps):
            if hasattr(s, "unapply"):
                df = s.unapply(df)
        return df
