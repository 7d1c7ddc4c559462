"""Data gates: contiguity, bounds, totals and referential checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameflow.operators.sampling import positions


def contiguity(df: DataFrame, episode: str = "episode", step: str = "step") -> DataFrame:
    """Per episode: n, bounds, and whether its steps are 0..n-1 by the closed forms of their sum and sum of squares."""
    s = F.col(step).cast("decimal(38,0)")
    g = df.groupBy(episode).agg(F.count(F.lit(1)).alias("n"), F.min(step).alias("first"), F.max(step).alias("last"), F.sum(s).alias("__s"), F.sum(s * s).alias("__q"))
    n = F.col("n").cast("decimal(20,0)")
    fine = (F.col("first") == 0) & (F.col("last") == F.col("n") - 1) & (2 * F.col("__s") == n * (n - 1)) & (6 * F.col("__q") == n * (n - 1) * (2 * n - 1))
    return g.withColumn("contiguous", fine).drop("__s", "__q")


def bundle(df: DataFrame, x: str, y: str, keyframe: Column, episode: str = "episode") -> DataFrame:
    """One row: rows, episodes, keyframes, null coordinates and bounds; two steps, so no key has to be held distinct twice."""
    g = df.groupBy(episode).agg(F.count(F.lit(1)).alias("n"), F.sum(keyframe.cast("long")).alias("k"), F.sum(F.col(x).isNull().cast("long")).alias("z"), F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    return g.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_episodes"), F.sum("k").alias("n_keyframes"), F.sum("z").alias("n_null"), F.min("x0").alias("min_x"), F.max("x1").alias("max_x"), F.min("y0").alias("min_y"), F.max("y1").alias("max_y"))


def upper_median(df: DataFrame, value: str) -> DataFrame:
    """The element at n div 2 of the sorted values."""
    return positions(df.select(value), value, to="__i").where(F.col("__i") == df.count() // 2).select(F.col(value).alias("upper_median"))


def missing_ids(df: DataFrame, key: str, total: int) -> DataFrame:
    """Ids of 0..total-1 that the column lacks."""
    return df.sparkSession.range(total).select(F.col("id").alias(key)).join(df.select(key).distinct(), key, "left_anti")


def same_settings(configs: DataFrame, tag: str, dataset: str, *settings: str) -> DataFrame:
    """Per tag: n_datasets, consistent (every setting is the same for all of them, null counting as a value), and the
    settings that differ, in the order given."""
    differs = [F.count_distinct(F.to_json(F.struct(c))) > 1 for c in settings]
    g = configs.groupBy(tag).agg(F.count_distinct(dataset).alias("n_datasets"), F.filter(F.array(*(F.when(d, F.lit(c)) for d, c in zip(differs, settings, strict=True))), lambda x: x.isNotNull()).alias("differing"))
    return g.withColumn("consistent", F.size("differing") == 0)


def gate(df: DataFrame, check: Column, message: str) -> DataFrame:
    """df as it is; a row for which the check does not hold stops the job."""
    return df.withColumn("__ok", F.assert_true(check, F.lit(message))).where(F.col("__ok").isNull()).drop("__ok")
