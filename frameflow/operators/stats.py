"""Statistics of vector columns, their merging over populations and mixtures, and normalisation by them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(v: str | Column) -> Column:
    """True if every dimension of the vector is a finite number."""
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def long_form(df: DataFrame, vector: str, *keys: str) -> DataFrame:
    """(keys, dim, v): one row per dimension."""
    return df.select(*keys, F.posexplode(vector).alias("dim", "v")).withColumn("v", F.col("v").cast("double"))


def vector_stats(df: DataFrame, vector: str, *keys: str, low: float = 0.01, high: float = 0.99, one_pass: int = 1_000_000) -> DataFrame:
    """Per key and dimension: n, mean, population std, min, max and linearly interpolated quantiles.

    An exact quantile in one pass holds a count for each distinct value. Tables of more than `one_pass` rows get theirs
    by quantiles(), which gives the same ones and holds a sketch.
    """
    long = long_form(df, vector, *keys)
    plain = [F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max")]
    if df.count() <= one_pass:
        return long.groupBy(*keys, "dim").agg(*plain, F.percentile("v", F.lit(low)).alias("q_low"), F.percentile("v", F.lit(high)).alias("q_high"))
    found = quantiles(long, [low, high], *keys, "dim").select(*keys, "dim", F.col("q")[0].alias("q_low"), F.col("q")[1].alias("q_high"))
    g = long.groupBy(*keys, "dim").agg(*plain).alias("g")
    f = found.alias("f")
    same = [F.col(f"g.{k}").eqNullSafe(F.col(f"f.{k}")) for k in (*keys, "dim")]
    return g.join(f, same).select("g.*", "f.q_low", "f.q_high")


def quantiles(long: DataFrame, shares: Sequence[float], *keys: str, accuracy: int = 10_000) -> DataFrame:
    """(keys, q): exact, linearly interpolated quantiles of v per key, in the order of shares, without a group in memory.

    A sketch brackets each quantile; then what lies below a bracket is counted, and only values inside are told apart
    and summed up in order: some 4 / accuracy of the rows. What comes next below and above a bracket stands by.
    """
    n = len(shares)
    around = [x for q in shares for x in (max(0.0, q - 2 / accuracy), min(1.0, q + 2 / accuracy))]
    sketch = long.where("v is not null").groupBy(*keys).agg(F.percentile_approx("v", around, accuracy).alias("__b"), F.count("v").alias("__n"))
    named = sketch.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), "__b", "__n")
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    rows = long.where("v is not null").join(named, same)
    lo, hi = (lambda i: F.col("__b")[2 * i]), (lambda i: F.col("__b")[2 * i + 1])
    sides = rows.groupBy(*keys).agg(F.first("__n").alias("__n"), *(F.count_if(F.col("v") < lo(i)).alias(f"__below{i}") for i in range(n)), *(F.max(F.when(F.col("v") < lo(i), F.col("v"))).alias(f"__under{i}") for i in range(n)), *(F.min(F.when(F.col("v") > hi(i), F.col("v"))).alias(f"__above{i}") for i in range(n)))
    inside = F.filter(F.array(*(F.when((F.col("v") >= lo(i)) & (F.col("v") <= hi(i)), F.lit(i)) for i in range(n))), lambda i: i.isNotNull())
    counted = rows.select(*keys, "v", F.explode(inside).alias("__i")).groupBy(*keys, "__i", "v").agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy(*keys, "__i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    upto = counted.withColumn("__upto", F.sum("__c").over(w))
    s = sides.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), *(c for c in sides.columns if c not in keys))
    met = upto.join(s, same)
    pick = lambda name: F.array(*(F.col(f"__{name}{i}") for i in range(n)))[F.col("__i")]
    share = F.array(*map(F.lit, shares))[F.col("__i")]
    at = share * (F.col("__n") - 1)
    rank = F.floor(at)
    ranked = met.select(*keys, "__i", "v", (F.col("__upto") + pick("below")).alias("__upto"), rank.alias("__r"), (at - rank).alias("__f"), F.when(rank < pick("below"), pick("under")).alias("__under"), pick("above").alias("__above"))
    ends = ranked.groupBy(*keys, "__i").agg(F.min(F.when(F.col("__upto") > F.col("__r"), F.col("v"))).alias("__x"), F.min(F.when(F.col("__upto") > F.col("__r") + 1, F.col("v"))).alias("__y"), F.first("__under").alias("__under"), F.first("__above").alias("__above"), F.first("__f").alias("__f"))
    first, second = F.coalesce("__under", "__x"), F.coalesce("__y", "__above")
    value = F.when(F.col("__f") == 0, first).otherwise(first + (second - first) * F.col("__f"))
    return ends.select(*keys, "__i", value.alias("__q")).groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("__i", "__q"))), lambda r: r["__q"]).alias("q"))


def as_arrays(stats: DataFrame, *names: str, most: int = 65_536) -> dict[str, Column]:
    """Literal arrays over dimensions of some statistics, one row per dimension, for use beside a vector."""
    rows = stats.select("dim", *names).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a vector has at most {most} dimensions")
    rows.sort(key=lambda r: r.dim)
    return {n: F.array(*(F.lit(r[n]) for r in rows)) for n in names}


def beside(df: DataFrame, vector: str, stats: dict[str, Column], *keys: str) -> DataFrame:
    """(keys, dim, v, and the statistics of the dimension): no join, each vector meets the arrays of as_arrays()."""
    zipped = F.arrays_zip(F.col(vector).alias("v"), *(c.alias(n) for n, c in stats.items()))
    return df.select(*keys, F.posexplode(zipped).alias("dim", "__p")).select(*keys, "dim", "__p.*")


def sums(df: DataFrame, vector: str, *keys: str) -> DataFrame:
    """Mergeable partials: n, total, squares, min, max."""
    return long_form(df, vector, *keys).groupBy(*keys, "dim").agg(F.count("v").alias("n"), F.sum("v").alias("total"), F.sum(F.col("v") * F.col("v")).alias("squares"), F.min("v").alias("min"), F.max("v").alias("max"))


def merged(partials: DataFrame, *keys: str) -> DataFrame:
    """Statistics from partials of sums(): the same as from all rows at once; variance is never below 0."""
    g = partials.groupBy(*keys, "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.min("min").alias("min"), F.max("max").alias("max"))
    mean = F.when(F.col("n") > 0, F.col("total") / F.col("n")).otherwise(0.0)
    var = F.when(F.col("n") > 0, F.col("squares") / F.col("n")).otherwise(0.0) - mean * mean
    return g.select(*keys, "dim", "n", mean.alias("mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("std"), "min", "max")


def merge_two(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Joins statistics (keys, n, mean, std, min, max) of two populations by within and between variance."""
    j = a.alias("a").join(b.alias("b"), list(keys), "full_outer")
    n1, n2 = F.coalesce("a.n", F.lit(0)), F.coalesce("b.n", F.lit(0))
    n = n1 + n2
    m1, m2 = F.coalesce("a.mean", F.lit(0.0)), F.coalesce("b.mean", F.lit(0.0))
    mean = (n1 * m1 + n2 * m2) / n
    part = lambda k, m, s: k * (F.pow(F.coalesce(s, F.lit(0.0)), 2) + F.pow(m - mean, 2))
    var = (part(n1, m1, F.col("a.std")) + part(n2, m2, F.col("b.std"))) / n
    return j.select(*keys, n.alias("n"), mean.alias("mean"), F.sqrt(var).alias("std"), F.least("a.min", "b.min").alias("min"), F.greatest("a.max", "b.max").alias("max"))


def mixture(stats: DataFrame, weight: str, *keys: str, quantiles: str = "min_max") -> DataFrame:
    """Statistics of a weighted mixture, weights made to add up to 1 within the keys.

    Quantiles are the extremes of the parts' (`min_max`) or their weighted average (`weighted_average`).
    """
    if quantiles not in ("min_max", "weighted_average"):
        raise ValueError(f"unknown quantile rule {quantiles!r}")
    w = F.col(weight) / F.sum(weight).over(Window.partitionBy(*keys))
    s = stats.withColumn("__w", w)
    g = s.groupBy(*keys).agg(
        F.sum(F.col("__w") * F.col("mean")).alias("mean"),
        F.sum(F.col("__w") * (F.pow("std", F.lit(2)) + F.pow("mean", F.lit(2)))).alias("__second"),
        F.min("min").alias("min"), F.max("max").alias("max"),
        (F.min("q_low") if quantiles == "min_max" else F.sum(F.col("__w") * F.col("q_low"))).alias("q_low"),
        (F.max("q_high") if quantiles == "min_max" else F.sum(F.col("__w") * F.col("q_high"))).alias("q_high"),
    )
    return g.select(*keys, "mean", F.sqrt(F.greatest(F.col("__second") - F.pow("mean", F.lit(2)), F.lit(0.0))).alias("std"), "min", "max", "q_low", "q_high")


def normalise(x: Column, mode: str, low: Column | None = None, high: Column | None = None) -> Column:
    """One value by statistics. low and high: q_low and q_high (`q99`), mean and std (`mean_std`), min and max otherwise."""
    if mode == "q99":
        scaled = F.when(high == low, x).otherwise(2 * (x - low) / F.nullif(high - low, F.lit(0.0)) - 1)
        return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), scaled))
    if mode == "mean_std":
        return F.when(high == 0, x).otherwise((x - low) / F.nullif(high, F.lit(0.0)))
    if mode == "min_max":
        return F.when(high == low, F.lit(0.0)).otherwise(2 * (x - low) / F.nullif(high - low, F.lit(0.0)) - 1)
    if mode == "scale":
        most = F.greatest(F.abs(low), F.abs(high))
        return F.when(most == 0, F.lit(0.0)).otherwise(x / F.nullif(most, F.lit(0.0)))
    if mode == "binary":
        return (x > 0.5).cast("double")
    raise ValueError(f"unknown mode {mode!r}")


def denormalise(x: Column, mode: str, low: Column | None = None, high: Column | None = None) -> Column:
    """The inverse of normalise(), where it has one."""
    if mode in ("q99", "min_max"):
        return (x + 1) / 2 * (high - low) + low
    if mode == "mean_std":
        return x * high + low
    if mode == "binary":
        return (x > 0.5).cast("double")
    raise ValueError(f"{mode!r} has no inverse")


def masked_normalise(x: Column, low: Column, high: Column, mask: Column) -> Column:
    """`q99` with clamp where the mask holds and the range isn't empty, else whether the value is over a half."""
    return F.when(mask & (low != high), normalise(x, "q99", low, high)).otherwise((x > 0.5).cast("double"))


def policy_denormalise(x: Column, dim: Column, low: Column, high: Column, mask: Column, grip_dim: int = 6) -> Column:
    """A policy's output: clipped to -1..1, the gripper's dimension made 0 or 1, masked ones scaled back."""
    clipped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))
    value = F.when(dim == grip_dim, (clipped >= 0.5).cast("double")).otherwise(clipped)
    return F.when(mask, denormalise(value, "min_max", low, high)).otherwise(value)


def sincos(v: str | Column) -> Column:
    return F.concat(F.transform(v, F.sin), F.transform(v, F.cos))


def nearest_code(df: DataFrame, vector: str, codes: DataFrame, key: str, most: int = 4096) -> DataFrame:
    """Adds code and distance: the least squared distance to the rows (code, centre) of a bounded code book, the first of
    equals; null for a null vector. The book is sent to the tasks once, and batches of vectors meet it as matrices."""
    rows = codes.select("code", "centre").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a code book has at most {most} codes")
    rows.sort(key=lambda r: r.code)
    shared = df.sparkSession.sparkContext.broadcast((np.array([r.code for r in rows], np.int64), np.array([r.centre for r in rows], np.float64)))

    @F.pandas_udf("code long, distance double")
    def find(vectors: pd.Series) -> pd.DataFrame:
        names, book = shared.value
        out = pd.DataFrame({"code": pd.array([None] * len(vectors), "Int64"), "distance": np.full(len(vectors), np.nan)})
        known = np.flatnonzero(vectors.notna().to_numpy())
        step = max(1, (1 << 21) // max(1, book.size))
        for at in range(0, len(known), step):
            here = known[at : at + step]
            x = np.stack(vectors.iloc[here].to_list()).astype(np.float64)
            d = ((x[:, None, :] - book[None]) ** 2).sum(2)
            best = d.argmin(1)
            out.loc[here, "code"] = names[best]
            out.loc[here, "distance"] = d[np.arange(len(here)), best]
        return out

    found = df.withColumn("__c", find(F.col(vector).cast("array<double>")))
    return found.withColumn("code", F.col("__c.code")).withColumn("distance", F.when(F.col("__c.code").isNotNull(), F.col("__c.distance"))).drop("__c")


def weights_for_sampling(df: DataFrame, base: str, length: str | None = None) -> DataFrame:
    """Adds share: base (times length), at least 1e-8, over the sum of all; uniform if the sum is no positive number."""
    raw = F.col(base) * (F.col(length) if length else F.lit(1.0))
    safe = F.when(raw > 0, raw).otherwise(F.lit(1e-8))
    everywhere = Window.partitionBy(F.lit(0))
    total = F.sum(safe).over(everywhere)
    return df.withColumn("share", F.when((total > 0) & ~F.isnan(total), safe / total).otherwise(1.0 / F.count(F.lit(1)).over(everywhere)))


def perplexity(df: DataFrame, code: str, *keys: str) -> DataFrame:
    """Per key: used codes, entropy in nats and perplexity."""
    n = df.groupBy(*keys, code).agg(F.count(F.lit(1)).alias("c"))
    g = n.groupBy(*keys) if keys else n.groupBy()
    # -sum(p ln p) = ln N - sum(c ln c) / N
    out = g.agg(F.count(F.lit(1)).alias("used"), F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("__s"))
    h = F.log("n") - F.col("__s") / F.col("n")
    return out.select(*keys, "used", "n", h.alias("entropy"), F.exp(h).alias("perplexity"))


def exported(stats: DataFrame, tag: str, last: Sequence[int] = ()) -> DataFrame:
    """Per tag, arrays over dimensions in order, with dimensions of `last` at the end and a mask that is false for them."""
    is_last = F.col("dim").isin(list(last)) if last else F.lit(False)
    row = F.struct(is_last.alias("l"), F.col("dim").alias("d"), *(F.col(c) for c in ("mean", "std", "min", "max", "q_low", "q_high")))
    g = stats.groupBy(tag).agg(F.sort_array(F.collect_list(row)).alias("r"))
    pick = lambda c: F.transform("r", lambda r: r[c])
    return g.select(tag, *(pick(c).alias(c) for c in ("mean", "std", "min", "max", "q_low", "q_high")), F.transform("r", lambda r: ~r["l"]).alias("mask"))
