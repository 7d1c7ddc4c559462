"""A mixture's sampler: which frame each draw of an epoch names, and which one stands in for a frame that fails.

A draw's seed is the SHA-256 of a text, so draws depend on nothing but epoch, draw and seed and can be made anywhere,
in any order. Frames are reached by a stored index of their places in their datasets; no dataset is sorted as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameflow.operators.sampling import sequential, weighted
from frameflow.operators.stats import weights_for_sampling

_MOST_SETS = 10_000


def seed_digits(draw: Column, epoch: int, seed: int, train: bool = True) -> Column:
    """The 128-bit seed of a draw as 32 hexadecimal digits: in training the lower half of the SHA-256 of the text
    `(epoch, draw, seed)`, else the draw itself."""
    number = draw.cast("long")
    if not train:
        return F.lpad(F.lower(F.hex(number)), 32, "0")
    return F.substring(F.sha2(F.concat(F.lit(f"({epoch}, "), number.cast("string"), F.lit(f", {seed})")), 256), 33, 32)


def remainder(digits: Column, n_digits: int, n: Column) -> Column:
    """The hexadecimal number of `n_digits` digits, a multiple of 4, modulo n < 2^47: long division, 16 bits a step."""
    r = F.lit(0).cast("long")
    for i in range(0, n_digits, 4):
        r = F.pmod(r * 65536 + F.conv(F.substring(digits, i + 1, 4), 16, 10).cast("long"), n)
    return r


def step_index(steps: DataFrame, dataset: str, *keys: str, to: str = "place") -> DataFrame:
    """Adds each step's place in its dataset, 0, 1, ... in the order of the keys; reads a stored table."""
    return sequential(steps, 0, 0, dataset, *keys, shuffle=False, to=to)


def mixture(index: DataFrame, sets: DataFrame, dataset: str, weight: str, balanced: bool = True) -> DataFrame:
    """(dataset, length, share) of a mixture of at most 10,000 datasets, computed once; one without steps is an error."""
    lengths = index.groupBy(F.col(dataset).alias("__d")).agg(F.count(F.lit(1)).alias("length"))
    joined = sets.select(dataset, weight).join(lengths, F.col(dataset) == F.col("__d"), "left").drop("__d")
    checked = joined.withColumn("length", F.when(F.col("length").isNull(), F.raise_error(F.concat(F.lit("no steps in "), F.col(dataset).cast("string"))).cast("long")).otherwise(F.col("length")))
    shares = weights_for_sampling(checked, weight, "length" if balanced else None).select(dataset, "length", "share")
    rows = shares.limit(_MOST_SETS + 1).collect()
    if len(rows) > _MOST_SETS:
        raise ValueError(f"a mixture has at most {_MOST_SETS} datasets")
    return sets.sparkSession.createDataFrame(rows, shares.schema)


def draws(asked: DataFrame, mix: DataFrame, dataset: str, epoch: int, seed: int, train: bool = True, draw: str = "draw") -> DataFrame:
    """(draw, dataset, place): a dataset by its share, then one of its steps, each as likely as the others.

    The upper 48 bits of the seed's hash choose the dataset, the lower 80 the step.
    """
    digits = seed_digits(F.col(draw), epoch, seed, train)
    if not train:  # small numbers differ in the last digits only
        digits = F.substring(F.sha2(digits, 256), 33, 32)
    numbered = asked.select(draw).withColumn("__h", digits)
    unit = F.conv(F.substring("__h", 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    chosen = weighted(numbered.withColumn("__u", unit), "__u", mix, dataset, "share")
    lengths = F.broadcast(mix.select(F.col(dataset).alias("__d"), "length"))  # mixture() has checked its size
    return chosen.join(lengths, F.col(dataset) == F.col("__d")).select(draw, dataset, remainder(F.substring("__h", 13, 20), 20, F.col("length")).alias("place"))


def generator_draws(asked: DataFrame, mix: DataFrame, dataset: str, order: Sequence[object], epoch: int, seed: int, train: bool = True, draw: str = "draw") -> DataFrame:
    """(draw, dataset, place) as numpy's default generator makes them from each draw's 128-bit seed: for samplers whose
    choices have to be met exactly. `order` lists the datasets as the mixture does."""
    found = {r[dataset]: r for r in mix.collect()}  # mixture() has checked its size
    if set(found) != set(order):
        raise ValueError("the order has to name the datasets of the mixture")
    shares = np.array([found[d].share for d in order])
    lengths = [int(found[d].length) for d in order]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, place = np.empty(batch.num_rows, np.int32), np.empty(batch.num_rows, np.int64)
            for i, digits in enumerate(batch.column(1).to_pylist()):
                rng = np.random.default_rng(int(digits, 16))
                number[i] = rng.choice(len(shares), p=shares)
                place[i] = rng.choice(lengths[number[i]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number), pa.array(place)], [draw, "__n", "place"])

    kind = asked.schema[draw].dataType.simpleString()
    made = asked.select(draw, seed_digits(F.col(draw), epoch, seed, train).alias("__h")).mapInArrow(choose, f"`{draw}` {kind}, __n int, place long")
    names = asked.sparkSession.createDataFrame([(i, d) for i, d in enumerate(order)], f"__n int, `{dataset}` {mix.schema[dataset].dataType.simpleString()}")
    return made.join(F.broadcast(names), "__n").select(draw, dataset, "place")


def sampled(made: DataFrame, index: DataFrame, dataset: str, place: str = "place") -> DataFrame:
    """The steps that draws name: draws ⋈ index on (dataset, place)."""
    return made.join(index, [dataset, place])


def next_good(df: DataFrame, draw: str, good: Column, tries: int = 10, strict: bool = False, fail: bool = True, block: int = 1 << 16) -> DataFrame:
    """For each draw the first row, from its own on, that is good: its columns, and `taken`, the draw it belongs to.

    Draws are numbered 0..n-1 and go around at the end; a missing number counts as one that failed. At most `tries` rows
    are looked at, in strict mode the draw's own alone. If none is good that is an error, or with fail=False a row of
    nulls. Blocks of draws overlap by tries - 1 rows, so each is searched by itself.
    """
    tries = 1 if strict else max(1, tries)
    block = max(block, tries)
    n = (df.agg(F.max(draw)).first()[0] if df.columns else None) or 0
    n += 1
    tries = min(tries, n)
    d = F.col(draw).cast("long")
    rest = [c for c in df.columns if c != draw]
    rows = df.select(d.alias("__d"), F.coalesce(good, F.lit(False)).alias("__ok"), F.struct(d.alias("taken"), *rest).alias("__row"))
    at = F.col("__d")
    own = rows.withColumn("__k", F.floor(at / block))
    again = rows.where(at < tries - 1).withColumn("__d", at + n)  # the first ones once more, behind the last
    ahead = rows.unionByName(again).withColumn("__k", F.floor((F.col("__d") - (tries - 1)) / block)).where((F.col("__k") >= 0) & (F.col("__k") < F.floor(F.col("__d") / block)) | (F.col("__d") >= n))
    last = (n - 1) // block
    ahead = ahead.withColumn("__k", F.when(F.col("__d") >= n, F.lit(last).cast("long")).otherwise(F.col("__k").cast("long")))
    both = own.withColumn("__k", F.col("__k").cast("long")).withColumn("__own", F.lit(True)).unionByName(ahead.withColumn("__own", F.lit(False)))
    w = Window.partitionBy("__k").orderBy("__d").rangeBetween(0, tries - 1)
    found = both.withColumn("__f", F.first(F.when(F.col("__ok"), F.col("__row")), ignorenulls=True).over(w)).where("__own")
    if fail:
        message = F.concat(F.lit(f"no good sample in {tries} from draw "), F.col("__d").cast("string"))
        found = found.withColumn("__f", F.when(F.col("__f").isNull(), F.raise_error(message).cast(found.schema["__f"].dataType)).otherwise(F.col("__f")))
    return found.select(F.col("__d").alias(draw), "__f.*")
