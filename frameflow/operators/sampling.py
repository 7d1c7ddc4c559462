"""Deterministic draws, splits and deals. Randomness comes from SHA-256 of keys, so every engine and rerun agrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameflow.operators.stats import weights_for_sampling
from frameflow.tables import stored

def hash_unit(*parts: Column) -> Column:
    """A number in [0, 1) from the SHA-256 of the parts joined by `:`; 48 bits."""
    digest = F.sha2(F.concat_ws(":", *(p.cast("string") for p in parts)), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def hash_number(n: Column | int, *parts: Column) -> Column:
    """A number in 0..n-1 from the same hash."""
    digest = F.sha2(F.concat_ws(":", *(p.cast("string") for p in parts)), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), n if isinstance(n, Column) else F.lit(n))


def by_rate(df: DataFrame, rate: float, *keys: str) -> DataFrame:
    """floor(rows * rate) rows, those with the least hashes of their keys, equal ones by the keys.

    A histogram of the hashes' first four digits tells which kept rows need no comparison; only those of the one digit
    group in which the cut falls are sorted.
    """
    hashed = df.withColumn("__h", F.sha2(F.concat_ws(":", *(F.col(k).cast("string") for k in keys)), 256)).withColumn("__p", F.substring("__h", 1, 4))
    counts = sorted((r["__p"], r["count"]) for r in hashed.groupBy("__p").count().collect())  # at most 65,536 rows
    left = int(sum(n for _, n in counts) * rate)
    for prefix, n in counts:
        if n > left:
            break
        left -= n
    else:
        return df
    cut = hashed.where(F.col("__p") == prefix).orderBy("__h", *keys).limit(left)
    return hashed.where(F.col("__p") < prefix).unionByName(cut).drop("__h", "__p")


def weighted(draws: DataFrame, unit: str, weights: DataFrame, name: str, weight: str, slots: int = 4096) -> DataFrame:
    """For each draw the name whose stretch of the cumulative weights its unit number falls into.

    weights has one row per dataset of a mixture, 10,000 at most. Stretches are joined by the slots of the unit line
    that they touch.
    """
    w = Window.orderBy(name).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(weight).over(Window.partitionBy(F.lit(0)))
    ends = weights.where(F.col(weight) > 0).select(name, (F.sum(weight).over(w) / total).alias("hi"))
    ranges = ends.withColumn("lo", F.lag("hi", 1, 0.0).over(Window.orderBy(name)))  # neighbours meet in the same number
    if ranges.limit(10_001).count() > 10_000:
        raise ValueError("a mixture has at most 10,000 datasets")
    slot = lambda c: F.floor(c * slots).cast("int")
    spread = ranges.withColumn("__slot", F.explode(F.sequence(slot(F.col("lo")), slot(F.col("hi")))))
    met = draws.withColumn("__slot", slot(F.col(unit))).join(F.broadcast(spread), "__slot")
    return met.where((F.col(unit) >= F.col("lo")) & (F.col(unit) < F.col("hi"))).drop("lo", "hi", "__slot")


def strided(df: DataFrame, stride: int, cap: int | None = None, group: str = "episode", step: str = "step", order: tuple[str, ...] = ("episode", "step")) -> DataFrame:
    """Every stride-th step; of each group at most `cap` rows in order."""
    out = df.where(F.col(step) % stride == 0)
    if cap is not None:
        out = out.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(f"__r <= {int(cap)}").drop("__r")
    return out


def ordered(df: DataFrame, *order: str) -> DataFrame:
    """df as a stored table with __range, numbers of ranges of a global order, and __place, the place in the range from 0.

    One shuffle by range, of which Spark draws the bounds and adaptive execution the number, and one evaluation of df:
    whatever is counted afterwards is counted on what was written. Equal keys are told apart by a hash of the whole row,
    so no range is large for a frequent key, unless rows are repeated as a whole. Nulls come first.
    """
    tie = F.xxhash64(*(f.name for f in df.schema if "map<" not in f.dataType.simpleString()))
    keyed = df.withColumn("__tie", tie).repartitionByRange(*order, "__tie").sortWithinPartitions(*order, "__tie").drop("__tie")
    place = F.monotonically_increasing_id()  # the task in the upper bits, the row of the task below
    return stored(keyed.withColumn("__row", place).select(*df.columns, F.shiftright("__row", 33).cast("int").alias("__range"), F.col("__row").bitwiseAND(F.lit((1 << 33) - 1)).alias("__place")), "ordered")


def _started(held: DataFrame, amount: Column) -> DataFrame:
    """held with __start, the sum of `amount` over the ranges before a row's own; a row a range goes to the driver."""
    start, before = 0, []
    for r in held.groupBy("__range").agg(F.sum(amount).alias("s")).orderBy("__range").collect():
        before.append((r["__range"], start))
        start += r.s or 0
    kind = held.select(F.sum(amount)).schema[0].dataType.simpleString()
    return held.join(F.broadcast(held.sparkSession.createDataFrame(before, f"__range int, __start {kind}")), "__range")


def running(df: DataFrame, amount: Column, *order: str, to: str) -> DataFrame:
    """Adds the sum of `amount` over all rows before this one in a global order, without one task for all rows.

    Rows that are equal in the order come in any order, each once. The result reads a stored table.
    """
    held = _started(ordered(df.withColumn("__a", amount), *order), F.col("__a"))
    w = Window.partitionBy("__range").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)
    return held.withColumn(to, F.col("__start") + F.coalesce(F.sum("__a").over(w), F.lit(0))).select(*df.columns, to)


def positions(df: DataFrame, *order: str, to: str = "pos") -> DataFrame:
    """Numbers rows 0, 1, ... in a global order without one task for all rows. The result reads a stored table."""
    return _started(ordered(df, *order), F.lit(1)).select(*df.columns, (F.col("__start") + F.col("__place")).alias(to))


def nodes(df: DataFrame, k: int, *order: str, to: str = "node") -> DataFrame:
    """Deals rows in a global order to k nodes in stretches of one length, the first ones longer by a row if need be."""
    n = df.count()
    least, more = divmod(n, k)
    head = more * (least + 1)
    pos = F.col("__n")
    node = F.when(pos < head, F.expr(f"__n div {least + 1}")).otherwise(more + F.expr(f"(__n - {head}) div {max(1, least)}"))
    return positions(df, *order, to="__n").withColumn(to, node.cast("long")).drop("__n")


def held_out(df: DataFrame, stride: int, *order: str) -> DataFrame:
    """Adds split: eval for each stride-th row in global order, else train."""
    return positions(df, *order).withColumn("split", F.when(F.col("pos") % stride == 0, "eval").otherwise("train"))


def spread_positions(n: Column, k: int, to_last: bool = True) -> Column:
    """k distinct positions from 0 to n-1, evenly spaced, halves to even."""
    if k == 1:
        return F.array(F.lit(0).cast("long"))
    return F.array_sort(F.array_distinct(F.transform(F.array(*(F.lit(i) for i in range(k))), lambda i: F.rint(i * (n - 1) / F.lit(float(k - 1))).cast("long"))))


def frame_budget(duration: Column, frames: Column, interval: float, least: int, most: int) -> Column:
    """Distinct frame numbers, evenly spaced and cut to integers, for one frame each `interval` seconds within bounds."""
    want = F.greatest(F.lit(least), F.least(F.lit(most), F.rint(duration / F.lit(interval)).cast("int")))
    spots = F.transform(F.sequence(F.lit(0), want - 1), lambda i: F.when(want > 1, F.floor(i * (frames - 1) / F.greatest(want - 1, F.lit(1)))).otherwise(0).cast("long"))
    return F.array_distinct(spots)


def sequential(steps: DataFrame, epoch: int, seed: int, dataset: str, *keys: str, shuffle: bool = True, to: str = "place") -> DataFrame:
    """Adds each step's place in its dataset's order for an epoch: shuffled anew by epoch and seed, or as it is.

    Steps are numbered in one global order by dataset and hash, from which each dataset's first number is taken, so a
    dataset's steps are sorted by as many tasks as it needs.
    """
    mixed = F.sha2(F.concat_ws(":", F.lit(str(epoch)), F.lit(str(seed)), *(F.col(k).cast("string") for k in (dataset, *keys))), 256)
    placed = positions(steps.withColumn("__h", mixed if shuffle else F.lit("")), dataset, "__h", *keys, to="__n")
    first = placed.groupBy(F.col(dataset).alias("__d")).agg(F.min("__n").alias("__first"))
    return placed.join(first, placed[dataset].eqNullSafe(first["__d"])).select(*steps.columns, (F.col("__n") - F.col("__first")).alias(to))


def stratified(lengths: DataFrame, key: str, length: str, k: int, seed: int, share: float = 0.7) -> DataFrame:
    """k keys: `share` of them evenly spaced over their order, the others drawn from the shortest tenth, the middle and
    the longest tenth, and what overlaps cost made up for by further draws. All if there are no more than k."""
    n = lengths.count()
    if n <= k:
        return lengths.select(key)
    even = int(k * share)
    spots = sorted({int(i * (n - 1) / max(1, even - 1)) for i in range(even)})
    each, tenth, twentieth = max(1, (k - even) // 3), n // 10, n // 20
    draw = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)
    placed = positions(positions(lengths.select(key, length), key, to="__i"), length, key, to="__l").withColumn("__h", draw)
    bucket = F.when(F.col("__l") < tenth, 0).when((F.col("__l") >= n // 2 - twentieth) & (F.col("__l") < n // 2 + twentieth), 1).when(F.col("__l") >= n - tenth, 2)
    ranked = placed.withColumn("__b", bucket).withColumn("__r", F.when(F.col("__b").isNotNull(), F.row_number().over(Window.partitionBy("__b", F.when(F.col("__b").isNull(), F.col("__i"))).orderBy("__h"))))
    first = F.when(F.col("__i").isin(spots) | (F.coalesce("__r", F.lit(each + 1)) <= each), 0).otherwise(1)
    return ranked.withColumn("__f", first).orderBy("__f", F.when(F.col("__f") == 1, F.col("__h")), key).limit(k).select(key)


def epoch_length(sets: DataFrame, length: str, weight: str, balanced: bool = True) -> int:
    """Steps of an epoch of a mixture: the greatest length over share of its primary datasets, cut to an integer.

    A share is the dataset's part of all draws (stats.weights_for_sampling), by weight times length if balanced, else
    by weight. Primary are datasets of weight 1, or if there are none of the greatest weight. Without a primary one of
    a positive length and share the greatest such length counts, and without any of these there are 0.
    """
    most = F.max(weight).over(Window.partitionBy(F.lit(0)))
    any_one = F.max((F.col(weight) == 1).cast("int")).over(Window.partitionBy(F.lit(0))) == 1
    primary = F.when(any_one, F.col(weight) == 1).otherwise(F.col(weight) == most)
    shares = weights_for_sampling(sets.withColumn("__p", primary), weight, length if balanced else None)
    fine = (F.col(length) > 0) & ~F.isnan(F.col(length).cast("double")) & (F.col("share") > 0)
    row = shares.where(fine).agg(F.max(F.when(F.col("__p"), F.col(length) / F.col("share"))).alias("a"), F.max(length).alias("b")).first()
    return int(row.a if row.a is not None else row.b or 0)
