"""Layout of output files: packing by size, chunk numbers, manifests."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from frameflow.operators.sampling import ordered
from frameflow.tables import discard, stored


def _next_starts(size: np.ndarray, first: np.ndarray, limit: int, before: bool, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For items of one range: the total ahead of each, the total that has to reach a limit for it to start a file, and
    which item starts the next file if it starts one (the number of items if none here does).

    first: items that start a file anyway, as they are the first of their group.
    """
    total = start + np.cumsum(size)
    ahead = total - size
    reached = total if before else ahead
    n = len(size)
    forced = np.append(np.flatnonzero(first), n)
    after = forced[np.searchsorted(forced, np.arange(n), side="right")]
    return ahead, reached, np.minimum(after, np.maximum(np.arange(1, n + 1), np.searchsorted(reached, ahead + limit)))


def _last_starts(follow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item, if it starts a file: the last start of the range, and how many starts there are; by doubling."""
    n = len(follow)
    hop = np.append(follow, n)
    count = np.append(np.ones(n, np.int64), 0)
    last = np.append(np.arange(n), -1)
    while (hop != n).any():
        count = count + count[hop]
        last = np.where(last[hop] >= 0, last[hop], last)
        hop = hop[hop]
    return last[:n], count[:n]


def bin_pack(df: DataFrame, size: str, order: str, limit: float, before: bool = False, group: str | None = None) -> DataFrame:
    """Adds file, the number of the file that each item goes to, in order, from 0 in each group.

    A file is closed after the item that brings it to the limit, or with `before` ahead of an item that would bring it
    there. Whole numbers are summed as they are, others in millionths; null counts as 0, a negative size is an error.

    Where a file ends depends on where it began, and so on all files before. But with totals of a global order at hand,
    the item that starts the next file after a given one is found by binary search. Each range of the order finds, in
    its own task, for each of its items where the files end up if that item starts one; what enters a range is then
    one look-up per range in that stored table, and each range numbers its files from there. No task holds more than
    one range, and the driver a row for each.
    """
    whole = df.schema[size].dataType.typeName() in ("byte", "short", "integer", "long")
    units = F.col(size).cast("long") if whole else F.round(F.col(size).cast("double") * 1_000_000).cast("long")
    most = int(np.ceil(limit)) if whole else round(limit * 1_000_000)
    if most <= 0:
        raise ValueError("the limit has to be positive")
    units = F.coalesce(units, F.lit(0))
    units = F.when(units < 0, F.raise_error(F.lit("a size is negative")).cast("long")).otherwise(units)
    keys = [order] if group is None else [group, order]
    held = ordered(df.withColumn("__s", units), *keys)
    ends = {r["__range"]: r for r in held.groupBy("__range").agg(F.sum("__s").alias("s"), F.min_by(F.struct(*keys), "__place").alias("a"), F.max_by(F.struct(*keys), "__place").alias("z")).collect()}
    rows, start, group_before = [], 0, None
    for r in sorted(ends):
        own = ends[r].a[group] if group else 0
        rows.append((r, start, group_before != (own,)))
        start, group_before = start + ends[r].s, (ends[r].z[group] if group else 0,)
    spark = df.sparkSession
    fixed = F.broadcast(spark.createDataFrame(rows, "__range int, __start long, __new boolean"))
    w = Window.partitionBy("__range").orderBy("__place")
    changed = ~F.col(group).eqNullSafe(F.lag(group).over(w)) if group else F.lit(False)
    marked = held.join(fixed, "__range").withColumn("__first", F.when(F.col("__place") == 0, F.col("__new")).otherwise(changed))

    def arrays(t: pa.Table) -> tuple[pa.Table, tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        t = t.sort_by("__place")
        first = t.column("__first").to_numpy()
        return t, _next_starts(t.column("__s").to_numpy(), first, most, before, t.column("__start")[0].as_py()), first

    def outcomes(t: pa.Table) -> pa.Table:
        t, (ahead, reached, follow), first = arrays(t)
        last, count = _last_starts(follow)
        return pa.table({"__range": t.column("__range"), "__place": t.column("__place"), "reached": reached, "left": ahead[last], "files": count, "first": first})

    def numbered(t: pa.Table) -> pa.Table:
        t, (_, reached, follow), first = arrays(t)
        n, open_at, number = len(reached), t.column("__open")[0].as_py(), t.column("__number")[0].as_py()
        at = 0 if first[0] else min(int(np.searchsorted(reached, open_at + most)), int(np.append(np.flatnonzero(first), n)[0]))
        starts = []
        while at < n:
            starts.append(at)
            at = int(follow[at])
        step = np.zeros(n, np.int64)
        step[starts] = 1
        files = number + np.cumsum(step)
        if (forced := np.flatnonzero(first)).size:  # numbers begin anew with a group
            own = np.searchsorted(forced, np.arange(n), side="right") - 1
            files = np.where(own < 0, files, files - files[forced[np.maximum(own, 0)]])
        return t.select(columns).append_column("file", pa.array(files))

    columns = df.columns
    short = marked.select("__range", "__place", "__s", "__start", "__first")
    found = stored(short.groupBy("__range").applyInArrow(outcomes, "__range int, __place long, reached long, left long, files long, first boolean"), "outcomes")
    told = found.groupBy("__range").agg(F.max("reached").alias("reached"), F.max_by(F.struct("left", "files"), F.when(F.col("first"), F.col("__place"))).alias("anew"), F.max("first").alias("any"))
    entries, open_at, number = [], 0, -1
    for r in sorted(told.collect(), key=lambda r: r["__range"]):
        entries.append((r["__range"], open_at, number))
        if r["any"]:  # what comes after the last group's first item is the same whatever entered
            open_at, number = r.anew.left, r.anew.files - 1
        elif r.reached >= open_at + most:
            hit = found.where((F.col("__range") == r["__range"]) & (F.col("reached") >= open_at + most)).agg(F.min_by(F.struct("left", "files"), "__place")).first()[0]
            open_at, number = hit.left, number + hit.files
    discard(found)
    entering = F.broadcast(spark.createDataFrame(entries, "__range int, __open long, __number long"))
    schema = StructType([*df.schema.fields, StructField("file", LongType())])
    return marked.join(entering, "__range").groupBy("__range").applyInArrow(numbered, schema)


def within(df: DataFrame, length: str, order: str, *file: str) -> DataFrame:
    """Adds from and to: the running total of lengths within each file."""
    w = Window.partitionBy(*file).orderBy(order)
    to = F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("to", to).withColumn("from", F.col("to") - F.col(length))


def chunk_and_file(n: Column, chunk_size: int) -> tuple[Column, Column]:
    return F.floor(n / chunk_size).cast("long"), (n % chunk_size).cast("long")


def manifest(df: DataFrame, key: str, per_shard: int) -> DataFrame:
    """Per shard of so many keys: rows, least and greatest key."""
    return df.groupBy(F.floor(F.col(key) / per_shard).cast("long").alias("shard")).agg(F.count(F.lit(1)).alias("n_rows"), F.min(key).alias("first_key"), F.max(key).alias("last_key"))
