"""Windows over the ordered frames of an episode: trailing traces, forward chunks, gaps, smoothing, control state.

Every function takes and returns a DataFrame. `episode` and `step` name the grouping key and the order within it;
steps are unique within an episode.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from frameflow.operators.sampling import running


def along(episode: str = "episode", step: str = "step") -> WindowSpec:
    return Window.partitionBy(episode).orderBy(step)


def whole(episode: str = "episode") -> WindowSpec:
    return Window.partitionBy(episode)


def trailing(df: DataFrame, values: Sequence[str], size: int = 12, episode: str = "episode", step: str = "step", suffix: str = "_window") -> DataFrame:
    """Adds, for each value, the array of the last `size` rows, padded on the left with the episode's first value."""
    w = along(episode, step)
    for v in values:
        seen = F.collect_list(F.col(v)).over(w.rowsBetween(1 - size, 0))
        first = F.first(v).over(w.rowsBetween(Window.unboundedPreceding, 0))
        df = df.withColumn(v + suffix, F.concat(F.array_repeat(first, F.greatest(F.lit(size) - F.size(seen), F.lit(0))), seen))
    return df


#: Anchor positions in a window of 12.
ANCHORS_OF_12 = {4: [0, 4, 8, 11], 6: [0, 2, 5, 7, 9, 11]}


def anchor_positions(anchors: int, size: int = 12) -> list[int]:
    """The fixed positions where there are some, else evenly spaced ones, first and last included, halves to even."""
    if size == 12 and anchors in ANCHORS_OF_12:
        return ANCHORS_OF_12[anchors]
    return [round(i * (size - 1) / (anchors - 1)) for i in range(anchors)]


def pick(window: Column, positions: Sequence[int], size: int) -> Column:
    """The window's values at the positions; one outside the window is an error."""
    bad = [p for p in positions if not 0 <= p < size]
    if bad:
        raise ValueError(f"anchors {bad} lie outside a window of {size}")
    return F.transform(F.array(*(F.lit(p) for p in positions)), lambda p: F.element_at(window, p + 1))


def chunk(df: DataFrame, value: str, size: int, padding: str = "zero", episode: str = "episode", step: str = "step", to: str = "chunk") -> DataFrame:
    """Adds the array of this row's and the next rows' value, `size` long, padded with zeros or the episode's last value."""
    w = along(episode, step)
    seen = F.collect_list(F.col(value)).over(w.rowsBetween(0, size - 1))
    if padding == "zero":
        pad = F.lit(0.0)
    elif padding in ("last", "first_last"):
        pad = F.last(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    else:
        raise ValueError(f"unknown padding {padding!r}")
    return df.withColumn(to, F.concat(seen, F.array_repeat(pad, F.lit(size) - F.size(seen))))


def padding_of(policy: str, absolute: bool) -> str:
    """The padding that a policy gives a key: `zero`, `first_last`, or one of the two by whether the key is absolute."""
    fixed = {"zero": "zero", "first_last": "first_last"}
    if policy in fixed:
        return fixed[policy]
    if policy in ("yxz", "first_last_absolute", "absolute_first_last"):
        return "first_last" if absolute else "zero"
    raise ValueError(f"unknown padding policy {policy!r}")


def gather(df: DataFrame, value: str, offsets: Sequence[int], padding: str = "first_last", episode: str = "episode", step: str = "step", to: str = "gathered") -> DataFrame:
    """Adds the array of values at these offsets from the row, inside the episode or padded (clamped or zero)."""
    w = along(episode, step)
    first, last = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.last(value).over(w.rowsBetween(0, Window.unboundedFollowing))
    n, place = F.count(F.lit(1)).over(whole(episode)), F.row_number().over(w) - 1

    def at(k: int) -> Column:
        got = F.col(value) if k == 0 else F.lead(value, k).over(w) if k > 0 else F.lag(value, -k).over(w)
        pad = F.lit(0.0) if padding == "zero" else last if k > 0 else first
        return F.when((place + k < 0) | (place + k >= n), pad).otherwise(got)

    return df.withColumn(to, F.array(*(at(k) for k in offsets)))


def action_mode(chunk_: Column, state: Column, mode: str) -> Column:
    """A chunk as it is (`abs`), as steps from value to value starting at the state (`delta`), or from the state (`rel`)."""
    if mode == "abs":
        return chunk_
    if mode == "rel":
        return F.transform(chunk_, lambda v: v - state)
    if mode == "delta":
        before = F.concat(F.array(state), F.slice(chunk_, F.lit(1), F.size(chunk_) - 1))
        return F.zip_with(chunk_, before, lambda a, b: a - b)
    raise ValueError(f"unknown action mode {mode!r}")


def number(df: DataFrame, episode: str = "episode", step: str = "step") -> DataFrame:
    """Adds frame_index within the episode, and index over all episodes in order, without one global sort of rows."""
    starts = offsets(df, episode).select(F.col(episode).alias("__e"), "start")
    own = df.withColumn("frame_index", (F.row_number().over(along(episode, step)) - 1).cast("long"))
    return own.join(starts, F.col(episode).eqNullSafe(F.col("__e"))).withColumn("index", F.col("start") + F.col("frame_index")).drop("__e", "start")


def offsets(df: DataFrame, episode: str = "episode") -> DataFrame:
    """(episode, n, start): rows of each episode and of all before it."""
    return running(df.groupBy(episode).agg(F.count(F.lit(1)).alias("n")), F.col("n"), episode, to="start")


def clamp(index: Column, length: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(index, length - 1))


def at_offset(df: DataFrame, value: str, offset: int, episode: str = "episode", step: str = "step", to: str = "at") -> DataFrame:
    """Adds the value `offset` steps away, at the episode's first or last step where that is beyond it."""
    return gather(df, value, [offset], "first_last", episode, step, to).withColumn(to, F.element_at(to, 1))


def moving_average(df: DataFrame, value: str, size: int, episode: str = "episode", step: str = "step", to: str = "smooth") -> DataFrame:
    """Centred average, cut off at the episode's ends; the value itself if size is at most 1 or over the episode's length."""
    if size <= 1:
        return df.withColumn(to, F.col(value))
    half = size // 2
    mean = F.avg(value).over(along(episode, step).rowsBetween(-half, half))
    return df.withColumn(to, F.when(F.count(F.lit(1)).over(whole(episode)) < size, F.col(value)).otherwise(mean))


def path_stats(df: DataFrame, x: str = "x", y: str = "y", episode: str = "episode", step: str = "step") -> DataFrame:
    """Per episode: points, path_length, max_jump and span (distance from first to last point)."""
    w = along(episode, step)
    jump = F.sqrt(F.pow(F.col(x) - F.lag(x).over(w), 2) + F.pow(F.col(y) - F.lag(y).over(w), 2))
    g = df.withColumn("__jump", jump).groupBy(episode).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum("__jump"), F.lit(0.0)).alias("path_length"),
        F.coalesce(F.max("__jump"), F.lit(0.0)).alias("max_jump"),
        F.min_by(F.struct(x, y), step).alias("__a"),
        F.max_by(F.struct(x, y), step).alias("__b"),
    )
    return g.withColumn("span", F.sqrt(F.pow(F.col("__b")[x] - F.col("__a")[x], 2) + F.pow(F.col("__b")[y] - F.col("__a")[y], 2))).drop("__a", "__b")


def pauses_removed(df: DataFrame, deltas: Sequence[str], grip: str, epsilon: float = 5e-4, episode: str = "episode", step: str = "step") -> DataFrame:
    """Rows with some movement over epsilon, or whose gripper differs from the row before (never so for the first)."""
    moved = F.exists(F.array(*deltas), lambda d: F.abs(d) > epsilon)
    turned = F.coalesce(F.col(grip) != F.lag(grip).over(along(episode, step)), F.lit(False))
    return df.withColumn("__keep", moved | turned).where("__keep").drop("__keep")


def _neighbours(df: DataFrame, value: str, episode: str, step: str) -> tuple[Column, Column, Column, Column]:
    w = along(episode, step)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    place = F.when(F.col(value).isNotNull(), F.col(step))
    return F.last(value, True).over(back), F.last(place, True).over(back), F.first(value, True).over(ahead), F.first(place, True).over(ahead)


def interpolate(df: DataFrame, values: Sequence[str], episode: str = "episode", step: str = "step", default: float | None = None, clip: tuple[float, float] | None = None, method: str | None = None) -> DataFrame:
    """Fills nulls: linearly inside, constant before the first and after the last value; `default` where there is none.

    With `method` a column of that name tells how the first value came about.
    """
    for v in values:
        a, sa, b, sb = _neighbours(df, v, episode, step)
        inside = a + (b - a) * ((F.col(step) - sa) / (sb - sa))
        filled = F.when(F.col(v).isNotNull(), F.col(v)).when(a.isNotNull() & b.isNotNull(), inside).otherwise(F.coalesce(a, b, F.lit(default).cast("double")))
        if clip:
            filled = F.greatest(F.lit(clip[0]), F.least(F.lit(clip[1]), filled))
        if method and v == values[0]:
            how = F.when(F.col(v).isNotNull(), "original").when(a.isNotNull() & b.isNotNull(), "interpolated").when(a.isNotNull(), "forward_fill").when(b.isNotNull(), "backfill").otherwise("none")
            df = df.withColumn(method, how)
        df = df.withColumn("__" + v, filled)
    for v in values:
        df = df.withColumn(v, F.col("__" + v)).drop("__" + v)
    return df


def running_range(df: DataFrame, value: str, epsilon: float = 1e-6, episode: str = "episode", step: str = "step", to: str = "probe") -> DataFrame:
    """Scales each value by the least and greatest so far: (v - min) / (max - min + epsilon)."""
    w = along(episode, step).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(to, (F.col(value) - F.min(value).over(w)) / (F.max(value).over(w) - F.min(value).over(w) + F.lit(epsilon)))


def replayed(df: DataFrame, chunk_: str, size: int, episode: str = "episode", step: str = "step", to: str = "replay") -> DataFrame:
    """The element for now of the chunk taken at the last step divisible by `size`."""
    taken = F.when(F.col(step) % size == 0, F.col(chunk_))
    held = F.last(taken, True).over(along(episode, step).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("__held", held).withColumn(to, F.element_at("__held", (F.col(step) % size + 1).cast("int"))).drop("__held")


def ensemble(df: DataFrame, chunk_: str, horizon: int, alpha: float, episode: str = "episode", step: str = "step", to: str = "ensemble") -> DataFrame:
    """Average of the vectors that the last `horizon` chunks predict for now, weighted by exp(alpha * cosine with the newest).

    A chunk is an array of vectors, for its own step and those after it.
    """
    w = along(episode, step)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    scaled = lambda a, c: F.transform(a, lambda x: x * c)
    now = F.element_at(chunk_, 1)
    total = den = None
    for k in range(horizon):
        past = F.element_at(chunk_ if k == 0 else F.lag(chunk_, k).over(w), k + 1)
        cosine = dot(past, now) / (F.sqrt(dot(past, past)) * F.sqrt(dot(now, now)) + F.lit(1e-7))
        weight = F.coalesce(F.exp(F.lit(alpha) * cosine), F.lit(0.0))
        df = df.withColumn(f"__w{k}", weight).withColumn(f"__p{k}", past)
        den = F.col(f"__w{k}") if den is None else den + F.col(f"__w{k}")
        part = scaled(F.coalesce(f"__p{k}", now), F.col(f"__w{k}"))
        total = part if total is None else F.zip_with(total, part, lambda x, y: x + y)
    df = df.withColumn("__den", den)
    return df.withColumn(to, scaled(total, 1 / F.col("__den"))).drop("__den", *(f"__{c}{k}" for c in "wp" for k in range(horizon)))


def keyframes_selected(df: DataFrame, episode: str = "episode", step: str = "step") -> DataFrame:
    """Adds is_keyframe: all of up to 2 frames, every second of up to 10, else first, last and 8 evenly stepped ones."""
    n = F.count(F.lit(1)).over(whole(episode))
    stride = F.floor((n - 2) / 9)
    k = F.col(step)
    many = (k == 0) | (k == n - 1) | ((k % F.greatest(stride, F.lit(1)) == 0) & (k >= stride) & (k <= 8 * stride))
    return df.withColumn("is_keyframe", F.when(n <= 2, True).when(n <= 10, k % 2 == 0).otherwise(many))
