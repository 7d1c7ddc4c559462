"""Two-dimensional point traces: candidate tracks and their fusion, projection, coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid(x: Column, y: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """Both there, finite and in range."""
    ok = lambda v: v.isNotNull() & ~F.isnan(v) & v.between(low, high)
    return F.coalesce(ok(x) & ok(y), F.lit(False))


def to_pixel(c: Column, size: Column | int, clamp: bool = True) -> Column:
    """A coordinate of 0..100 as a pixel of 0..size-1, halves to even; clamped, and 0 for one pixel, unless told not to."""
    n = F.lit(size) if isinstance(size, int) else size
    p = F.rint(c / 100.0 * (n - 1)).cast("long")
    return F.when(n <= 1, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(0).cast("long"), F.least(n.cast("long") - 1, p))) if clamp else p


def to_normal(p: Column, size: Column | int) -> Column:
    """A pixel as a coordinate of 0..100; null if not finite."""
    n = F.lit(size) if isinstance(size, int) else size
    fine = p.isNotNull() & ~F.isnan(p) & (F.abs(p) < float("inf"))
    return F.when(fine, F.when(n <= 1, F.lit(0.0)).otherwise(p / F.greatest(n - 1, F.lit(1)) * 100.0))


def project(x: Column, y: Column, z: Column, inverse: list[list[float]], fx: float, fy: float, cx: float, cy: float, nearest: float = 1e-6) -> tuple[Column, Column, Column]:
    """Pixel u, v and depth of a world point by a camera whose world-to-camera matrix is given; null at or behind it."""
    row = lambda r: x * r[0] + y * r[1] + z * r[2] + F.lit(r[3])
    a, b, d = (row(r) for r in inverse[:3])
    ahead = d > nearest
    return F.when(ahead, F.lit(fx) * a / d + F.lit(cx)), F.when(ahead, F.lit(fy) * b / d + F.lit(cy)), d


def inside(u: Column, v: Column, width: int, height: int) -> Column:
    return F.coalesce(u.between(0, width - 1) & v.between(0, height - 1), F.lit(False))


def frame_policy(u: Column, size: int, policy: str, in_frame: Column) -> Column:
    """What becomes of a pixel outside the frame: nothing (`mask`), the border (`clip`), or itself (`keep_raw`)."""
    if policy == "mask":
        return F.when(in_frame, u)
    if policy == "clip":
        return F.greatest(F.lit(0.0), F.least(F.lit(float(size - 1)), u))
    if policy == "keep_raw":
        return u
    raise ValueError(f"unknown policy {policy!r}")


def coordinate_source(known: Column, in_frame: Column, finite: Column, policy: Column) -> Column:
    """Where a projected coordinate comes from, by the first of five labels that holds.

    known: there is a coordinate after the policy; finite: the projection gave a finite pixel.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(~yes(known), "projection_invalid")
        .when(yes(in_frame), "projection_in_frame")
        .when((policy == "clip") & yes(finite), "projection_clipped")
        .when((policy == "keep_raw") & yes(finite), "projection_raw_out_of_frame")
        .otherwise("projection_valid_other")
    )


def track_summary(tracks: DataFrame, group: str, track: str, frame: str, x: str = "x", y: str = "y", visible: str = "visibility") -> DataFrame:
    """Per track: path length, greatest and mean step, mean visibility and span."""
    w = Window.partitionBy(group, track).orderBy(frame)
    step = F.sqrt(F.pow(F.col(x) - F.lag(x).over(w), F.lit(2)) + F.pow(F.col(y) - F.lag(y).over(w), F.lit(2)))
    g = tracks.withColumn("__j", step).groupBy(group, track).agg(
        F.coalesce(F.sum("__j"), F.lit(0.0)).alias("path"), F.coalesce(F.max("__j"), F.lit(0.0)).alias("jump"), F.coalesce(F.avg("__j"), F.lit(0.0)).alias("mean_step"), F.avg(visible).alias("seen"),
        F.min_by(F.struct(x, y), frame).alias("__a"), F.max_by(F.struct(x, y), frame).alias("__b"),
    )
    return g.withColumn("span", F.sqrt(F.pow(F.col("__b")[x] - F.col("__a")[x], F.lit(2)) + F.pow(F.col("__b")[y] - F.col("__a")[y], F.lit(2)))).drop("__a", "__b")


def tracks_kept(summary: DataFrame, group: str, least_path: float = 5.0, most_jump: float = 50.0, most_step: float = 10.0, least_seen: float = 0.2) -> DataFrame:
    """Adds passed: visible enough, steps below both bounds, and not short in path and span alike (of two or fewer tracks
    only the last counts); and kept, which is passed, but all of two or fewer, and all if none passed."""
    few = F.count(F.lit(1)).over(Window.partitionBy(group)) <= 2
    long = ~((F.col("span") < least_path) & (F.col("path") < least_path))
    good = long & (few | (F.col("seen") >= least_seen) & (F.col("jump") < most_jump) & (F.col("mean_step") < most_step))
    none = F.sum(F.col("passed").cast("int")).over(Window.partitionBy(group)) == 0
    return summary.withColumn("passed", good).withColumn("kept", F.col("passed") | few | none)


def longest(summary: DataFrame, group: str, track: str, k: int) -> DataFrame:
    """Of the tracks that passed the k with the longest paths, earlier ones first among equals; all that are kept unless
    more than k passed. rank numbers them, those that passed first."""
    w = Window.partitionBy(group).orderBy(F.desc("passed"), F.desc("path"), F.asc(track))
    passed = F.sum(F.col("passed").cast("int")).over(Window.partitionBy(group))
    return summary.where("kept").withColumn("rank", F.row_number().over(w).cast("long")).withColumn("__n", passed).where(f"__n <= {int(k)} or rank <= {int(k)}").drop("__n")


def fused(tracks: DataFrame, group: str, frame: str, x: str = "x", y: str = "y", visible: str = "visibility", smoothing: int = 5) -> DataFrame:
    """Per frame one point of all tracks, then a centred moving average over frames (none if there are fewer frames).

    The point is the weighted mean of the mean by visibility (plain if nothing is visible), the median, and the plain
    mean, with weight 1 each, and the plain mean once more, with the frame's consistency 1 / (1 + sx + sy) as weight,
    where sx and sy are the standard deviations over the frame's tracks.
    """
    trust = 1.0 / (1.0 + F.stddev_pop(x) + F.stddev_pop(y))

    def point(v: str) -> Column:
        by_sight = F.when(F.sum(visible) > 1e-6, F.sum(F.col(v) * F.col(visible)) / F.sum(visible)).otherwise(F.avg(v))
        return (by_sight + F.percentile(v, F.lit(0.5)) + F.avg(v) + trust * F.avg(v)) / (3.0 + trust)

    out = tracks.groupBy(group, frame).agg(point(x).alias("fused_x"), point(y).alias("fused_y"))
    if smoothing > 1:
        w = Window.partitionBy(group).orderBy(frame).rowsBetween(-(smoothing // 2), smoothing // 2)
        enough = F.count(F.lit(1)).over(Window.partitionBy(group)) >= smoothing
        out = out.select(group, frame, *(F.when(enough, F.avg(c).over(w)).otherwise(F.col(c)).alias(c) for c in ("fused_x", "fused_y")))
    return out


def fuse(tracks: DataFrame, group: str, track: str, frame: str, most_tracks: int | None = None, smoothing: int = 5, **bounds: float) -> DataFrame:
    """fused() of the tracks that tracks_kept() keeps; of the `most_tracks` longest if more than that passed."""
    kept = tracks_kept(track_summary(tracks, group, track, frame), group, **bounds)
    kept = longest(kept, group, track, most_tracks) if most_tracks else kept.where("kept")
    return fused(tracks.join(kept.select(group, track), [group, track], "left_semi"), group, frame, smoothing=smoothing)


def box_iou(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """Intersection over union of boxes (x1, y1, x2, y2); 0 for empty unions."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / F.nullif(union, F.lit(0.0))).otherwise(0.0)
