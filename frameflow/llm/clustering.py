"""Centroid clustering of vectors: Lloyd's rounds in exact integers, nearest centroids by annulus search.

By the triangle inequality a centroid as near to a vector as u has a norm within u of the vector's norm. Centroids are
sorted by norm; a vector's bound u starts as its distance to the centroid of the nearest norm, found by binary search,
and the ring of norms is walked outwards from there. It narrows whenever a nearer centroid turns up, and a margin over
the rounding of square roots keeps those on its boundary in. Distances are compared as integers, ties go to the smaller
number, so the result is the same as that of comparing with every centroid.

The bound is found anew in every round: nothing is written between rounds, each is one pass over two columns of the
table, and only sums by centroid are shuffled: (centroids) x (components + 2) rows of each task, which no key skews.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameflow.llm.common import mapped

_DIGIT = 32
_LONG = 1 << 63


def kept_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", width: int = 64) -> DataFrame:
    """(id, v array<double>) of the rows whose vector has `width` components, none of them null, NaN or infinite."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where((F.size(v) == width) & finite)


def _integers(flat: np.ndarray, width: int, scale: int, narrow: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) by rows, and which rows have components below `narrow`; the others are left as zeros."""
    with np.errstate(over="ignore"):
        q = np.floor(flat.reshape(-1, width) * float(scale))
    small = (np.abs(q) < narrow).all(axis=1)
    return np.where(small[:, None], q, 0).astype(np.int64), small


def _exact(x: float, scale: int) -> int:
    """floor(scale * x) of any finite double; from 2^53 on they are all integers."""
    return int(x) * scale if abs(x) >= 2**53 else math.floor(scale * x)


class Ring:
    """Centroids sorted by norm."""

    def __init__(self, centroids: list[list[int]]):
        squares = [sum(c * c for c in row) for row in centroids]
        self.order = sorted(range(len(centroids)), key=lambda i: (squares[i], i))
        self.rows = [centroids[i] for i in self.order]
        self.roots = [math.isqrt(squares[i]) for i in self.order]
        width = max(1, len(centroids[0]))
        #: Components below it have squared distances within 64 bits.
        self.narrow = math.isqrt((1 << 60) // width)
        self.plain = all(abs(c) < self.narrow for row in centroids for c in row)
        if self.plain:
            self.numbers = np.array(self.order, np.int64)
            self.matrix = np.array(self.rows, np.int64)
            self.norms = np.sqrt((self.matrix * self.matrix).sum(axis=1))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid and squared distance of each row of 64-bit integers below `narrow`."""
        n, k = len(x), len(self.norms)
        norm = np.sqrt((x * x).sum(axis=1))
        right = np.searchsorted(self.norms, norm)
        left = np.maximum(right - 1, 0)
        right = np.minimum(right, k - 1)
        start = np.where(norm - self.norms[left] <= self.norms[right] - norm, left, right)
        gap = x - self.matrix[start]
        best = (gap * gap).sum(axis=1)
        number = self.numbers[start]
        for step in (-1, 1):
            rows, at = np.arange(n), start + step
            while True:
                inside = (at >= 0) & (at < k)
                rows, at = rows[inside], at[inside]
                reach = np.sqrt(best[rows])
                ring = np.abs(self.norms[at] - norm[rows]) <= reach + 1e-9 * (1 + reach + norm[rows])
                rows, at = rows[ring], at[ring]
                if not len(rows):
                    break
                gap = x[rows] - self.matrix[at]
                d = (gap * gap).sum(axis=1)
                better = (d < best[rows]) | ((d == best[rows]) & (self.numbers[at] < number[rows]))
                best[rows[better]], number[rows[better]] = d[better], self.numbers[at[better]]
                at = at + step
        return number, best

    def nearest_wide(self, x: list[int]) -> tuple[int, int]:
        """The same for one row of integers of any size."""
        far = lambda i: sum((a - b) ** 2 for a, b in zip(x, self.rows[i], strict=True))
        norm = math.isqrt(sum(a * a for a in x))
        at = bisect_left(self.roots, norm)
        seed = min((i for i in (at - 1, at) if 0 <= i < len(self.roots)), key=lambda i: abs(self.roots[i] - norm))
        reach = math.isqrt(far(seed)) + 2
        ring = range(bisect_left(self.roots, norm - reach), bisect_right(self.roots, norm + reach))
        d, number = min((far(i), self.order[i]) for i in ring)
        return number, d


def _placed(batch: pa.RecordBatch, ring: Ring, width: int, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, their integers, centroid, squared distance): first those within 64 bits, then the others as Python integers."""
    flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
    x, small = _integers(flat, width, scale, ring.narrow if ring.plain else 0)
    rows = np.flatnonzero(small)
    if len(rows):
        yield rows, x[rows], *ring.nearest(x[rows])
    rows = np.flatnonzero(~small)
    if len(rows):
        wide = [[_exact(v, scale) for v in flat[r * width : (r + 1) * width]] for r in rows]
        found = np.array([ring.nearest_wide(row) for row in wide], object)
        yield rows, np.array(wide, object), found[:, 0].astype(np.int64), found[:, 1]


def _sums(ring: Ring, width: int, scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of components, count and sum of distances by centroid, as digits: sums of digits are exact at any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x, number, d in _placed(batch, ring, width, scale):
                for c in np.unique(number):
                    own = number == c
                    d_sum = sum(int(v) for v in d[own])
                    got = np.array([*(int(s) for s in x[own].sum(axis=0)), int(own.sum()), d_sum], object)
                    total[int(c)] = total.get(int(c), 0) + got
        out: list[tuple[int, int, int, int]] = []
        for c, values in total.items():
            for i, v in enumerate(values):
                digit = 0
                while v not in (0, -1):
                    out.append((c, i, digit, v & ((1 << _DIGIT) - 1)))
                    v, digit = v >> _DIGIT, digit + 1
                if v:
                    out.append((c, i, digit, -1))
        columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["cluster", "item", "digit", "value"])

    return run


def _summed(vectors: DataFrame, ring: Ring, width: int, scale: int) -> dict[int, list[int]]:
    """By non-empty centroid: sums of the components, count, sum of squared distances."""
    parts = vectors.transform(mapped, _sums(ring, width, scale), "cluster int, item int, digit int, value long")
    out: dict[int, list[int]] = {}
    for c, i, digit, value in parts.groupBy("cluster", "item", "digit").agg(F.sum("value")).collect():
        out.setdefault(c, [0] * (width + 2))[i] += value << (_DIGIT * digit)
    return out


def first_centroids(vectors: DataFrame, k: int, width: int, scale: int, seed: str) -> list[list[int]]:
    """The k vectors of the smallest sha256 of `<seed>:<id>`, in that order; equal ids by components, a null id as none."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return [[_exact(x, scale) for x in r.v] for r in vectors.orderBy(key, "v").limit(k).select("v").collect()]


def cluster(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, seed: str = "3") -> DataFrame:
    """id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of every vector that kept_vectors() keeps.

    Components become floor(scale * x). A round assigns all vectors to the nearest centroid, then moves each non-empty
    centroid to the floor of its mean; rounds end early once none moves, as all later ones would be the same. Fewer
    vectors than k are as many centroids; no vector is an empty result. Null vectors and those of another width are
    left out, null and repeated ids are rows like others, other columns are ignored. Arithmetic is exact at any size; a
    squared distance or sum beyond 63 bits is null. What reaches the driver is bounded by k and width alone.
    """
    vectors = kept_vectors(df, id_col, vector_col, width)
    centroids = first_centroids(vectors, k, width, scale, seed)
    id_type = vectors.schema["id"].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        return df.sparkSession.createDataFrame([], schema)
    for _ in range(rounds):
        moved = list(centroids)
        for c, sums in _summed(vectors, Ring(centroids), width, scale).items():
            moved[c] = [s // sums[width] for s in sums[:width]]
        if moved == centroids:
            break
        centroids = moved
    ring = Ring(centroids)
    inertia = {c: sums[width + 1] for c, sums in _summed(vectors, ring, width, scale).items()}
    total = sum(inertia.values())
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits = lambda v: int(v) if v < _LONG else None
        for batch in batches:
            for rows, _, number, d in _placed(batch, ring, width, scale):
                ids = batch.column(0).take(pa.array(rows))
                long = pa.array(d) if d.dtype == np.int64 else pa.array([fits(v) for v in d], pa.int64())
                sums = [pa.array([fits(inertia[int(c)]) for c in number], pa.int64()), pa.array([fits(total)] * len(rows), pa.int64())]
                yield pa.RecordBatch.from_arrays([ids, pa.array(number.astype(np.int32)), long, *sums, pa.array([digests[c] for c in number])], [id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return vectors.transform(mapped, run, schema)
