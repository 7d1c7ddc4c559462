"""Connected components of a distributed graph by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameflow.llm.common import discard, mapped, stored


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: each node's greater neighbours go to its least one. Small: its lesser neighbours, and itself, do."""
    near = _both(edges)
    if not large:
        near = near.where("v < u")
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = near.join(least, "u").where("v > u" if large else "v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Roots of a whole graph in one task: ends of edges hook onto the lesser root, paths are cut short, until all agree."""
    parts = [(np.asarray(batch.column("a")), np.asarray(batch.column("b"))) for batch in batches]
    ends = np.concatenate([np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(2)])
    nodes, place = np.unique(ends, return_inverse=True)
    u, v = place[: len(place) // 2], place[len(place) // 2 :]
    root = np.arange(len(nodes))
    while len(u):
        x, y = root[u], root[v]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
        apart = root[u] != root[v]
        u, v = u[apart], v[apart]
    below = np.flatnonzero(root != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[below]), pa.array(nodes[root[below]])], ["node", "root"])


def components(edges: DataFrame, one_task: int = 1_000_000) -> DataFrame:
    """(node, root) for every node of an edge (a, b, long) to another one; root is the least node of its component.

    Up to `one_task` edges (16 MB) are united by one task of an executor. More take rounds of two stars, each stored,
    until the edges no longer change; the roots are the same. Equal and repeated edges do no harm.
    """
    now = stored(edges.where("a <> b").distinct(), "edges")
    if now.count() <= one_task:
        out = stored(now.coalesce(1).transform(mapped, _united, "node long, root long"), "roots")
        discard(now)
        return out
    mark = None
    while True:
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == mark or new[0] == 0:
            return now.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
        mark = new
        large = stored(_star(now, True), "edges")
        small = stored(_star(large, False), "edges")
        discard(now, large)
        now = small
