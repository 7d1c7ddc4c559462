"""Centroid clustering against comparing every vector with every centroid."""

import hashlib
import math

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from frameflow.llm.cluster_sql import cluster_sql
from frameflow.llm.clustering import Ring, cluster


def brute(rows, k=8, rounds=10, width=64, scale=1024):
    kept = [(i, [int(x) * scale if abs(x) >= 2**53 else math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for c in set(own):
            members = [v for (_, v), n in zip(kept, own, strict=True) if n == c]
            centroids[c] = [sum(col) // len(members) for col in zip(*members, strict=True)]
    found = [(i, *near(v)) for i, v in kept]
    inertia = {c: sum(d for _, d, n in found if n == c) for _, _, c in found}
    fits = lambda v: v if v < 2**63 else None
    return sorted(((i, n, fits(d), fits(inertia[n]), fits(sum(inertia.values())), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for i, d, n in found), key=str)


def frame(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, 7, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, id int, v string")


def drawn(n, seed=0, width=64):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(n, width)) * rng.choice([0.2, 1, 3], size=(n, 1)))]


@pytest.mark.parametrize("n", [0, 1, 5, 8, 9, 120])
def test_equals_comparison_with_all(spark, n):
    rows = drawn(n, n)
    assert sorted(map(tuple, cluster(frame(spark, rows)).collect()), key=str) == brute(rows)


def test_odd_rows(spark):
    rows = drawn(30)
    rows += [(None, rows[0][1]), (3, rows[3][1]), (3, rows[4][1]), (40, None), (41, []), (42, [0.0] * 63), (43, [None] + [0.0] * 63), (44, [math.nan] + [0.0] * 63), (45, [math.inf] + [0.0] * 63), (46, [-0.0] * 64)]
    assert sorted(map(tuple, cluster(frame(spark, rows)).collect()), key=str) == brute(rows)


def test_ties_and_equal_vectors(spark):
    rows = [(i, [float(i % 2)] + [0.0] * 63) for i in range(40)]
    got = sorted(map(tuple, cluster(frame(spark, rows)).collect()), key=str)
    assert got == brute(rows) and {r[2] for r in got} == {0}


def test_components_of_any_size(spark):
    rows = drawn(20) + [(100, [1e30] * 64), (101, [-1e30] + [0.0] * 63), (102, [1e30] * 63 + [9e29]), (103, [3e5] * 64), (104, [1e308] * 64)]
    got = sorted(map(tuple, cluster(frame(spark, rows)).collect()), key=str)
    assert got == brute(rows) and None in {r[3] for r in got}


def test_ring_holds_ties_on_its_boundary():
    rng = np.random.default_rng(1)
    for width, k in ((1, 1), (1, 30), (2, 7), (3, 50)):
        centroids = rng.integers(-6, 7, size=(k, width)).tolist()
        x = rng.integers(-8, 9, size=(400, width))
        ring = Ring(centroids)
        number, d = ring.nearest(x)
        want = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids)) for v in x.tolist()]
        assert list(zip(d.tolist(), number.tolist(), strict=True)) == want
        assert [ring.nearest_wide(v)[::-1] for v in x.tolist()] == want


def test_sql(spark):
    rows = drawn(150, 3)
    table = pa.table({"vec_id": [i for i, _ in rows], "embedding": pa.array([v for _, v in rows], pa.list_(pa.float32()))})
    con = duckdb.connect()
    con.register("embeddings", table)
    got = cluster(frame(spark, [(r["vec_id"], r["embedding"]) for r in table.to_pylist()], "float"))
    want = con.execute(cluster_sql())
    names = [c[0] for c in want.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())
