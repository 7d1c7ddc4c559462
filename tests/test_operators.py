import threading
from bisect import bisect_right

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameflow.functions import text as X
from frameflow.functions import rotations
from tests.rotations_numpy import SIZES, from_matrix, to_matrix
from frameflow.operators import files, joins, stats, windows
from frameflow.operators.transforms import Compose, Concat, Dropout, Normalise


def test_anchor_positions(spark):
    assert windows.anchor_positions(4) == [0, 4, 8, 11] and windows.anchor_positions(6) == [0, 2, 5, 7, 9, 11] and windows.anchor_positions(3, 5) == [0, 2, 4]
    with pytest.raises(ValueError):
        windows.pick(F.array(), [12], 12)


def test_labels_by_policy(spark):
    frames = spark.createDataFrame([(7, s) for s in range(6)] + [(8, 0)], "episode long, step long")
    labels = spark.createDataFrame([(7, 1, [1, 2]), (7, 4, [3, 4])], "episode long, step long, label array<long>")
    got = lambda p: [r.label for r in joins.label_join(frames, labels, "label", p).orderBy("episode", "step").collect()]
    assert got("error") == [None, [1, 2], None, None, [3, 4], None, None]
    assert got("clip") == [[1, 2], [1, 2], [1, 2], [1, 2], [3, 4], [3, 4], None]
    assert got("nearest") == [[1, 2], [1, 2], [1, 2], [3, 4], [3, 4], [3, 4], None]


def nearest_or_clipped(frames, known, policy):
    """The label of each (episode, step) by a search through its episode's known steps."""
    out = {}
    for e, s in frames:
        steps = sorted(known.get(e, {}))
        i = bisect_right(steps, s)
        lo, hi = (steps[i - 1] if i else None), (steps[i] if i < len(steps) else None)
        at = lo if hi is None else hi if lo is None else lo if policy == "clip" or s - lo <= hi - s else hi
        out[e, s] = None if at is None else known[e][at]
    return out


@pytest.mark.parametrize("policy", ["clip", "nearest"])
def test_labels_of_other_stretches(spark, policy):
    draw = np.random.default_rng(5)
    frames = [(e, s) for e, n in ((1, 90), (2, 7), (3, 1), (4, 60)) for s in range(n)]
    labels = [(e, s, None if draw.random() < 0.4 else e * 1000 + s) for e, s in frames if e != 2 and draw.random() < 0.12] + [(4, 500, 1)]
    known = {e: {s: x for k, s, x in labels if k == e and x is not None and (e, s) in frames} for e in (1, 3, 4)}
    df = spark.createDataFrame(frames, "episode long, step long")
    got = joins.label_join(df, spark.createDataFrame(labels, "episode long, step long, label long"), "label", policy, width=4)
    assert got.columns == ["episode", "step", "label"]
    rows = got.collect()
    assert len(rows) == len(frames) and {(r.episode, r.step): r.label for r in rows} == nearest_or_clipped(frames, known, policy)


def test_a_null_label_is_no_neighbour(spark):
    df = spark.createDataFrame([(1, s) for s in range(8)], "episode long, step long")
    labels = spark.createDataFrame([(1, 0, 10), (1, 3, None), (1, 6, 16)], "episode long, step long, label long")
    got = joins.label_join(df, labels, "label", "nearest").orderBy("step").collect()
    assert [r.label for r in got] == [10, 10, 10, 10, 16, 16, 16, 16]


def test_labels_of_a_long_episode_in_linear_time(spark):
    n, gap = 200_000, 997
    df = spark.range(n).select(F.lit(1).cast("long").alias("episode"), F.col("id").alias("step"))
    labels = df.where(F.col("step") % gap == 0).withColumn("label", F.col("step"))
    at = F.least(F.floor((F.col("step") + gap // 2) / gap) * gap, F.lit((n - 1) // gap * gap))
    stop = threading.Timer(60, spark.sparkContext.cancelAllJobs)  # a tenth of it will do, a quadratic join takes minutes
    stop.start()
    try:
        got = joins.label_join(df, labels, "label", "nearest").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == at).alias("right")).first()
    finally:
        stop.cancel()
    assert (got.n, got.right) == (n, n)


def test_lookup_misses_are_errors(spark):
    df, dim = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(1, "a")], "k long, v string")
    assert joins.lookup(df, dim, "k", strict=False).count() == 1
    with pytest.raises(Exception, match="no match"):
        joins.lookup(df, dim, "k").collect()


def test_one_row_episodes_and_padding(spark):
    df = spark.createDataFrame([(1, 0, 5.0), (2, 0, 1.0), (2, 1, 3.0)], "episode long, step long, x double")
    rows = {(r.episode, r.step): r for r in windows.trailing(df, ["x"], 3).collect()}
    assert rows[1, 0].x_window == [5.0, 5.0, 5.0] and rows[2, 1].x_window == [1.0, 1.0, 3.0]
    assert {(r.episode, r.step): r.chunk for r in windows.chunk(df, "x", 3).collect()}[2, 0] == [1.0, 3.0, 0.0]
    assert windows.padding_of("yxz", True) == "first_last" and windows.padding_of("zero", True) == "zero"


def test_interpolation_without_values(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, None)], "episode long, step long, x double")
    assert [r.x for r in windows.interpolate(df, ["x"], default=50.0).collect()] == [50.0, 50.0]


def test_degenerate_dimensions(spark):
    one = spark.range(1)
    z = lambda mode, x, a, b: one.select(stats.normalise(F.lit(x), mode, F.lit(a), F.lit(b)).alias("z")).first().z
    assert z("q99", 0.3, 1.0, 1.0) == 0.3 and z("q99", 7.0, 1.0, 1.0) == 1.0
    assert z("min_max", 7.0, 1.0, 1.0) == 0.0 and z("scale", 7.0, 0.0, 0.0) == 0.0 and z("mean_std", 7.0, 1.0, 0.0) == 7.0


def test_partial_statistics_merge(spark):
    df = spark.createDataFrame([(i % 3, [float(i), float(-i * i)]) for i in range(50)], "k long, v array<double>")
    whole = {r.dim: r for r in stats.vector_stats(df, "v").collect()}
    parts = {r.dim: r for r in stats.merged(stats.sums(df, "v", "k")).collect()}
    for d, r in whole.items():
        assert parts[d].n == r.n and parts[d].mean == pytest.approx(r["mean"]) and parts[d].std == pytest.approx(r["std"])


def test_compose_undoes_in_reverse(spark):
    df = spark.createDataFrame([(1, [0.0, 5.0], [1.0])], "id long, a array<double>, b array<double>")
    chain = Compose(Normalise("a", "min_max", [0, 0], [10, 10]), Dropout("a", 0.0, ["id"]), Concat({"a": 2, "b": 1}, "v"))
    out = chain.apply(df)
    assert out.first().v == [-1.0, 0.0, 1.0]
    back = chain.unapply(out).first()
    assert back.a == [0.0, 5.0] and back.b == [1.0]
    with pytest.raises(Exception, match="wide"):
        Concat({"a": 3, "b": 1}, "v").apply(df).collect()


def test_bin_packing_rules(spark):
    df = spark.createDataFrame([(i, float(s)) for i, s in enumerate([4, 4, 4, 9, 1])], "i long, s double")
    placed = lambda b: [r.file for r in files.bin_pack(df, "s", "i", 8.0, before=b).orderBy("i").collect()]
    assert placed(False) == [0, 0, 1, 1, 2]
    assert placed(True) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("kind", [*SIZES, *(f"euler_angles_{o}" for o in ("rpy", "ryp", "pry", "pyr", "yrp", "ypr"))])
def test_rotations_round_trip(kind):
    q = np.random.default_rng(3).normal(size=(200, 4))
    m = to_matrix(q, "quaternion")
    assert np.allclose(to_matrix(from_matrix(m, kind), kind), m, atol=1e-9)
    assert np.allclose(m @ m.transpose(0, 2, 1), np.eye(3), atol=1e-12)


@pytest.mark.parametrize(
    "text,want",
    [
        ("", [(0, 0)] * 4),
        ("[[544, 372], [615", [(0.544, 0.372)] * 4),
        ("[[1, 2], [3, 4], [5, 6], [7, 8], [9, 10], [11, 12]]", [(0.001, 0.002), (0.003, 0.004), (0.005, 0.006), (0.007, 0.008)]),
        ("garbage", [(0, 0)] * 4),
        ("[[2000, -5]]", [(1.0, 0.0)] * 4),
    ],
)
def test_malformed_trace_texts(spark, text, want):
    got = spark.range(1).select(X.text_to_trace(F.lit(text)).alias("p")).first().p
    assert [(p.x, p.y) for p in got] == want


def test_trace_text_styles(spark):
    pts = F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in ((0.544, 0.372), (0.615, 0.42), (0.728, 0.512), (0.823, 0.612))))
    say = lambda s: spark.range(1).select(X.trace_to_text(pts, s).alias("t")).first().t
    assert say("plain") == "[[544, 372], [615, 420], [728, 512], [823, 612]]"
    assert say("cot_bbox") == say("plain")
    assert say("qwen_point_2d").startswith('[{"point_2d": [544, 372], "label": "start"}, {"point_2d": [615, 420], "label": "one_third"}')


def test_positions_of_millions_of_rows(spark):
    from frameflow.operators import sampling

    df = spark.range(3_000_000).selectExpr("pmod(hash(id), 100000) episode", "cast(pmod(hash(id, 7), 1000) as string) step", "id", "repeat('x', 20) one", "uuid() two")
    got = sampling.positions(df, "episode", "step").agg(F.count("*").alias("n"), F.countDistinct("pos").alias("d"), F.min("pos").alias("a"), F.max("pos").alias("b"), F.countDistinct("id").alias("ids")).first()
    assert tuple(got) == (3_000_000, 3_000_000, 0, 2_999_999, 3_000_000)
    out = sampling.positions(df, "episode", "step").select("pos", "episode", "step").orderBy("pos").limit(1000).collect()
    assert [(r.episode, r.step) for r in out] == sorted((r.episode, r.step) for r in out)


def test_positions_and_nodes_of_small_tables(spark):
    from frameflow.operators import sampling

    df = spark.createDataFrame([(k,) for k in (5, None, 3, 3, 9)], "k int")
    assert sorted((r.pos, r.k) for r in sampling.positions(df, "k").collect()) == [(0, None), (1, 3), (2, 3), (3, 5), (4, 9)]
    assert sampling.positions(df.limit(0), "k").collect() == []
    ten = spark.range(10)
    assert [r.node for r in sampling.nodes(ten, 4, "id").orderBy("id").collect()] == [0, 0, 0, 1, 1, 1, 2, 2, 3, 3]
    assert [r.node for r in sampling.nodes(spark.range(2), 4, "id").orderBy("id").collect()] == [0, 1]


def test_answers_of_a_point(spark):
    said = {
        '<point x="43.0" y="58.0" alt="robot gripper">robot gripper</point>': (43.0, 58.0),
        "gripper coordinates: 43, 58 and then (1, 2)": (43.0, 58.0),
        "Coordinates: (12.5, 7)": (12.5, 7.0),
        "x: 10, y: 20": (10.0, 20.0),
        "43 58": None,
        "(200, 5) or x 10 y 20": (10.0, 20.0),
        "": None,
    }
    df = spark.createDataFrame([(t,) for t in said], "t string").select("t", X.parse_point(F.col("t")).alias("p"))
    assert {r.t: r.p and tuple(r.p) for r in df.collect()} == said


def test_sizes_and_slugs(spark):
    sizes = {"1.5GB": 1.5, "3M/10G": 3 / 1024, "5 MB": 5 / 1024**3, "7kB": 7 / 1024**2, "2T": 2048.0, "none": 0.0, "4k": None, "1.2.3M": None}
    df = spark.createDataFrame([(t,) for t in sizes], "t string").select("t", X.gigabytes(F.col("t")).alias("g"))
    assert {r.t: r.g for r in df.collect()} == pytest.approx({k: v for k, v in sizes.items()}, nan_ok=True)
    assert spark.range(1).select(X.slug(F.lit(" My_Set/v1 (x)  a "))).first()[0] == "my-set-v1-(x)--a"


def test_prompts():
    assert X.trace_prompt("plain", 4) == "Predict the gripper trace as 4 anchor points (start, intermediate, end) in [[x,y]] format with coords 0-1000."
    assert X.semantic_prompt("latent_only", "plain", 4, 8) == "Predict 8 latent action tokens."
    assert X.semantic_prompt("trace_latent", "cot_bbox", 4, 8).endswith("0-1000. Then predict 8 latent action tokens.")
    with pytest.raises(ValueError):
        X.semantic_prompt("none", "plain")


def test_sticky_holds_the_move():
    from frameflow.streaming.control import Sticky

    machine = Sticky(0.5, 3)
    assert [machine.step(v) for v in (0.0, 0.25, 0.75, 0.5, 0.0, 0.5, 0.0, 0.0)] == [0.0, -0.25, -0.75, -0.75, -0.75, 0.25, 0.75, 0.75]


def test_noise_follows_the_keys(spark):
    from frameflow.operators.transforms import Cast, Noise

    df = spark.range(2000).selectExpr("id", "array(cast(-100 as double), cast(0 as double), cast(100 as double)) v")
    noisy = Noise("v", 0.5, ["id"], 3)
    one, two = ({r.id: r.v[1] for r in noisy.apply(d).collect()} for d in (df, df.repartition(7, "v")))
    assert one == two and abs(np.mean(list(one.values()))) < 0.05 and abs(np.std(list(one.values())) - 0.5) < 0.05
    assert noisy.apply(df, train=False) is df
    cast = Cast("v", "float")
    assert cast.unapply(cast.apply(df)).dtypes == df.dtypes and cast.apply(df).dtypes[1][1] == "array<float>"


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_quantiles_without_groups_in_memory(spark, accuracy):
    r = np.random.default_rng(5)
    rows = [(k, float(v)) for k, n in ((0, 1), (1, 2), (2, 150), (3, 3000), (None, 500)) for v in (np.round(r.normal(size=n), 2) if k == 3 else r.normal(size=n))] + [(4, 7.0)] * 400 + [(5, None)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(5)
    shares = [0.0, 0.01, 0.5, 0.99, 1.0]
    got = {x.k: x.q for x in stats.quantiles(df, shares, "k", accuracy=accuracy).collect()}
    by = {}
    for k, v in rows:
        if v is not None:
            by.setdefault(k, []).append(v)
    assert got.keys() == by.keys()
    for k, v in by.items():
        assert got[k] == pytest.approx(np.quantile(v, shares).tolist(), abs=1e-12)


def test_vector_statistics_of_large_tables(spark):
    df = spark.range(3000).selectExpr("id % 3 tag", "array(cast(hash(id) % 1000 as double), cast(id as double)) v")
    small, large = (sorted(tuple(x) for x in stats.vector_stats(df, "v", "tag", one_pass=n).collect()) for n in (10_000, 100))
    for a, b in zip(small, large):
        assert a == pytest.approx(b, abs=1e-9)
    assert len(small) == len(large) == 6


def test_nearest_codes(spark):
    r = np.random.default_rng(1)
    book, x = r.integers(0, 3, (40, 3)).astype(float), r.integers(0, 3, (500, 3)).astype(float)
    codes = spark.createDataFrame([(int(k * 2), c.tolist()) for k, c in enumerate(book)], "code int, centre array<double>")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)], "id int, v array<double>")
    got = {q.id: (q.code, q.distance) for q in stats.nearest_code(df, "v", codes, "id").collect()}
    d = ((x[:, None] - book[None]) ** 2).sum(2)
    assert got == {i: (int(2 * d[i].argmin()), d[i].min()) for i in range(500)} | {900: (None, None)}


def test_limit_of_tracks_holds_for_those_that_passed(spark):
    from frameflow.operators.traces import fuse

    rows = [("g", t, f, float(100 * t * (f % 2)), 0.0, 1.0) for t in range(1, 4) for f in range(4)]
    df = spark.createDataFrame(rows, "g string, track int, frame int, x double, y double, visibility double")
    points = lambda n, **bounds: [round(r.fused_x, 6) for r in fuse(df, "g", "track", "frame", n, smoothing=1, **bounds).orderBy("frame").collect()]
    assert points(1, most_jump=50.0) == [0.0, 200.0, 0.0, 200.0]  # none passes: the mean of all
    assert points(1, most_jump=1e9, most_step=1e9) == [0.0, 300.0, 0.0, 300.0]
    assert points(3, most_jump=250.0, most_step=1e9) == [0.0, 150.0, 0.0, 150.0]


def folded(sizes, limit, before):
    files, used, n, file = [], 0, 0, 0
    for s in sizes:
        if before and n and used + s >= limit:
            file, used, n = file + 1, 0, 0
        files.append(file)
        used, n = used + s, n + 1
        if not before and used >= limit:
            file, used, n = file + 1, 0, 0
    return files


@pytest.mark.parametrize("before", [False, True])
def test_bin_packing_equals_the_fold_over_many_ranges(spark, before):
    rng = np.random.default_rng(5)
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for n, limit, high in ((0, 5, 9), (1, 5, 9), (300, 20, 9), (300, 3, 9), (300, 1000, 9), (300, 10**6, 9), (300, 50, 1)):
            sizes = [int(x) for x in rng.integers(0, high + 1, n)]
            df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "i long, s long")
            assert [r.file for r in files.bin_pack(df, "s", "i", limit, before).orderBy("i").collect()] == folded(sizes, limit, before), (n, limit)
        groups = [(str(g) if g else None, i, float(rng.integers(0, 40)) / 8) for g, m in ((0, 3), (1, 150), (2, 1), (3, 90), (4, 2)) for i in range(m)]
        df = spark.createDataFrame(groups, "g string, i long, s double").repartition(3)
        got = {(r.g, r.i): r.file for r in files.bin_pack(df, "s", "i", 12.5, before, "g").collect()}
        for g in {g for g, _, _ in groups}:
            own = [(i, s) for h, i, s in groups if h == g]
            assert [got[g, i] for i, _ in own] == folded([s for _, s in own], 12.5, before)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
    with pytest.raises(Exception, match="negative"):
        files.bin_pack(spark.createDataFrame([(1, -1)], "i long, s long"), "s", "i", 5).collect()


KINDS = [*SIZES, *(f"euler_angles_{o}" for o in ("rpy", "ryp", "pry", "pyr", "yrp", "ypr"))]


def test_rotation_expressions_equal_numpy(spark):
    q = np.random.default_rng(3).normal(size=(60, 4))
    q[:6] = [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1], [-1, 0, 0, 1e-12], [1, 1, 0, 0]]
    m = to_matrix(q, "quaternion")
    rows = [tuple([i, *(from_matrix(m, k)[i].tolist() for k in KINDS)]) for i in range(len(q))]
    df = spark.createDataFrame(rows, ", ".join(["i long", *(f"{k} array<double>" for k in KINDS)]))
    plan = df.select(*(rotations.convert(F.col(a), a, b).alias(f"{a}__{b}") for a in KINDS for b in ("matrix", "quaternion")))
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()
    got = df.orderBy("i").select(*(rotations.to_matrix(F.col(k), k).alias(k) for k in KINDS), *(rotations.convert(F.col("matrix"), "matrix", k).alias(f"to_{k}") for k in KINDS)).collect()
    for k in KINDS:
        assert np.allclose(np.array([r[k] for r in got]).reshape(-1, 3, 3), to_matrix(np.array([r[1 + KINDS.index(k)] for r in rows]), k), atol=1e-9)
        back = np.array([r[f"to_{k}"] for r in got])
        assert np.allclose(to_matrix(back, k), m, atol=1e-6), k
        if not k.startswith("euler"):
            assert np.allclose(np.abs(back), np.abs(from_matrix(m, k)), atol=1e-6), k


def test_rotations_of_known_value(spark):
    h = float(np.sqrt(0.5))
    about_z = [0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    said = {
        "axis_angle": [0.0, 0.0, np.pi / 2], "quaternion": [h, 0.0, 0.0, h], "rotation_6d": about_z[:6], "matrix": about_z,
        "euler_angles_rpy": [0.0, 0.0, np.pi / 2], "euler_angles_ypr": [np.pi / 2, 0.0, 0.0], "euler_angles_pyr": [0.0, np.pi / 2, 0.0],
    }
    df = spark.createDataFrame([tuple(said.values())], ", ".join(f"{k} array<double>" for k in said))
    row = df.select(*(rotations.convert(F.col(a), a, b).alias(f"{a}.{b}") for a in said for b in said)).first()
    for a in said:
        for b in said:
            assert row[f"{a}.{b}"] == pytest.approx(said[b], abs=1e-7), (a, b)
    # roll, then pitch by a right angle: a locked order gives all of the turn to its first angle
    locked = df.select(rotations.convert(F.array(F.lit(0.3), F.lit(np.pi / 2), F.lit(0.2)), "euler_angles_rpy", "euler_angles_rpy").alias("e")).first().e
    assert locked == pytest.approx([0.5, np.pi / 2, 0.0], abs=1e-6)
    odd = spark.createDataFrame([(None,), ([1.0, None, 0.0, 0.0],)], "q array<double>")
    assert [r.m for r in odd.select(rotations.convert(F.col("q"), "quaternion", "matrix").alias("m")).collect()] == [None, None]
    with pytest.raises(Exception, match="has 4 numbers"):
        df.select(rotations.convert(F.col("axis_angle"), "quaternion", "matrix")).collect()
    for kind in ("euler_angles_rrp", "other"):
        with pytest.raises(ValueError):
            rotations.convert(F.col("q"), kind, "matrix")


def test_dropout_of_whole_vectors(spark):
    df = spark.range(4000).selectExpr("id", "array(1D, 2D) v")
    gone = {r.id for r in Dropout("v", 0.3, ["id"], 5).apply(df).collect() if r.v == [0.0, 0.0]}
    assert abs(len(gone) / 4000 - 0.3) < 0.03
    assert {r.id for r in Dropout("v", 0.3, ["id"], 5).apply(df.repartition(3)).collect() if r.v == [0.0, 0.0]} == gone
    assert {r.v[0] for r in Dropout("v", 0.3, ["id"], 5).apply(df, train=False).collect()} == {1.0}


def test_values_beyond_the_range_come_back_without_a_clip(spark):
    df = spark.createDataFrame([(-3.0,), (0.25,), (7.0,)], "x double")
    low, high = F.lit(-1.0), F.lit(1.0)
    for mode in ("min_max", "mean_std"):
        z = stats.normalise(F.col("x"), mode, low, high)
        assert [r.b for r in df.select(stats.denormalise(z, mode, low, high).alias("b")).collect()] == [-3.0, 0.25, 7.0]
    q = df.select(stats.denormalise(stats.normalise(F.col("x"), "q99", low, high), "q99", low, high).alias("b"))
    assert [r.b for r in q.collect()] == [-1.0, 0.25, 1.0]
