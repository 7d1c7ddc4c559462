"""Robot configurations forward and back, and the calibration chain, against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameflow.operators import calibration, configs
from tests.rotations_numpy import from_matrix, to_matrix


def table(spark, config, wide=None, n=40, seed=0):
    rng = np.random.default_rng(seed)
    leaves = [leaf for m in ("state", "action") for leaf in configs.ROBOTS[config].leaves(m)]
    kinds = {leaf: (wide or {}).get(leaf, 1) for leaf in leaves}
    rows = [{"id": i} | {leaf: (float(rng.uniform(0, 2)) if w == 1 else [float(x) for x in rng.normal(size=w)]) for leaf, w in kinds.items()} for i in range(n)]
    schema = "id long, " + ", ".join(f"`{leaf}` {'double' if w == 1 else 'array<double>'}" for leaf, w in kinds.items())
    columns = {leaf: np.array([np.atleast_1d(r[leaf]) for r in rows]) for leaf in leaves}
    stats = {leaf: {"min": c.min(0).tolist(), "max": c.max(0).tolist(), "q01": np.quantile(c, 0.01, axis=0).tolist(), "q99": np.quantile(c, 0.99, axis=0).tolist()} for leaf, c in columns.items()}
    return spark.createDataFrame([tuple(r.values()) for r in rows], schema), columns, stats


def scaled(c, s, mode):
    if mode == "binary":
        return (c > 0.5).astype(float)
    low, high = (np.array(s[k]) for k in configs.STATISTICS[mode])
    out = 2 * (c - low) / (high - low) - 1
    return np.clip(out, -1, 1) if mode == "q99" else out


@pytest.mark.parametrize("robot", ["libero_franka", "oxe_bridge", "oxe_rt1"])
def test_plain_families(spark, robot):
    df, columns, stats = table(spark, robot)
    steps = configs.compiled(robot, df, stats)
    made = steps.apply(df)
    assert "Python" not in made._jdf.queryExecution().executedPlan().toString() and made.columns == ["id", "state", "action"]
    rows = made.orderBy("id").collect()
    for m in ("state", "action"):
        leaves = configs.ROBOTS[robot].leaves(m)
        want = np.concatenate([scaled(columns[x], stats[x], mode) if (mode := configs.ROBOTS[robot].modes.get(x)) else columns[x] for x in leaves], axis=1)
        assert np.allclose([r[m] for r in rows], want)
    back = steps.unapply(made).orderBy("id").collect()
    for leaf, c in columns.items():
        mode, got = configs.ROBOTS[robot].modes.get(leaf), np.array([r[leaf] for r in back])
        want = scaled(c, stats[leaf], mode)[:, 0] if mode == "binary" else c[:, 0] if mode != "q99" else np.clip(c[:, 0], stats[leaf]["q01"], stats[leaf]["q99"])
        assert np.allclose(got, want), leaf


def test_family_with_rotations(spark):
    wide = {"state.eef_position": 3, "state.eef_rotation": 4, "action.eef_position_delta": 3, "action.eef_rotation_delta": 3}
    df, columns, stats = table(spark, "oxe_droid", wide)
    steps = configs.compiled("oxe_droid", df, stats, {"state.eef_rotation": "quaternion", "action.eef_rotation_delta": "euler_angles_rpy"})
    made = steps.apply(df)
    rows = made.orderBy("id").collect()
    m = to_matrix(columns["state.eef_rotation"], "quaternion")
    want = np.concatenate([scaled(columns["state.eef_position"], stats["state.eef_position"], "min_max"), from_matrix(m, "rotation_6d"), scaled(columns["state.gripper_position"], stats["state.gripper_position"], "min_max")], axis=1)
    assert np.allclose([r.state for r in rows], want) and len(rows[0].state) == 10
    turned = from_matrix(to_matrix(columns["action.eef_rotation_delta"], "euler_angles_rpy"), "axis_angle")
    assert np.allclose([r.action[3:6] for r in rows], turned) and {r.action[6] for r in rows} == {0.0, 1.0}
    back = steps.unapply(made).orderBy("id").collect()
    assert np.allclose(to_matrix(np.array([r["state.eef_rotation"] for r in back]), "quaternion"), m)
    assert np.allclose(to_matrix(np.array([r["action.eef_rotation_delta"] for r in back]), "euler_angles_rpy"), to_matrix(columns["action.eef_rotation_delta"], "euler_angles_rpy"))
    assert np.allclose([r["state.eef_position"] for r in back], columns["state.eef_position"])


def test_what_a_configuration_refuses(spark):
    df, _, stats = table(spark, "libero_franka", n=2)
    with pytest.raises(KeyError, match="state.yaw is not a column"):
        configs.compiled("libero_franka", df.drop(F.col("`state.yaw`")), stats)
    with pytest.raises(KeyError, match="min_max of action.x takes min and max"):
        configs.compiled("libero_franka", df, stats | {"action.x": {"min": [0.0]}})
    both = configs.Config(video=(), state=("r",), action=(), modes={"state.r": "q99"}, rotations={"state.r": "rotation_6d"})
    with pytest.raises(ValueError, match="rotated"):
        configs.compiled(both, spark.createDataFrame([([1.0] * 6,)], "`state.r` array<double>"), {})
    frames = spark.createDataFrame([(0, s, [float(s)]) for s in range(3)], "episode long, step long, action array<double>")
    assert [r.action_chunk for r in configs.with_actions(frames, "libero_franka").orderBy("step").collect()][1] == [[1.0]] + [[2.0]] * 7


def test_every_stage_of_the_calibration_chain_can_fail(spark):
    recordings = spark.createDataFrame([(p,) for p in ("fine", "named", "no entry", "no serial", "two serials", "no intrinsic", "no extrinsic", None)], "path string")
    ids = {p: f"e{k}" for k, p in enumerate(["fine", "named", "no serial", "two serials", "no intrinsic", "no extrinsic"])}
    entries = spark.createDataFrame(list(ids.items()) + [("fine", "z later")], "path string, episode_id string")
    serials = {"fine": {"a": "11"}, "named": {"wrist": "77", "b": "12"}, "two serials": {"a": "1", "b": "2"}, "no intrinsic": {"a": "13"}, "no extrinsic": {"a": "14"}}
    cameras = spark.createDataFrame([(ids[p], m) for p, m in serials.items()], "episode_id string, cameras map<string, string>")
    lens = [(ids[p], s, 100.0, 110.0, 50.0, 40.0, 200, 100) for p, s in (("fine", "11"), ("named", "77"), ("no extrinsic", "14"), ("no intrinsic", "99"))]
    intrinsics = spark.createDataFrame(lens, "episode_id string, serial string, fx double, fy double, cx double, cy double, width int, height int")
    extrinsics = spark.createDataFrame([(ids[p], s, [1.0] * 16) for p, s in (("fine", "11"), ("named", "77"), ("no intrinsic", "13"))], "episode_id string, serial string, matrix array<double>")
    got = calibration.calibrated(recordings, entries, cameras, intrinsics, extrinsics, ["wrist"])
    rows = {r.path: r for r in got.withColumn("scaled", calibration.rescaled(F.col("intrinsic"), F.lit(100), F.lit(100))).collect()}
    assert {p: r.reason for p, r in rows.items()} == {
        "fine": None, "named": None, "no entry": "missing_calibration_entry", None: "missing_calibration_entry", "no serial": "missing_camera_serial",
        "two serials": "missing_camera_serial", "no intrinsic": "missing_intrinsic", "no extrinsic": "missing_extrinsic",
    }
    assert (rows["fine"].episode_id, rows["fine"].serial, rows["named"].serial) == ("e0", "11", "77") and rows["fine"].extrinsic == [1.0] * 16
    assert tuple(rows["fine"].scaled) == (50.0, 110.0, 25.0, 40.0, 100, 100) and rows["no intrinsic"].scaled is None
    shapes = spark.createDataFrame([(0, 5), (None, 5), (4, 0), (4, 10), (4, 8), (4, 24)], "f int, n int")
    assert [r.r for r in shapes.select(calibration.positions_reason(F.col("f"), F.col("n")).alias("r")).collect()] == ["no_frames", "no_frames", "no_positions", "length_mismatch", "positions_too_short", None]
