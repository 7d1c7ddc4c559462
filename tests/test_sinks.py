"""Sinks, NumPy files, and operators of the loader."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameflow.operators import joins, sampling
from frameflow.sources import arrays, sinks
from frameflow.sources.npy_ranges import write_npy


def test_documents_and_appended_entries(spark, tmp_path):
    path = str(tmp_path / "a.json")
    assert sinks.append_entries(spark, path, [{"x": "é"}]) == 1 and sinks.append_entries(spark, path, [{"x": 2}]) == 2
    assert json.loads((tmp_path / "a.json").read_text()) == [{"x": "é"}, {"x": 2}]
    (tmp_path / "a.json").write_text('[{"x": ')
    assert sinks.append_entries(spark, path, [{"x": 3}]) == 1
    [aside] = [p for p in tmp_path.iterdir() if ".corrupt-" in p.name]
    assert aside.read_text() == '[{"x": '
    assert [p.name for p in tmp_path.iterdir() if "tmp" in p.name] == []


def test_report_statistics_and_shards(spark, tmp_path):
    rows = spark.createDataFrame([("b", 0.5, 0.25), ("a", 0.25, 0.5), ("c", 1.0, 1.0)], "label string, spoon double, carrot double")
    sinks.write_report(rows, str(tmp_path / "r"), "label", ["spoon", "carrot"], "m.json")
    assert [r["label"] for r in json.loads((tmp_path / "r.json").read_text())["rows"]] == ["c", "a", "b"]
    assert (tmp_path / "r.csv").read_text().splitlines()[:2] == ["label,spoon,carrot", "c,1.0,1.0"]
    assert (tmp_path / "r.md").read_text().splitlines() == ["| label | spoon | carrot |", "|---|---:|---:|", "| c | 1.0000 | 1.0000 |", "| a | 0.2500 | 0.5000 |", "| b | 0.5000 | 0.2500 |"]
    with pytest.raises(ValueError):
        sinks.few(rows, 2)
    stats = spark.createDataFrame([(1, [0.5, 0.25], [True, False])], "tag int, mean array<double>, mask array<boolean>")
    sinks.write_statistics(stats, str(tmp_path / "s.json"), "tag", spark.createDataFrame([(1, 9)], "tag int, num_transitions long"))
    assert json.loads((tmp_path / "s.json").read_text()) == {"1": {"action": {"mean": [0.5, 0.25], "mask": [True, False]}, "num_transitions": 9}}
    sinks.write_shards(spark.range(10).select(F.col("id").alias("episode"), F.lit(None).cast("int").alias("z")), str(tmp_path / "out"), "episode", 4)
    manifest = spark.read.json(str(tmp_path / "out" / "manifest.jsonl"))
    assert sorted((r.shard, r.n_rows, r["first"], r["last"]) for r in manifest.collect()) == [(0, 4, 0, 3), (1, 4, 4, 7), (2, 2, 8, 9)]


def test_trace_files(spark, tmp_path):
    rows = [(e, s, float(10 * e + s), 100.0 - s) for e in (0, 2, 3) for s in range(e + 2)]
    df = spark.createDataFrame(rows, "episode long, step long, x double, y double").repartition(3)
    told = arrays.write_traces(df, str(tmp_path), "set", 5)
    assert (told["row_count"], told["present_episodes"], told["missing_episodes_preview"]) == (11, 3, [1, 4]) and told["coordinate_max"] == [34.0, 100.0]
    assert told["rows_per_present_episode"] == {"min": 2, "median": 4.0, "max": 5} and told["step_mismatches_preview"] == []
    with pytest.raises(FileExistsError):
        arrays.write_traces(df, str(tmp_path), "set", 5)
    assert np.load(tmp_path / "set_offsets.npy").tolist() == [0, 2, 2, 6, 11, 11]
    assert np.load(tmp_path / "set_present.npy").tolist() == [True, False, True, True, False]
    got = sorted((r.episode, r.step, r.x, r.y) for r in arrays.traces(spark, str(tmp_path), "set", scale=1.0).collect())
    assert got == rows
    (tmp_path / "set_present.npy").unlink()
    assert arrays.traces(spark, str(tmp_path), "set").count() == len(rows)
    w = {(r.episode, r.step): r.x_window for r in arrays.trace_windows(spark, str(tmp_path), "set", 3, 1.0).collect()}
    assert w[2, 0] == [20.0, 20.0, 20.0] and w[2, 3] == [21.0, 22.0, 23.0]


def test_traces_that_cannot_be_written_leave_no_file(spark, tmp_path):
    good = spark.range(5000).selectExpr("id div 50 episode", "id % 50 step", "double(id) x", "1.0D y")
    for bad, match in ((good.withColumn("episode", F.col("episode") - 1), "no place"), (good.withColumn("x", F.when(F.col("episode") != 7, F.col("x"))), "no place")):
        with pytest.raises(ValueError, match=match):
            arrays.write_traces(bad, str(tmp_path), "set", 100)
    told = arrays.write_traces(good.withColumn("x", F.when(F.col("episode") != 7, F.col("x"))).withColumn("step", F.col("step") + (F.col("episode") == 3).cast("int")), str(tmp_path), "holes", 100, allow_null=True)
    assert told["missing_episodes_preview"] == [7] and told["row_count"] == 4950 and told["step_mismatches_preview"][0] == {"episode": 3, "expected": 0, "step": 1} and len(told["step_mismatches_preview"]) == 20
    rows = spark.range(1000).selectExpr("id pos", "double(id) v")
    path = str(tmp_path / "a.npy")
    with pytest.raises(Exception, match="written twice"):
        write_npy(rows.union(rows.limit(1)), path, "<f8", 1000)
    with pytest.raises(Exception, match="these were written"):
        write_npy(rows.where("pos <> 500"), path, "<f8", 1000)
    with pytest.raises(Exception, match="outside"):
        write_npy(rows, path, "<f8", 999)
    with pytest.raises(Exception, match="lost"):
        write_npy(rows.withColumn("v", F.when(F.col("pos") == 700, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("v"))).repartition(4), path, "<f8", 1000)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["holes_coords.npy", "holes_offsets.npy", "holes_present.npy"]
    write_npy(rows.repartition(7), path, "<f8", 1000)
    assert (np.load(path) == np.arange(1000)).all()
    write_npy(rows.where("pos < 0"), path, "<f8", 0)
    assert np.load(path).shape == (0,)


def test_many_points_in_one_hot_episode(spark, tmp_path):
    df = spark.range(1_000_000).selectExpr("if(id % 3 = 0, 5, id % 999) episode", "id step", "float(id % 977) x", "float(id % 31) y")
    told = arrays.write_traces(df, str(tmp_path), "set", 1000)
    assert told["row_count"] == 1_000_000
    want = sorted((5 if i % 3 == 0 else i % 999, i) for i in range(1_000_000))
    assert (np.load(tmp_path / "set_coords.npy")[:, 0] == np.array([i % 977 for _, i in want], np.float32)).all()
    offsets = np.load(tmp_path / "set_offsets.npy")
    assert offsets.tolist() == np.searchsorted([e for e, _ in want], range(1001)).tolist()


def test_archives(spark, tmp_path):
    folder = tmp_path / "t" / "g" / "episodes"
    folder.mkdir(parents=True)
    np.savez(folder / "one.npz", actions=np.arange(6).reshape(3, 2))
    np.savez(tmp_path / "other.npz", delta=np.zeros((2, 2)))
    listed = spark.createDataFrame([("one", "t", "g", 3, None), ("two", "t", "g", 2, str(tmp_path / "other.npz"))], "episode_name string, task string, tag string, length int, source_npz string")
    got = arrays.episodes(spark, listed, str(tmp_path), ["actions", "delta"])
    assert sorted((r.episode_name, r.step, r.action) for r in got.collect())[:2] == [("one", 0, [0.0, 1.0]), ("one", 1, [2.0, 3.0])] and got.count() == 5
    with pytest.raises(Exception, match="not 4"):
        arrays.episodes(spark, listed.withColumn("length", F.lit(4)), str(tmp_path), ["actions", "delta"]).collect()


def test_calibration_and_state_keys(spark):
    c = spark.range(1).select(F.create_map(F.lit("123"), F.array(*[F.lit(0.0)] * 6), F.lit("x1"), F.array(*[F.lit(0.0)] * 6), F.lit("77"), F.array(F.lit(0.0))).alias("c"), F.create_map(F.lit("wrist"), F.lit("99"), F.lit("note"), F.lit("abc")).alias("m"))
    r = c.select(joins.serials(F.col("c")).alias("s"), joins.serial_of(F.col("m"), "left", "wrist").alias("a"), joins.serial_of(F.col("m"), "left").alias("b"), joins.serial_of(F.map_from_arrays(F.array(F.lit("p"), F.lit("q")), F.array(F.lit("1"), F.lit("2"))), "left").alias("d")).first()
    assert (r.s, r.a, r.b, r.d) == (["123"], "99", "99", None)
    assert joins.state_for_action("action.arm", ["state.arm"]) == "state.arm" and joins.state_for_action("action.arm", []) is None
    assert joins.state_for_action("action.arm", ["state.arm"], {"action.arm": "state.other"}) == "state.other" and joins.state_for_action("arm", ["state.arm"]) is None


def test_loader_orders(spark):
    steps = spark.range(60).selectExpr("id % 2 ds", "id")
    one, two, again = ({(r.ds, r.place): r.id for r in sampling.sequential(steps, e, 7, "ds", "id").collect()} for e in (0, 1, 0))
    assert one == again != two and sorted(one.values()) == list(range(60)) and {k[1] for k in one} == set(range(30))
    assert [r.id for r in sampling.sequential(steps, 0, 7, "ds", "id", shuffle=False).where("ds = 1").orderBy("place").collect()] == list(range(1, 60, 2))
    lengths = spark.range(200).selectExpr("id ep", "pmod(hash(id), 500) n")
    picked = [r.ep for r in sampling.stratified(lengths, "ep", "n", 20, 3).collect()]
    assert len(set(picked)) == 20 and {int(i * 199 / 13) for i in range(14)} <= set(picked) and sampling.stratified(lengths, "ep", "n", 300, 3).count() == 200
    sets = lambda *rows: spark.createDataFrame(rows, "length double, weight double")
    steps = lambda *rows, balanced=False: sampling.epoch_length(sets(*rows), "length", "weight", balanced)
    assert steps((100.0, 1.0), (900.0, 0.5)) == 150 and steps((100.0, 1.0), (900.0, 0.5), balanced=True) == 550
    assert steps((100.0, 0.25), (90.0, 0.5), (7.0, 0.75)) == 14 and steps((100.0, 0.25), (90.0, 0.5), (7.0, 0.5)) == 225
    assert steps((0.0, 1.0), (90.0, 0.5)) == 90 and steps((0.0, 1.0)) == 0


def test_derived_columns_and_settings(spark):
    from frameflow.operators import derive

    df = spark.createDataFrame([([1.0, 2.0, 3.0, 9.0], [4.0, 5.0, 6.0], [7.0])], "`steps/action/world_vector` array<double>, `steps/action/rotation_delta` array<double>, `steps/action/gripper_closedness_action` array<double>")
    got = derive.derived(df, "fractal")
    assert got.columns[3:] == ["action"] and got.first().action == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0]
    single = df.select(*(F.col(f"`{c}`")[0].cast("float").alias(c) if "gripper" in c else F.col(f"`{c}`") for c in df.columns))
    assert derive.derived(single, "fractal").first().action == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0]
    arms = spark.range(1).select(F.array(*(F.lit(float(i)) for i in range(14))).alias("a"))
    model = arms.select(derive.arms_to_model(F.col("a")).alias("m"))
    assert model.first().m == [0, 1, 2, 3, 4, 5, 7, 8, 9, 10, 11, 12, 6, 13]
    assert model.select(derive.arms_to_robot(F.col("m")).alias("r")).first().r == list(range(14))
    short = arms.select(F.slice("a", 1, 13).alias("a"))
    assert short.select(derive.arms_to_model(F.col("a")).alias("r")).first().r == short.select(derive.arms_to_robot(F.col("a")).alias("r")).first().r == list(range(13))
    assert derive.derived(got.select(F.lit(1).alias("action")), "fractal").columns == ["action"] and derive.derived(df, "other").columns == df.columns
    assert [derive.as_bool(v) for v in (None, "No", " off ", "yes", 0, True, "")] == [False, False, False, True, False, True, False]
    assert [derive.as_list(v) for v in (None, "", "a, b,,", ["x", 1])] == [None, None, ["a", "b"], ["x", "1"]]
    assert derive.schedule(8)["query_hz"] == 5.0
    for horizon in (0, 9):
        with pytest.raises(ValueError):
            derive.schedule(8, horizon=horizon)
    ok = spark.range(3).select(derive.in_range(F.col("id"), F.lit(3)).alias("i"))
    assert [r.i for r in ok.collect()] == [0, 1, 2]
    with pytest.raises(Exception, match="out of range"):
        spark.range(4).select(derive.in_range(F.col("id"), F.lit(3)).alias("i")).collect()


def test_collated_batches(spark):
    from frameflow.operators import derive

    df = spark.createDataFrame([(0, 2, [3]), (0, 1, [1, 2]), (0, 3, []), (1, 1, [9])], "b int, o int, x array<int>")
    got = {r.b: r for r in derive.collated(df, "b", "o", "x", F.lit(-1)).collect()}
    assert (got[0]["items"], got[0].lengths, got[0].starts, got[0].longest) == ([[1, 2], [3, -1], [-1, -1]], [2, 1, 0], [0, 2, 3, 3], 2)
    assert got[1]["items"] == [[9]]


def test_footers_and_rewritten_arrays(spark, tmp_path):
    import pyarrow.parquet as pq

    from frameflow.sources import datasets, json_array

    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "p"))
    file = next((tmp_path / "p").glob("*.parquet"))
    meta = pq.read_metadata(file)
    row = datasets.footer_sizes(spark, str(tmp_path / "p")).collect()
    assert len(row) == 1 and row[0].mb == pytest.approx(meta.row_group(0).column(0).total_uncompressed_size / 1024**2)
    (tmp_path / "a.json").write_text('[{"episode_idx": 1, "t": "é"}, {"episode_idx": 2}]')
    target = str(tmp_path / "b.json")
    moved = lambda v: F.to_json(F.transform_values(F.from_json(v, "map<string, string>"), lambda k, x: F.when(k == "episode_idx", (x.cast("long") + 10).cast("string")).otherwise(x)))
    json_array.rewrite(spark, str(tmp_path / "a.json"), target, moved)
    assert (tmp_path / "b.json").read_text() == '[{"episode_idx":"11","t":"é"},{"episode_idx":"12"}]\n'
    with pytest.raises(FileExistsError):
        json_array.rewrite(spark, str(tmp_path / "a.json"), target, moved)
