import io
import json
import struct

import pytest
from pyspark.sql import functions as F

from frameflow.sources import datasets, json_array, tfrecord
from frameflow.sources.byte_files import Range, ranges
from frameflow.sources.json_array import JsonArraySource, elements, read_json_array, rewrite
from frameflow.sources.text import episode_list
from frameflow.sources.tfrecord import TFRecordSource, example, records, write_records


def test_tfrecord_round_trip(spark, tmp_path):
    rows = [{"id": [k], "x": [k * 0.5, -1.0], "name": [b"r%d" % k], "neg": [-k - 1]} for k in range(2500)]
    write_records(str(tmp_path / "a.tfrecord"), rows[:1500])
    write_records(str(tmp_path / "b.tfrecord"), rows[1500:])
    spark.dataSource.register(TFRecordSource)
    df = spark.read.format("tfrecord_examples").schema("id long, x array<float>, name string, neg long, gone string").option("splitBytes", 4096).load(str(tmp_path))
    assert df.rdd.getNumPartitions() > 10
    got = sorted(df.collect())
    assert len(got) == 2500 and tuple(got[7]) == (7, [3.5, -1.0], "r7", -8, None)
    with open(tmp_path / "a.tfrecord", "rb") as f:
        assert example(next(records(f)))["name"] == [b"r0"]


def test_every_split_of_a_tfrecord_file_gives_the_same_records(tmp_path):
    path = str(tmp_path / "a.tfrecord")
    rows = [{"id": [k], "x": [float(v) for v in range(k % 40)]} for k in range(120)]
    write_records(path, rows)
    size = (tmp_path / "a.tfrecord").stat().st_size
    want = list(tfrecord.records_in(Range(path, 0, size, size)))
    assert [example(p)["id"][0] for p in want] == list(range(120))
    for n in (1, 7, 50, 333, 1000, size - 1, size, size + 1):
        parts = [list(tfrecord.records_in(p)) for p in tfrecord.splits(str(tmp_path), n)]
        assert [p for part in parts for p in part] == want and (n > 1 or max(map(len, parts)) == 1)
    assert [tfrecord.record_at(path, k) for k in (0, 57, 119)] == [want[k] for k in (0, 57, 119)]
    with pytest.raises(IndexError):
        tfrecord.record_at(path, 120)
    data = (tmp_path / "a.tfrecord").read_bytes()
    read = lambda n: [p for part in tfrecord.splits(path, n) for p in tfrecord.records_in(part)]
    for cut in (5, 13, size // 2, size - 1):
        (tmp_path / "a.tfrecord").write_bytes(data[:cut])
        for n in (100, size):
            with pytest.raises(ValueError):
                read(n)
    broken = bytearray(data)
    third = 2 * 16 + sum(map(len, want[:2]))
    broken[third] ^= 1
    (tmp_path / "a.tfrecord").write_bytes(broken)
    with pytest.raises(ValueError):
        read(64)
    bare = b"".join(struct.pack("<Q", len(p)) + bytes(4) + p + bytes(4) for p in want)
    (tmp_path / "a.tfrecord").write_bytes(bare)  # no CRCs: one range
    assert read(100) == want and len(tfrecord.splits(path, 100)) == 1
    (tmp_path / "a.tfrecord").write_bytes(b"")
    assert read(100) == []


def test_crc_of_the_format():
    assert tfrecord.masked_crc(b"123456789") == (((0xE3069283 >> 15) | (0xE3069283 << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def test_cut_off_record():
    with pytest.raises(ValueError, match="cut off"):
        list(records(io.BytesIO(b"\x05" + bytes(11) + b"ab")))


@pytest.mark.parametrize("chunk", [1, 3, 1 << 20])
def test_json_array_elements(chunk):
    data = [1, 22.5, "a,]b", {"k": [1, {"z": "é"}]}, [], None, True]
    assert list(elements(io.StringIO(json.dumps(data)), chunk)) == data
    assert list(elements(io.StringIO(" [ ] "), chunk)) == []
    for bad in ("{}", "[1, 2", "[1 2]", "[1] x"):
        with pytest.raises(ValueError):
            list(elements(io.StringIO(bad), chunk))


def test_json_array_source(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"i": k} for k in range(5000)]))
    spark.dataSource.register(JsonArraySource)
    df = spark.read.format("json_array").load(str(tmp_path / "a.json"))
    assert df.count() == 5000 and json.loads(df.where("position = 4321").first().value) == {"i": 4321}


def test_dataset_layouts(spark, tmp_path):
    root = tmp_path / "v2"
    frames = spark.createDataFrame([(e, f, [float(k) for k in range(7)]) for e in range(3) for f in range(4)], "episode_index long, frame_index long, action array<float>")
    for e in range(3):
        frames.where(f"episode_index = {e}").coalesce(1).write.parquet(str(root / f"data/chunk-000/episode_{e:06d}.parquet"))
    (root / "meta").mkdir()
    (root / "meta/episodes.jsonl").write_text('{"episode_index": 0, "length": 4, "tasks": ["a"]}\n')
    (root / "meta/tasks.jsonl").write_text('{"task_index": 0, "task": "a"}\n\n')
    (root / "meta/info.json").write_text(json.dumps({"chunks_size": 1000}))
    (root / "meta/modality.json").write_text(json.dumps({"action": {"xyz": {"start": 0, "end": 3}, "grip": {"start": 6, "end": 7}}}))
    d = datasets.Dataset(spark, str(root))
    assert d.version == "v2.0" and d.frames.count() == 12 and d.episode(1).count() == 4 and d.tasks.first().task == "a"
    row = d.view(d.frames, "action", "xyz", "grip").first()
    assert row["action.xyz"] == [0.0, 1.0, 2.0] and row["action.grip"] == [6.0]
    with pytest.raises(KeyError):
        d.view(d.frames, "action", "nope")
    v3 = tmp_path / "v3"
    datasets.write_frames(frames, str(v3 / "data"))
    spark.createDataFrame([(0, "a")], "task_index long, `__index_level_0__` string").write.parquet(str(v3 / "meta/tasks.parquet"))
    d = datasets.Dataset(spark, str(v3))
    assert d.version == "v3.0" and d.episode(2).count() == 4 and d.tasks.first().task == "a"


def test_feature_leaves():
    f = {"steps": {"features": {"observation": {"features": {"state": {"dtype": "float32", "shape": [7]}}}, "reward": {"dtype": "float16"}}}}
    assert datasets.leaves(f) == [("steps/observation/state", "float32", 7), ("steps/reward", "float16", 1)]
    assert datasets.leaf_type("float16").simpleString() == "float" and datasets.leaf_type("odd").simpleString() == "bigint" and datasets.leaf_type("float32", 7).simpleString() == "array<float>"


def test_traces_labels_and_lists(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"suite": "spatial", "image_size": [101, 101], "view": "v", "episodes": {"3": {"coords": [[0, 50], [100, 100]]}}}))
    assert sorted(tuple(r) for r in datasets.traces(spark, str(tmp_path / "t.json")).collect()) == [("spatial", 3, 0, 0.0, 50.0), ("spatial", 3, 1, 100.0, 100.0)]
    (tmp_path / "l.jsonl").write_text("\n".join(json.dumps({"dataset_name": "d", "episode_index": 7, "step_index": s, "indices": i}) for s, i in ((0, [1, 2]), (3, [3, 4]), (3, [5]))))
    assert {r.step_index: r.indices for r in datasets.labels(spark, str(tmp_path / "l.jsonl")).collect()} == {0: [1, 2], 3: [5]}
    (tmp_path / "e.txt").write_text("# all\n12 x\n7\n12\nfoo\n")
    assert sorted(r.episode for r in episode_list(spark, str(tmp_path / "e.txt")).collect()) == [7, 12]
    (tmp_path / "none.txt").write_text("# nothing\n")
    with pytest.raises(ValueError):
        episode_list(spark, str(tmp_path / "none.txt"))


def test_elements_across_reads():
    for text in ('[]', ' [ 1 , 22, -3.5e2 ,"a,]b", {"x": [1, 2]}, null, [[]] ] ', "[123]", '["' + "x" * 500 + '", 7]'):
        for chunk in (1, 2, 3, 7, 1000):
            assert list(elements(io.StringIO(text), chunk)) == json.loads(text)
    for text in ("", "{}", "[1", "[1 2]", "[1] 2", "[1,"):
        with pytest.raises(ValueError):
            list(elements(io.StringIO(text), 2))


AWKWARD = [1, -22.5e3, "a,]b", 'q"\\\\', "\\\\\\", {"k": [1, {"z": "é,["}], "e": {}}, [], None, True, [[[]]], "", "[" * 9, "\\\"," * 5]


def texts_of(path, n):
    parts = ranges(str(path), n)
    found = {k: json_array._summary(p.path, p.start, p.end) for k, p in enumerate(parts)}
    names = ("path", "start", "end", "size", "inside", "depth", "commas", "first")
    out = [e for r in json_array._begun(parts, found) for e in json_array._range_elements(dict(zip(names, r, strict=True)))]
    return out


@pytest.mark.parametrize("blank", ["", " \n "])
def test_every_split_of_a_json_array_gives_the_same_elements(tmp_path, blank):
    path = tmp_path / "a.json"
    for data in (AWKWARD, [], [[]], [{"a": 1}], ["x" * 100, 1]):
        path.write_text(blank + json.dumps(data, ensure_ascii=False, indent=1 if blank else None) + blank)
        for n in (1, 2, 3, 5, 8, 13, 64, 10_000):
            got = texts_of(path, n)
            assert [k for k, _ in got] == list(range(len(data))) and [json.loads(t) for _, t in got] == data, (n, data)


def test_json_array_in_ranges(spark, tmp_path):
    data = [{"i": k, "t": AWKWARD[k % len(AWKWARD)]} for k in range(3000)]
    (tmp_path / "a.json").write_text(json.dumps(data))
    (tmp_path / "b.json").write_text(json.dumps(AWKWARD, indent=2))
    df = read_json_array(spark, str(tmp_path / "*.json"), 5000)
    assert df.rdd.getNumPartitions() > 15
    rows = sorted(df.collect())
    assert [json.loads(r.value) for r in rows] == data + AWKWARD and [r.position for r in rows] == [*range(3000), *range(len(AWKWARD))]
    for bad in ("", "{}", "[1, 2", "[1 2]", "[1] x", "[1,]", "[,1]", '["a', "[1]]", "   ", '["a"] ["b"]'):
        (tmp_path / "bad.json").write_text(bad)
        for n in (2, 1000):
            with pytest.raises(Exception):  # noqa: B017
                read_json_array(spark, str(tmp_path / "bad.json"), n).collect()


def test_json_array_rewritten_by_tasks(spark, tmp_path):
    data = [{"i": k, "t": "é" * (k % 50)} for k in range(2000)]
    source, target = tmp_path / "a.json", tmp_path / "b.json"
    source.write_text(json.dumps(data))
    n = rewrite(spark, str(source), str(target), lambda v: F.concat(F.lit('{"was":'), v, F.lit("}")), split_bytes=3000)
    assert json.loads(target.read_text()) == [{"was": d} for d in data] and n == target.stat().st_size
    with pytest.raises(FileExistsError):
        rewrite(spark, str(source), str(target), lambda v: v)
    rewrite(spark, str(source), str(source), lambda v: v, overwrite=True)
    assert json.loads(source.read_text()) == data
    source.write_text("[]")
    rewrite(spark, str(source), str(target), lambda v: v, overwrite=True)
    assert json.loads(target.read_text()) == [] and sorted(p.name for p in tmp_path.iterdir()) == ["a.json", "b.json"]


def test_files_of_episodes_take_their_names_whole(spark, tmp_path):
    df = spark.range(500).selectExpr("id % 7 + 999 episode_index", "id div 7 frame_index", "array(float(id)) action")
    root = str(tmp_path / "d")
    told = datasets.write_episodes(df, root)
    assert sorted((r.episode, r.n_rows) for r in told.collect()) == [(999 + e, 72 if e < 3 else 71) for e in range(7)]
    names = sorted(str(p.relative_to(root)) for p in (tmp_path / "d").rglob("*") if p.is_file())
    assert names[:2] == ["data/chunk-000/episode_000999.parquet", "data/chunk-001/episode_001000.parquet"] and len(names) == 7
    one = spark.read.parquet(f"{root}/{names[1]}")
    assert [r.frame_index for r in one.collect()] == list(range(72)) and {r.episode_index for r in one.collect()} == {1000}
    with pytest.raises(Exception, match="FileExistsError"):
        datasets.write_episodes(df, root)
    datasets.write_episodes(df.withColumn("action", F.array(F.lit(-1.0))), root, overwrite=True)
    assert spark.read.parquet(f"{root}/data/*/*.parquet").select("action").distinct().collect()[0].action == [-1.0]
    broken = df.withColumn("action", F.when(F.col("frame_index") < 60, F.col("action")).otherwise(F.array(F.raise_error(F.lit("lost")).cast("float"))))
    with pytest.raises(Exception, match="lost"):
        datasets.write_episodes(broken, str(tmp_path / "e"))
    assert not [p for p in (tmp_path / "e").rglob("*") if p.is_file() and "tmp" in p.name]


def test_rows_in_file_order(spark, tmp_path):
    for k, name in enumerate(["b", "a", "c"]):
        spark.createDataFrame([(10 * k + i,) for i in range(5)], "v long").coalesce(1).write.parquet(str(tmp_path / "d" / name))
    got = datasets.in_file_order(spark, str(tmp_path / "d")).orderBy("index").collect()
    assert [r.v for r in got] == [*range(10, 15), *range(5), *range(20, 25)] and [r["index"] for r in got] == list(range(15))


def test_bad_lines_have_numbers(spark, tmp_path):
    lines = [json.dumps({"i": k, "pad": "x" * (k % 50)}) for k in range(3000)]
    for k in (0, 1234, 2999):
        lines[k] = f'{{"i": {k}'
    lines[7] = "   "
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.jsonl").write_text('{"i": 1}\nnope\n')
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        found = datasets.bad_lines(spark, str(tmp_path / "*.jsonl"))
        assert sorted((r.path[-7:], r.line) for r in found.collect()) == [("a.jsonl", 1), ("a.jsonl", 1235), ("a.jsonl", 3000), ("b.jsonl", 2)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_conversations_of_both_kinds(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "image": "a.png"}, {"id": 2}]))
    (tmp_path / "b.jsonl").write_text('{"id": 3, "video": "v.mp4"}\n\n{"id": 4}\n')
    got = datasets.conversations(spark, str(tmp_path / "a.json"), str(tmp_path / "b.jsonl"))
    assert sorted((r.id, r.image, r.video) for r in got.collect()) == [(1, "a.png", None), (2, None, None), (3, None, "v.mp4"), (4, None, None)]
