import time

import pytest
from pyspark.sql import functions as F

from frameflow.operators.windows import ensemble, replayed, trailing
from frameflow.streaming import machines, shards
from frameflow.streaming.control import sticky
from frameflow.streaming.frames import streaming_stats, streaming_trailing


def drained(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name).collect()


def frames(spark):
    return spark.createDataFrame([(e, s, float((s * 37 + e * 11) % 23) / 20) for e in range(4) for s in range(30)], "episode long, step long, g double")


def stream(spark, tmp_path, cuts=(10, 20, 30)):
    at = 0
    for cut in cuts:
        frames(spark).where(f"step >= {at} and step < {cut}").coalesce(1).write.parquet(str(tmp_path / f"b{cut}"))
        at = cut
        time.sleep(0.05)
    return spark.readStream.schema("episode long, step long, g double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "b*"))


def chunked(spark):
    """Frames with a time, in three batches of shuffled rows, some of which belong to the batch before; then a late clock."""
    df = frames(spark).withColumn("at", F.timestamp_seconds(F.col("step") + 0.25)).withColumn("chunk", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.array(F.col("g") + k, F.col("g") * k - F.col("step"))))
    return df.withColumn("batch", F.least(F.floor((F.col("step") + F.when((F.col("step") * 7 + F.col("episode")) % 5 == 0, 6).otherwise(0)) / 10), F.lit(2)))


def late_stream(spark, tmp_path):
    df = chunked(spark)
    for b in range(3):
        df.where(f"batch = {b}").orderBy(F.hash("episode", "step")).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{b}"))
        time.sleep(0.05)
    for k, seconds in enumerate((60, 90_000, 200_000)):  # only the clock goes on
        spark.createDataFrame([(99, k, 0.0, seconds)], "episode long, step long, g double, s long").selectExpr("episode", "step", "g", "timestamp_seconds(s) at", "array(array(0D, 0D)) chunk", f"{3 + k}L batch").coalesce(1).write.parquet(str(tmp_path / "in" / f"c{k}"))
        time.sleep(0.05)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))


def close_to(got, want):
    assert [r[:2] for r in got] == [r[:2] for r in want]
    for a, b in zip(got, want, strict=True):
        assert a[2] == pytest.approx(b[2], abs=1e-9), a


def test_machines_over_late_and_shuffled_rows_equal_batch(spark, tmp_path):
    live, batch = late_stream(spark, tmp_path), chunked(spark)
    forms = {
        "sticky_out": (machines.sticky_stream(live, "g", "at", late="12 seconds"), sticky(frames(spark), "g")),
        "replay_out": (machines.replay_stream(live, "chunk", "at", 3, late="12 seconds"), replayed(batch, "chunk", 3).select("episode", "step", "replay")),
        "ensemble_out": (machines.ensemble_stream(live, "chunk", "at", 3, 0.1, late="12 seconds"), ensemble(batch, "chunk", 3, 0.1).select("episode", "step", "ensemble")),
    }
    for name, (stream_form, batch_form) in forms.items():
        q = stream_form.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"state-{name}")).start()
        q.processAllAvailable()
        q.stop()
        got = sorted(tuple(r) for r in spark.table(name).where("episode < 99").collect())
        close_to(got, sorted(tuple(r) for r in batch_form.collect()))
        kept = spark.read.format("statestore").option("stateVarName", "kept").load(str(tmp_path / f"state-{name}"))
        assert {r[0][0] for r in kept.select("key").collect()} <= {99}  # finished episodes are forgotten


def test_trailing_stream_equals_batch(spark, tmp_path):
    want = sorted((r.episode, r.step, r.g_window) for r in trailing(frames(spark), ["g"], 5).collect())
    got = sorted((r.episode, r.step, r.xs) for r in drained(streaming_trailing(stream(spark, tmp_path), "g", "g", 5), "trail_out"))
    assert got == want


def test_streaming_statistics(spark, tmp_path):
    s = stream(spark, tmp_path).withColumn("ts", F.timestamp_seconds("step"))
    rows = drained(streaming_stats(s, "g", "ts", "10 seconds", "1 second", "episode"), "stat_out", "complete")
    assert len(rows) == 12 and all(r.n == 10 for r in rows)


def test_resumed_shards_equal_those_of_an_undisturbed_run(spark, tmp_path, monkeypatch):
    for b in range(3):
        frames(spark).where(f"step div 10 = {b}").withColumn("episode", F.col("episode") * 5 + b).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{b}"))
        time.sleep(0.05)
    live = spark.readStream.schema("episode long, step long, g double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))

    def run(name, times=1):
        for _ in range(times):
            q = live.writeStream.foreachBatch(shards.shard_sink(str(tmp_path / name), "episode", 4)).option("checkpointLocation", str(tmp_path / f"{name}-state")).start()
            try:
                q.processAllAvailable()
            finally:
                q.stop()

    def found(name):
        rows = sorted(tuple(r) for r in shards.read_shards(spark, str(tmp_path / name)).select("episode", "step", "g", "batch", "shard").collect())
        told = sorted(tuple(r) for r in shards.manifest(spark, str(tmp_path / name)).collect())
        folders = sorted(str(p.relative_to(tmp_path / name)) for p in (tmp_path / name / "shards").glob("batch=*/shard=*"))
        files = sum(1 for _ in (tmp_path / name / "shards").rglob("part-*.parquet"))
        return rows, told, folders, files

    run("whole")
    put, broken = shards.write_document, []

    def dies_once(s, path, document):
        if path.endswith("/1.json") and not broken:
            broken.append(path)
            raise RuntimeError("killed between data and manifest")
        put(s, path, document)

    monkeypatch.setattr(shards, "write_document", dies_once)
    with pytest.raises(Exception, match="killed"):
        run("broken")
    half = shards.read_shards(spark, str(tmp_path / "broken"))
    assert {r.batch for r in half.select("batch").distinct().collect()} == {0}  # the data of batch 1 is there, but not seen
    assert {r.episode % 5 for r in shards.left_to_do(frames(spark).withColumn("episode", F.explode(F.array(*(F.col("episode") * 5 + b for b in range(3))))), str(tmp_path / "broken"), "episode").collect()} == {1, 2}
    run("broken", 2)
    assert found("broken") == found("whole") and broken
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "whole").rglob("*") if p.is_file()}
    shards.shard_sink(str(tmp_path / "whole"), "episode", 4)(frames(spark), 1)  # played again
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "whole").rglob("*") if p.is_file()} == before
