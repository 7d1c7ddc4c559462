"""A resumable sink: results of a stream in shards by episode, with a manifest that says which batches are done.

    df.writeStream.foreachBatch(shard_sink(path, "episode", 1000)).option("checkpointLocation", ...).start()

A batch's rows go to path/shards/batch=<id>/shard=<n>, whatever is there from an attempt that broke off is replaced,
and then one rename puts path/manifest/<id>.json in place. A batch that has one is done: played again, it writes
nothing. Readers take the batches of the manifest alone, so they never see half a batch.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameflow.sources.sinks import read_text, write_document


def _entry(path: str, batch: int) -> str:
    return f"{path}/manifest/{batch}.json"


def shard_sink(path: str, episode: str, per_shard: int, writers: int = 8) -> Callable[[DataFrame, int], None]:
    """For foreachBatch(): shards of `per_shard` episodes, each written by up to `writers` tasks."""

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        if read_text(spark, _entry(path, batch)) is not None:
            return
        folder = f"{path}/shards/batch={batch}"
        sharded = rows.withColumn("shard", F.floor(F.col(episode) / per_shard).cast("long"))
        spread = sharded.repartition("shard", F.pmod(F.xxhash64(*rows.columns), F.lit(writers)))
        spread.write.mode("overwrite").partitionBy("shard").parquet(folder)
        held = spark.read.schema(sharded.schema).parquet(folder)
        figures = held.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(episode).alias("n_episodes"), F.min(episode).alias("first"), F.max(episode).alias("last"))
        shards = [r.asDict() for r in figures.orderBy("shard").collect()]  # a row for each shard of one batch
        write_document(spark, _entry(path, batch), {"batch": batch, "columns": json.loads(rows.schema.json()), "shards": shards})

    return write


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(batch, shard, n_rows, n_episodes, first, last) of the batches that are done."""
    schema = "batch long, shards array<struct<shard: long, n_rows: long, n_episodes: long, first: long, last: long>>"
    return spark.read.schema(schema).option("multiLine", "true").json(f"{path}/manifest/*.json").select("batch", F.inline("shards"))


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the batches that are done, with batch and shard."""
    rows = spark.read.option("basePath", f"{path}/shards").parquet(f"{path}/shards")
    return rows.join(manifest(spark, path).select("batch", "shard"), ["batch", "shard"], "left_semi")


def left_to_do(df: DataFrame, path: str, episode: str) -> DataFrame:
    """The rows of df whose episodes no finished batch holds: what a batch job that takes up the work has to do."""
    done = read_shards(df.sparkSession, path).select(episode).distinct()
    return df.join(done, episode, "left_anti")
