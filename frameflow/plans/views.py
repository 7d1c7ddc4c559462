"""Views of the driver's tables as trajectories, vectors, mixtures, labels, shards, tracks and rollouts; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameflow.operators.sampling import sequential
from frameflow.operators.windows import keyframes_selected


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._frames: DataFrame | None = None

    def t(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def traj(self) -> DataFrame:
        w = Window.partitionBy("user_id").orderBy("ts", "event_id")
        return self.t("events").select(
            "event_id", F.col("user_id").alias("episode"), (F.row_number().over(w) - 1).cast("long").alias("step"), (F.col("value") % 100).alias("x"),
            F.get_json_object("props", "$.k").cast("double").alias("y"), (F.col("event_type") == "purchase").cast("long").alias("grip"), F.col("event_type").alias("task"), "value",
        )

    def gaps(self) -> DataFrame:
        """traj with coordinates missing at every fourth event, and keyframes marked."""
        gone = F.col("event_id") % 4 == 0
        return keyframes_selected(self.traj().withColumn("x", F.when(~gone, F.col("x"))).withColumn("y", F.when(~gone, F.col("y"))))

    def qa(self) -> DataFrame:
        return self.traj().where("event_id % 97 <> 0")

    def vectors(self) -> DataFrame:
        return self.t("embeddings").select("vec_id", F.col("label").cast("long").alias("tag"), F.transform("embedding", lambda v: v.cast("double")).alias("v"))

    def mix(self) -> DataFrame:
        """Events by dataset (event_type), with weight and tag."""
        weight = F.when(F.col("event_type") == "purchase", 0.5).when(F.col("event_type") == "signup", 2.0).otherwise(1.0)
        tag = F.when(F.col("event_type").isin("click", "view", "purchase"), "A").otherwise("B")
        return self.t("events").select("event_id", "user_id", F.col("event_type").alias("dataset"), weight.alias("weight"), tag.alias("tag"), "value", F.array(F.col("value"), F.get_json_object("props", "$.k").cast("double")).alias("v"))

    def frames(self) -> DataFrame:
        """Documents as frames of episodes by source, with a label where one is known. A query numbers them once."""
        if self._frames is None:
            d = self.t("documents").select("doc_id", F.col("source").alias("episode"))
            self._frames = sequential(d, 0, 0, "episode", "doc_id", shuffle=False, to="step")
        return self._frames

    def labels(self) -> DataFrame:
        return self.frames().join(self.t("labels").select("doc_id", F.col("quality").cast("long").alias("label")), "doc_id").select("episode", "step", "label")

    def shards(self) -> DataFrame:
        """Customers per nation as shards of records in key order."""
        return self.t("customer").groupBy(F.col("c_nationkey").cast("long").alias("shard")).agg(F.count(F.lit(1)).alias("length"))

    def tracks(self) -> DataFrame:
        v = self.vectors()
        both = F.arrays_zip(F.col("v").alias("a"), F.reverse("v").alias("b"))
        return v.select("tag", F.col("vec_id").alias("track"), F.posexplode(both).alias("frame", "p")).select("tag", "track", F.col("track").alias("__track"), F.col("frame").cast("long").alias("frame"), (50 + 100 * F.col("p.a")).alias("x"), (50 + 100 * F.col("p.b")).alias("y"), F.abs("p.a").alias("visibility"))

    def rollouts(self) -> DataFrame:
        return self.t("events").select("event_id", F.col("event_type").alias("task"), (F.col("value") >= 50).alias("success"), (F.col("value") >= 40).alias("baseline"), F.get_json_object("props", "$.k").cast("long").alias("steps"))


TRAJ = """traj as (select event_id, user_id as episode, row_number() over (partition by user_id order by ts, event_id) - 1 as step, value % 100 as x,
 cast(json_extract_string(props, '$.k') as double) as y, cast(event_type = 'purchase' as bigint) as grip, event_type as task, value from events)"""
GAPS0 = TRAJ + """, gaps0 as (select * replace (case when event_id % 4 <> 0 then x end as x, case when event_id % 4 <> 0 then y end as y), count(*) over (partition by episode) as n from traj)"""
GAPS = GAPS0 + """, gaps as (select *, case when n <= 2 then true when n <= 10 then step % 2 = 0
 else step = 0 or step = n - 1 or (step % greatest((n - 2) // 9, 1) = 0 and step >= (n - 2) // 9 and step <= 8 * ((n - 2) // 9)) end as is_keyframe from gaps0)"""
QA = TRAJ + ", qa as (select * from traj where event_id % 97 <> 0)"
VEC = "vec as (select vec_id, cast(label as bigint) as tag, unnest(range(len(embedding))) as dim, cast(unnest(embedding) as double) as v from embeddings)"
MIX = """mix as (select event_id, user_id, event_type as dataset, case event_type when 'purchase' then 0.5::double when 'signup' then 2.0::double else 1.0::double end as weight,
 case when event_type in ('click', 'view', 'purchase') then 'A' else 'B' end as tag, value, cast(json_extract_string(props, '$.k') as double) as k from events),
 mixlong as (select dataset, tag, weight, 0 as dim, value as v from mix union all select dataset, tag, weight, 1, k from mix)"""
LAB = """frames as (select doc_id, source as episode, row_number() over (partition by source order by doc_id) - 1 as step from documents),
 lab as (select episode, step, cast(quality as bigint) as label from frames join labels using (doc_id))"""
SHARD = "shards as (select cast(c_nationkey as bigint) as shard, count(*) as length from customer group by 1)"
TRACK = """track as (select cast(label as bigint) as tag, vec_id as track, unnest(range(len(embedding))) as frame, 50 + 100 * cast(unnest(embedding) as double) as x,
 50 + 100 * cast(unnest(list_reverse(embedding)) as double) as y, abs(cast(unnest(embedding) as double)) as visibility from embeddings)"""
ROLL = "roll as (select event_id, event_type as task, value >= 50 as success, value >= 40 as baseline, cast(json_extract_string(props, '$.k') as bigint) as steps from events)"
