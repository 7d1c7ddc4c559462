"""Queries over vectors and mixtures: statistics, normalisation, sampling, splits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from frameflow.operators import checks, derive, joins, sampler
from frameflow.operators import sampling as P
from frameflow.operators import stats as S
from frameflow.operators.joins import first_of
from frameflow.plans.registry import query
from frameflow.plans.views import MIX, ROLL, TRAJ, VEC

_LIN = "tag, dim, count(v) as n, avg(v) as mean, stddev_pop(v) as std, min(v) as min, max(v) as max"
_STATS = f"st as (select {_LIN}, quantile_cont(v, 0.01) as q_low, quantile_cont(v, 0.99) as q_high from vec group by tag, dim)"
_GLOBAL = "st as (select dim, avg(v) as mean, stddev_pop(v) as std, min(v) as min, max(v) as max, quantile_cont(v, 0.01) as q_low, quantile_cont(v, 0.99) as q_high from vec group by dim)"


@query(f"with {VEC}, {_STATS} select * from st")
def vector_stats(v):
    return S.vector_stats(v.vectors(), "v", "tag").withColumn("dim", F.col("dim").cast("long"))


@query(f"with {VEC} select dim, count(v) as n, avg(v) as mean, stddev_pop(v) as std, min(v) as min, max(v) as max from vec group by dim")
def running_stats(v):
    return S.merged(S.sums(v.vectors(), "v", "tag")).withColumn("dim", F.col("dim").cast("long"))


@query("select vec_id, embedding[4]::double as s0, embedding[5]::double as s1, embedding[6]::double as s2 from embeddings")
def modality_slice(v):
    return v.vectors().select("vec_id", F.slice("v", 4, 3).alias("s")).select("vec_id", *(F.col("s")[k].alias(f"s{k}") for k in range(3)))


@query("select vec_id, embedding[10]::double as c0, embedding[11]::double as c1, embedding[1]::double as c2, embedding[2]::double as c3, 4 as size from embeddings")
def vector_concat(v):
    c = F.concat(F.slice("v", 10, 2), F.slice("v", 1, 2))
    return v.vectors().select("vec_id", c.alias("c")).select("vec_id", *(F.col("c")[k].alias(f"c{k}") for k in range(4)), F.size("c").cast("long").alias("size"))


@query("select vec_id from embeddings where vec_id % 3 <> 0")
def finite_rows(v):
    spoilt = F.when(F.col("vec_id") % 3 == 0, F.concat(F.slice("v", 1, 63), F.array(F.lit(float("nan"))))).otherwise(F.col("v"))
    return v.vectors().withColumn("v", spoilt).where(S.finite("v")).select("vec_id")


@query("select vec_id, embedding[1]::double as trace_x, embedding[2]::double as trace_y from embeddings")
def split_xy(v):
    return v.vectors().select("vec_id", F.element_at("v", 1).alias("trace_x"), F.element_at("v", 2).alias("trace_y"))


@query("select vec_id, cast(vec_id % 70 as bigint) as want, case when vec_id % 70 <= 64 then coalesce(list_sum(embedding[1:(vec_id % 70)::int]::double[]), 0) else list_sum(embedding::double[]) end as total, cast(vec_id % 70 as bigint) as size from embeddings")
def leaf_pad(v):
    n = (F.col("vec_id") % 70).cast("int")
    padded = F.concat(F.slice("v", F.lit(1), n), F.array_repeat(F.lit(0.0), F.greatest(n - 64, F.lit(0))))
    total = F.aggregate(padded, F.lit(0.0), lambda s, x: s + x)
    return v.vectors().select("vec_id", n.cast("long").alias("want"), total.alias("total"), F.size(padded).cast("long").alias("size"))


def _beside(v):
    """Vectors by dimension with the statistics of all vectors."""
    st = S.as_arrays(S.vector_stats(v.vectors(), "v"), "mean", "std", "min", "max", "q_low", "q_high")
    return S.beside(v.vectors(), "v", st, "vec_id")


def _normal(v, mode, low, high):
    j = _beside(v)
    return j.select("vec_id", F.col("dim").cast("long").alias("dim"), S.normalise(F.col("v"), mode, F.col(low), F.col(high)).alias("z"))


@query(f"with {VEC}, {_GLOBAL} select vec_id, dim, greatest(-1, least(1, case when q_low = q_high then v else 2 * (v - q_low) / (q_high - q_low) - 1 end)) as z from vec join st using (dim)")
def norm_q99(v):
    return _normal(v, "q99", "q_low", "q_high")


@query(f"with {VEC}, {_GLOBAL} select vec_id, dim, case when std = 0 then v else (v - mean) / std end as z from vec join st using (dim)")
def norm_mean_std(v):
    return _normal(v, "mean_std", "mean", "std")


@query(f"with {VEC}, {_GLOBAL} select vec_id, dim, case when min = max then 0 else 2 * (v - min) / (max - min) - 1 end as z from vec join st using (dim)")
def norm_min_max(v):
    return _normal(v, "min_max", "min", "max")


@query(f"with {VEC}, {_GLOBAL} select vec_id, dim, case when greatest(abs(min), abs(max)) = 0 then 0 else v / greatest(abs(min), abs(max)) end as z from vec join st using (dim)")
def norm_scale(v):
    return _normal(v, "scale", "min", "max")


@query(f"with {VEC} select vec_id, dim, (v > 0.5)::int::double as z from vec")
def norm_binary(v):
    return S.long_form(v.vectors(), "v", "vec_id").select("vec_id", F.col("dim").cast("long").alias("dim"), S.normalise(F.col("v"), "binary").alias("z"))


@query(f"with {VEC}, {_GLOBAL}, z as (select vec_id, dim, 2 * (v - min) / (max - min) - 1 as z, v, mean, std from vec join st using (dim)) select vec_id, dim, z, v as back, std * z + mean as wide from z")
def norm_roundtrip(v):
    j = _beside(v)
    z = S.normalise(F.col("v"), "min_max", F.col("min"), F.col("max"))
    back, wide = S.denormalise(z, "min_max", F.col("min"), F.col("max")), S.denormalise(z, "mean_std", F.col("mean"), F.col("std"))  # without clip
    return j.select("vec_id", F.col("dim").cast("long").alias("dim"), z.alias("z"), back.alias("back"), wide.alias("wide"))


@query(f"with {VEC}, {_GLOBAL} select vec_id, dim, case when dim % 7 <> 6 and q_low <> q_high then greatest(-1, least(1, 2 * (v - q_low) / (q_high - q_low) - 1)) else (v > 0.5)::int::double end as z from vec join st using (dim)")
def norm_masked(v):
    j = _beside(v)
    return j.select("vec_id", F.col("dim").cast("long").alias("dim"), S.masked_normalise(F.col("v"), F.col("q_low"), F.col("q_high"), F.col("dim") % 7 != 6).alias("z"))


@query(f"""with {VEC}, {_GLOBAL}, c as (select *, greatest(-1, least(1, v * 3)) as c from vec join st using (dim)), g as (select *, case when dim = 6 then (c >= 0.5)::int::double else c end as g from c)
 select vec_id, dim, case when dim <> 6 then (g + 1) / 2 * (q_high - q_low) + q_low else g end as a from g""")
def unnorm_policy(v):
    j = _beside(v)
    a = S.policy_denormalise(F.col("v") * 3, F.col("dim"), F.col("q_low"), F.col("q_high"), F.col("dim") != 6)
    return j.select("vec_id", F.col("dim").cast("long").alias("dim"), a.alias("a"))


@query(f"with {VEC}, {_GLOBAL} select vec_id, dim, greatest(-1, least(1, v)) * std + mean as a from vec join st using (dim)")
def unnorm_joint(v):
    j = _beside(v)
    clipped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("v")))
    return j.select("vec_id", F.col("dim").cast("long").alias("dim"), S.denormalise(clipped, "mean_std", F.col("mean"), F.col("std")).alias("a"))


@query(f"with {VEC} select vec_id, dim, sin(v) as f from vec union all select vec_id, dim + 64, cos(v) from vec")
def sincos(v):
    return v.vectors().select("vec_id", F.posexplode(S.sincos("v")).alias("dim", "f")).select("vec_id", F.col("dim").cast("long").alias("dim"), "f")


@query("""with a as (select vec_id, case when vec_id % 3 = 0 then embedding[1:13] else embedding[1:14] end::double[] as a from embeddings)
 select vec_id, array_to_string(list_transform(case when len(a) = 14 then a[1:6] || a[8:13] || [a[7]] || [a[14]] else a end, lambda x: round(x * 1000)::bigint), ',') as model,
 array_to_string(list_transform(case when len(a) = 14 then a[1:6] || [a[13]] || a[7:12] || [a[14]] else a end, lambda x: round(x * 1000)::bigint), ',') as robot from a""")
def arm_permute(v):
    arms = v.vectors().select("vec_id", F.slice("v", 1, F.when(F.col("vec_id") % 3 == 0, 13).otherwise(14)).alias("a"))
    text = lambda c: F.array_join(F.transform(c, lambda x: F.round(x * 1000).cast("long").cast("string")), ",")
    return arms.select("vec_id", text(derive.arms_to_model(F.col("a"))).alias("model"), text(derive.arms_to_robot(F.col("a"))).alias("robot"))


_CODES = "codes as (select vec_id as code, embedding[1:8]::double[] as centre from embeddings where vec_id < 16)"


@query(f"with {_CODES}, d as (select vec_id, code, list_sum([(a - b) * (a - b) for a, b in list_zip(embedding[1:8]::double[], centre)]) as d from embeddings, codes) select vec_id, arg_min(code, struct_pack(d := d, c := code)) as code from d group by 1".replace("[(a - b) * (a - b) for a, b in list_zip(embedding[1:8]::double[], centre)]", "list_transform(range(1, 9), lambda i: (embedding[i]::double - centre[i]) * (embedding[i]::double - centre[i]))"))
def vq_assign(v):
    d = v.vectors().withColumn("h", F.slice("v", 1, 8))
    return S.nearest_code(d, "h", d.where("vec_id < 16").select(F.col("vec_id").alias("code"), F.col("h").alias("centre")), "vec_id").select("vec_id", "code")


@query(f"with {VEC}, e as (select dim, v - 0.1 * dim / 64 as e from vec) select dim, avg(abs(e)) as mae, sqrt(avg(e * e)) as rmse, sqrt(sum(e * e)) / count(*) as l2_per_element from e group by dim")
def action_error(v):
    e = S.long_form(v.vectors(), "v", "vec_id").select(F.col("dim").cast("long").alias("dim"), (F.col("v") - 0.1 * F.col("dim") / 64).alias("e"))
    return e.groupBy("dim").agg(F.avg(F.abs("e")).alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), (F.sqrt(F.sum(F.col("e") * F.col("e"))) / F.count(F.lit(1))).alias("l2_per_element"))


@query(f"with {VEC} select dim, count(v) as n, avg(v) as mean, stddev_pop(v) as std, min(v) as min, max(v) as max from vec group by dim")
def merge_two_stats(v):
    d = v.vectors()
    part = lambda w: S.merged(S.sums(d.where(w), "v")).withColumn("dim", F.col("dim").cast("long"))
    return S.merge_two(part("tag < 4"), part("tag >= 4"), "dim")


_MIXSTATS = f"with {MIX}, st as (select dataset, tag, weight, dim, avg(v) as mean, stddev_pop(v) as std, min(v) as min, max(v) as max, quantile_cont(v, 0.01) as ql, quantile_cont(v, 0.99) as qh from mixlong group by all), w as (select *, weight / sum(weight) over (partition by tag, dim) as w from st)"


def _mix_stats(v):
    return S.vector_stats(v.mix(), "v", "dataset", "tag", "weight").withColumn("dim", F.col("dim").cast("long"))


@query(_MIXSTATS + " select tag, cast(dim as bigint) as dim, sum(w * mean) as mean, sqrt(greatest(sum(w * (std ** 2 + mean ** 2)) - sum(w * mean) ** 2, 0)) as std, min(min) as min, max(max) as max, min(ql) as q_low, max(qh) as q_high from w group by tag, dim")
def mixture_stats_minmax(v):
    return S.mixture(_mix_stats(v), "weight", "tag", "dim")


@query(_MIXSTATS + " select tag, cast(dim as bigint) as dim, sum(w * mean) as mean, sqrt(greatest(sum(w * (std ** 2 + mean ** 2)) - sum(w * mean) ** 2, 0)) as std, min(min) as min, max(max) as max, sum(w * ql) as q_low, sum(w * qh) as q_high from w group by tag, dim")
def mixture_stats_wavg(v):
    return S.mixture(_mix_stats(v), "weight", "tag", "dim", quantiles="weighted_average")


@query(f"""with {MIX}, c as (select tag, dataset, weight, length(dataset) > 5 as absolute, min(k) >= 0 as positive from mix group by all),
 d as (select tag, count(distinct dataset) as n_datasets, count(distinct weight) > 1 as a, count(distinct absolute) > 1 as b, count(distinct positive) > 1 as p from c group by tag)
 select tag, n_datasets, not (a or b or p) as consistent, concat_ws(',', case when a then 'weight' end, case when b then 'absolute' end, case when p then 'positive' end) as differing from d""")
def config_consistency(v):
    c = v.mix().groupBy("tag", "dataset", "weight").agg((F.length("dataset") > 5).alias("absolute"), (F.min(F.col("v")[1]) >= 0).alias("positive"))
    found = checks.same_settings(c, "tag", "dataset", "weight", "absolute", "positive")
    return found.select("tag", "n_datasets", "consistent", F.array_join("differing", ",").alias("differing"))


@query(f"with {VEC}, {_STATS}, o as (select *, row_number() over (partition by tag order by dim in (6, 20), dim) - 1 as place from st) select tag, place, mean, std, min, max, q_low, q_high, dim not in (6, 20) as mask from o")
def stats_export(v):
    e = S.exported(S.vector_stats(v.vectors(), "v", "tag"), "tag", last=(6, 20))
    names = ("mean", "std", "min", "max", "q_low", "q_high", "mask")
    return e.select("tag", F.posexplode(F.arrays_zip(*names)).alias("place", "s")).select("tag", F.col("place").cast("long").alias("place"), *(F.col(f"s.{n}").alias(n) for n in names))


@query(f"with {MIX} select tag, count(*) as num_transitions, count(distinct user_id) as num_trajectories from mix group by tag")
def dataset_counts(v):
    return v.mix().groupBy("tag").agg(F.count(F.lit(1)).alias("num_transitions"), F.count_distinct("user_id").alias("num_trajectories"))


_SETS = f"with {MIX}, sets as (select dataset, weight, count(*) as length from mix group by all)"


def _sets(v):
    return v.mix().groupBy("dataset", "weight").agg(F.count(F.lit(1)).alias("length"))


@query(_SETS + " select dataset, weight * length / sum(weight * length) over () as share from sets")
def sampling_weights(v):
    return S.weights_for_sampling(_sets(v), "weight", "length").select("dataset", "share")


@query(f"with {MIX} select dataset, user_id, count(*)::double / sum(count(*)) over (partition by dataset) as share from mix group by dataset, user_id")
def trajectory_weights(v):
    n = v.mix().groupBy("dataset", "user_id").agg(F.count(F.lit(1)).alias("n"))
    return n.select("dataset", "user_id", (F.col("n") / F.sum("n").over(Window.partitionBy("dataset"))).alias("share"))


@query(_SETS + """, s as (select *, weight * length / sum(weight * length) over () as balanced, weight / sum(weight) over () as plain from sets)
 select cast(floor(max(length / balanced)) as bigint) as balanced, cast(floor(max(length / plain)) as bigint) as plain from s where weight = 1.0""")
def epoch_length(v):
    sizes = {name: P.epoch_length(_sets(v), "length", "weight", name == "balanced") for name in ("balanced", "plain")}
    return v.spark.range(1).select(*(F.lit(n).cast("long").alias(name) for name, n in sizes.items()))


@query("select event_id, row_number() over (partition by event_type order by sha256('3:17:' || event_type || ':' || event_id), event_id) - 1 as place from events")
def sequential_steps(v):
    return P.sequential(v.t("events").select("event_type", "event_id"), 3, 17, "event_type", "event_id").select("event_id", "place")


@query("select p_partkey, case when p_partkey % 2 = 1 then p_partkey::varchar else '' end as serials, case p_partkey % 3 when 0 then 'w' || p_size when 1 then p_partkey::varchar end as serial from part")
def calibration_serials(v):
    key, k = F.col("p_partkey").cast("string"), F.col("p_partkey")
    numbers = F.array_repeat(F.lit(0.5), (5 + k % 2).cast("int"))
    found = joins.serials(F.map_from_arrays(F.array(key, F.concat(F.lit("cam"), key)), F.array(numbers, numbers)))
    cameras = F.when(k % 3 == 0, F.create_map(F.lit("wrist"), F.concat(F.lit("w"), F.col("p_size").cast("string")))).when(k % 3 == 1, F.create_map(F.lit("left"), key, F.lit("note"), F.lit("none"))).otherwise(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")))
    return v.t("part").select("p_partkey", F.array_join(found, ",").alias("serials"), joins.serial_of(cameras, "front", "wrist").alias("serial"))


@query(f"with {MIX}, r as (select dataset, tag, event_id, row_number() over (partition by dataset, tag order by event_id) as r from mix) select dataset, tag, event_id from r where r = 1")
def mixture_dedupe(v):
    return first_of(v.mix().select("dataset", "tag", "event_id"), ["dataset", "tag"], F.asc("event_id"))


_UNIT = "cast('0x' || substr(sha256({}), 1, 12) as bigint) / 281474976710656.0::double"


@query(_SETS + f", h as (select dataset, sum(weight * length) over (order by dataset) / sum(weight * length) over () as hi from sets), p as (select dataset, hi, lag(hi, 1, 0) over (order by dataset) as lo from h), d as (select i as draw, {_UNIT.format(chr(39) + '7:' + chr(39) + ' || i')} as u from range(2000) r(i)) select draw, dataset from d join p on u >= lo and u < hi")
def weighted_sample(v):
    draws = v.spark.range(2000).select(F.col("id").alias("draw")).withColumn("u", P.hash_unit(F.lit(7), F.col("draw")))
    return P.weighted(draws, "u", _sets(v).withColumn("w", F.col("weight") * F.col("length")), "dataset", "w").select("draw", "dataset")


_DRAWN = _SETS + f""", n as (select count(*) as n from events), h as (select dataset, length, sum(weight * length) over (order by dataset) / sum(weight * length) over () as hi from sets),
 p as (select dataset, length, hi, lag(hi, 1, 0) over (order by dataset) as lo from h),
 i as (select dataset, event_id, value, row_number() over (partition by dataset order by event_id) - 1 as place from mix),
 d as (select i as draw, substr(sha256('(2, ' || i || ', 17)'), 33, 32) as h from n, range(n) r(i)),
 c as (select draw, dataset, (('0x' || substr(h, 13, 10))::bigint::hugeint * 1099511627776 + ('0x' || substr(h, 23, 10))::bigint) % length as place from d join p on ('0x' || substr(h, 1, 12))::bigint / 281474976710656.0::double >= lo and ('0x' || substr(h, 1, 12))::bigint / 281474976710656.0::double < hi)"""


def _drawn(v):
    index = sampler.step_index(v.mix().select("dataset", "event_id", "value"), "dataset", "event_id")
    mix = sampler.mixture(index, _sets(v), "dataset", "weight")
    asked = v.spark.range(v.t("events").count()).select(F.col("id").alias("draw"))
    return sampler.sampled(sampler.draws(asked, mix, "dataset", 2, 17), index, "dataset")


@query(_DRAWN + " select draw, dataset, place::bigint as place, event_id from c join i using (dataset, place)")
def epoch_sample(v):
    return _drawn(v).select("draw", "dataset", "place", "event_id")


@query(_DRAWN + """, s as (select draw, event_id, value >= 60 as good from c join i using (dataset, place)),
 t as (select a.draw, min(b.o) as o from (select draw from s) a join (select x.draw, k, (x.draw + k) % n as j, k as o from s x, n, range(10) r(k)) b on a.draw = b.draw join s y on y.draw = b.j and y.good group by a.draw)
 select s.draw, (s.draw + o) % n as taken, y.event_id from s cross join n left join t on t.draw = s.draw left join s y on y.draw = (s.draw + o) % n""")
def retried_sample(v):
    return sampler.next_good(_drawn(v), "draw", F.col("value") >= 60, fail=False).select("draw", "taken", "event_id")


@query("with n as (select count(*) as n from events) select i as draw, cast('0x' || substr(sha256('3:' || i), 1, 12) as bigint) % n as pick from range(1000) r(i), n")
def hash_draw(v):
    n = v.t("events").agg(F.count(F.lit(1)).alias("n"))
    return v.spark.range(1000).crossJoin(F.broadcast(n)).select(F.col("id").alias("draw"), P.hash_number(F.col("n"), F.lit(3), F.col("id")).alias("pick"))


@query("select event_id from events order by sha256(event_id::varchar), event_id limit (select cast(floor(count(*) * 0.35) as bigint) from events)")
def rate_sample(v):
    return P.by_rate(v.t("events").select("event_id"), 0.35, "event_id")


@query("with " + TRAJ + " select event_id, case when (row_number() over (order by episode, step) - 1) % 7 = 0 then 'eval' else 'train' end as split from traj where step % 2 = 0")
def eval_split(v):
    return P.held_out(v.traj().where("step % 2 = 0").select("event_id", "episode", "step"), 7, "episode", "step").select("event_id", "split")


@query("with " + TRAJ + ", s as (select event_id, task, row_number() over (partition by task order by episode, step) as r from traj where step % 5 = 0) select event_id from s where r <= 100")
def stride_sample(v):
    return P.strided(v.traj(), 5, 100, group="task").select("event_id")


@query("with " + TRAJ + " select event_id, 'train' as split from traj where episode % 5 <> 0 union all select event_id, 'val' from traj where episode % 5 = 0")
def union_splits(v):
    t = v.traj()
    return t.where("episode % 5 <> 0").select("event_id", F.lit("train").alias("split")).unionByName(t.where("episode % 5 = 0").select("event_id", F.lit("val").alias("split")))


@query("select episode, cast(ntile(4) over (order by episode) - 1 as bigint) as node from (select distinct user_id as episode from events)")
def node_partition(v):
    return P.nodes(v.t("events").select(F.col("user_id").alias("episode")).distinct(), 4, "episode")


@query("select episode, (row_number() over (order by episode) - 1) % 8 as shard from (select distinct user_id as episode from events)")
def round_robin(v):
    return P.positions(v.t("events").select(F.col("user_id").alias("episode")).distinct(), "episode").select("episode", (F.col("pos") % 8).alias("shard"))


@query("select event_id from events where user_id >= 20 and user_id < 45")
def episode_range(v):
    return v.t("events").where("user_id >= 20 and user_id < 45").select("event_id")


@query("select distinct user_id as episode from events order by 1 limit 12")
def head_episodes(v):
    return v.t("events").select(F.col("user_id").alias("episode")).distinct().orderBy("episode").limit(12)


@query("select event_id from events where event_type in ('click', 'view') and value >= 10")
def tag_filter(v):
    return v.t("events").where(F.col("event_type").isin("click", "view") & (F.col("value") >= 10)).select("event_id")


@query("with " + ROLL + " select task, count(*) as n, cast(sum(success::int) as bigint) as n_success, avg(success::int) as success_rate, avg(case when steps > 10 then steps end) as mean_steps from roll group by task")
def task_success(v):
    return v.rollouts().groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("success").cast("long")).alias("n_success"), F.avg(F.col("success").cast("int")).alias("success_rate"), F.avg(F.when(F.col("steps") > 10, F.col("steps"))).alias("mean_steps"))


@query("with " + ROLL + ", t as (select task, avg(success::int) as r from roll group by 1) select avg(r) as macro, count(*) as n_tasks from t")
def macro_success(v):
    t = v.rollouts().groupBy("task").agg(F.avg(F.col("success").cast("int")).alias("r"))
    return t.agg(F.avg("r").alias("macro"), F.count(F.lit(1)).alias("n_tasks"))


@query("with " + ROLL + " select avg(success::int) as micro, count(*) as n from roll")
def micro_success(v):
    return v.rollouts().agg(F.avg(F.col("success").cast("int")).alias("micro"), F.count(F.lit(1)).alias("n"))


@query("with " + ROLL + ", a as (select task, avg(success::int) as now from roll group by 1), b as (select task, avg(baseline::int) as before from roll group by 1) select task, now, before, now - before as delta from a join b using (task)")
def baseline_delta(v):
    r = v.rollouts()
    a = r.groupBy("task").agg(F.avg(F.col("success").cast("int")).alias("now"))
    b = r.groupBy("task").agg(F.avg(F.col("baseline").cast("int")).alias("before"))
    return a.join(b, "task").withColumn("delta", F.col("now") - F.col("before"))


@query("with " + ROLL + ", m as (select distinct task as label from roll), r as (select task, event_id, success, row_number() over (partition by task order by event_id desc) as r from roll where steps >= 20) select label, event_id, success from m join r on label = task where r.r = 1")
def manifest_join(v):
    r = v.rollouts()
    last = first_of(r.where("steps >= 20"), ["task"], F.desc("event_id"))
    return r.select(F.col("task").alias("label")).distinct().join(last, F.col("label") == F.col("task")).select("label", "event_id", "success")


_ORDER = "case task when 'view' then 0 when 'click' then 1 else 2 end"


@query("with " + ROLL + ", t as (select distinct task from roll) select task, row_number() over (order by " + _ORDER + ", task) as place from t")
def task_order(v):
    t = v.rollouts().select("task").distinct()
    fixed = F.array(F.lit("view"), F.lit("click"))
    known = F.nullif(F.array_position(fixed, F.col("task")), F.lit(0).cast("long"))
    return t.select("task", F.row_number().over(Window.orderBy(F.coalesce(known, F.lit(3).cast("long")), "task")).cast("long").alias("place"))


@query("with " + ROLL + ", t as (select task, avg(success::int) as r, count(*) as n from roll group by 1) select row_number() over (order by r desc, task) as place, '| ' || task || ' | ' || n || ' |' as line from t")
def eval_report(v):
    t = v.rollouts().groupBy("task").agg(F.avg(F.col("success").cast("int")).alias("r"), F.count(F.lit(1)).alias("n"))
    return t.select(F.row_number().over(Window.orderBy(F.desc("r"), "task")).cast("long").alias("place"), F.format_string("| %s | %d |", "task", "n").alias("line"))


@query("select vec_id, case when u > 0 then w * h / u else 0 end as iou from (select vec_id, greatest(0, least(50 + 40 * abs(e[3]::double), 70) - greatest(50 - 40 * abs(e[1]::double), 30)) as w, greatest(0, least(50 + 40 * abs(e[4]::double), 70) - greatest(50 - 40 * abs(e[2]::double), 30)) as h, (40 * abs(e[3]::double) + 40 * abs(e[1]::double)) * (40 * abs(e[4]::double) + 40 * abs(e[2]::double)) + 1600 - w * h as u from (select vec_id, embedding as e from embeddings))")
def box_iou(v):
    from frameflow.operators.traces import box_iou as iou

    e = lambda k: F.abs(F.element_at("v", k))
    a = (50 - 40 * e(1), 50 - 40 * e(2), 50 + 40 * e(3), 50 + 40 * e(4))
    b = tuple(F.lit(float(x)) for x in (30, 30, 70, 70))
    return v.vectors().select("vec_id", iou(a, b).alias("iou"))
