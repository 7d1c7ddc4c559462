"""Queries over trajectories: windows, chunks, gaps, keyframes, control state."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameflow.functions import text as X
from frameflow.functions.text import first_key
from frameflow.operators import windows as W
from frameflow.operators.checks import bundle, contiguity, gate, missing_ids, upper_median
from frameflow.operators.joins import attach, first_of, lookup
from frameflow.operators.sampling import spread_positions
from frameflow.operators.traces import coordinate_source, valid
from frameflow.plans.registry import query
from frameflow.plans.views import GAPS, QA, TRAJ

_W = "partition by episode order by step"


@query("with " + TRAJ + " select episode, step, x, y, grip from traj where episode = 7")
def episode_scan(v):
    return v.traj().where("episode = 7").select("episode", "step", "x", "y", "grip")


@query("select distinct user_id as episode, user_id // 10 as chunk from events")
def episode_chunk(v):
    return v.t("events").select(F.col("user_id").alias("episode")).distinct().withColumn("chunk", F.floor(F.col("episode") / 10).cast("long"))


@query("with " + TRAJ + ' select event_id, step as frame_index, row_number() over (order by episode, step) - 1 as "index" from traj')
def frame_numbering(v):
    return W.number(v.traj()).select("event_id", "frame_index", "index")


@query("select user_id as episode, count(*) as n, cast(coalesce(sum(count(*)) over (order by user_id rows between unbounded preceding and 1 preceding), 0) as bigint) as start from events group by user_id")
def episode_offsets(v):
    return W.offsets(v.t("events"), "user_id").withColumnRenamed("user_id", "episode")


@query("with " + TRAJ + " select event_id, step / 5.0::double as ts, episode * 100000 + step as global_index from traj")
def synthetic_ts(v):
    return v.traj().select("event_id", (F.col("step") / F.lit(5.0)).alias("ts"), (F.col("episode") * 100000 + F.col("step")).alias("global_index"))


def _back(col: str, k: int) -> str:
    return f"coalesce(lag({col}, {k}) over w, first_value({col}) over w)" if k else col


@query("with " + TRAJ + " select event_id, " + " + ".join(f"{12 - k} * {_back('x', k)}" for k in range(12)) + " as wsum, " + _back("x", 11) + " as oldest, 12 as size from traj window w as (" + _W + ")")
def trace_window(v):
    d = W.trailing(v.traj(), ["x"])
    dot = F.aggregate(F.transform("x_window", lambda e, i: e * (i + 1)), F.lit(0.0), lambda s, e: s + e)
    return d.select("event_id", dot.alias("wsum"), F.element_at("x_window", 1).alias("oldest"), F.size("x_window").cast("long").alias("size"))


@query("with " + TRAJ + " select event_id, " + ", ".join(f"{_back('x', 11 - p)} as a{i}_x, {_back('y', 11 - p)} as a{i}_y" for i, p in enumerate((0, 4, 8, 11))) + " from traj window w as (" + _W + ")")
def trace_anchors(v):
    d = W.trailing(v.traj(), ["x", "y"])
    places = [0, 4, 8, 11]
    ax, ay = W.pick(F.col("x_window"), places, 12), W.pick(F.col("y_window"), places, 12)
    return d.select("event_id", ax.alias("ax"), ay.alias("ay")).select("event_id", *(F.col("ax")[i].alias(f"a{i}_x") for i in range(4)), *(F.col("ay")[i].alias(f"a{i}_y") for i in range(4)))


@query("with " + TRAJ + ", n as (select *, count(*) over (partition by episode) as n from traj) select event_id, greatest(0, least(step + 5, n - 1)) as clamped, greatest(0, least(step - 5, n - 1)) as clamped_back from n")
def window_clamp(v):
    n = F.count(F.lit(1)).over(W.whole())
    return v.traj().withColumn("n", n).select("event_id", W.clamp(F.col("step") + 5, F.col("n")).alias("clamped"), W.clamp(F.col("step") - 5, F.col("n")).alias("clamped_back"))


_LAST = "last_value(x) over (partition by episode order by step rows between unbounded preceding and unbounded following)"


@query("with " + TRAJ + " select event_id, " + ", ".join(f"coalesce(lead(x, {k}) over w, 0) as c{k}" for k in range(4)) + " from traj window w as (" + _W + ")")
def action_chunk_zero(v):
    return W.chunk(v.traj(), "x", 4).select("event_id", *(F.col("chunk")[k].alias(f"c{k}") for k in range(4)))


@query("with " + TRAJ + " select event_id, " + ", ".join(f"coalesce(lead(x, {k}) over w, {_LAST}) as c{k}" for k in range(4)) + " from traj window w as (" + _W + ")")
def action_chunk_last(v):
    return W.chunk(v.traj(), "x", 4, "last").select("event_id", *(F.col("chunk")[k].alias(f"c{k}") for k in range(4)))


@query("with " + TRAJ + f" select event_id, coalesce(lead(x, 3) over w, {_LAST}) as absolute_key, coalesce(lead(y, 3) over w, 0) as relative_key from traj window w as (" + _W + ")")
def chunk_policy(v):
    d = W.chunk(v.traj(), "x", 4, W.padding_of("first_last_absolute", True), to="a")
    d = W.chunk(d, "y", 4, W.padding_of("first_last_absolute", False), to="b")
    return d.select("event_id", F.col("a")[3].alias("absolute_key"), F.col("b")[3].alias("relative_key"))


@query("with " + TRAJ + f", c as (select event_id, y, x as c0, coalesce(lead(x, 1) over w, {_LAST}) as c1, coalesce(lead(x, 2) over w, {_LAST}) as c2 from traj window w as (" + _W + ")) select event_id, c0 - y as d0, c1 - c0 as d1, c2 - c1 as d2 from c")
def action_delta(v):
    d = W.chunk(v.traj(), "x", 3, "last").withColumn("m", W.action_mode(F.col("chunk"), F.col("y"), "delta"))
    return d.select("event_id", *(F.col("m")[k].alias(f"d{k}") for k in range(3)))


@query("with " + TRAJ + f", c as (select event_id, y, x as c0, coalesce(lead(x, 1) over w, {_LAST}) as c1, coalesce(lead(x, 2) over w, {_LAST}) as c2 from traj window w as (" + _W + ")) select event_id, c0 - y as d0, c1 - y as d1, c2 - y as d2 from c")
def action_rel(v):
    d = W.chunk(v.traj(), "x", 3, "last").withColumn("m", W.action_mode(F.col("chunk"), F.col("y"), "rel"))
    return d.select("event_id", *(F.col("m")[k].alias(f"d{k}") for k in range(3)))


@query("with " + TRAJ + " select event_id, coalesce(lag(x, 2) over w, first_value(x) over w) as g0, x as g1, coalesce(lead(x, 2) over w, " + _LAST + ") as g2 from traj window w as (" + _W + ")")
def delta_gather(v):
    return W.gather(v.traj(), "x", [-2, 0, 2]).select("event_id", *(F.col("gathered")[k].alias(f"g{k}") for k in range(3)))


@query("with " + TRAJ + ", d as (select *, lag(grip) over w as before from traj window w as (" + _W + ")) select event_id from d where abs(x - 50) > 45 or abs(y - 50) > 45 or coalesce(grip <> before, false)")
def pause_filter(v):
    d = v.traj().withColumn("dx", F.col("x") - 50).withColumn("dy", F.col("y") - 50)
    return W.pauses_removed(d, ["dx", "dy"], "grip", 45.0).select("event_id")


@query("with " + TRAJ + ", n as (select *, count(*) over (partition by episode) as n, avg(x) over (" + _W + " rows between 2 preceding and 2 following) as m from traj) select event_id, case when n < 5 then x else m end as smooth from n")
def smooth_ma(v):
    return W.moving_average(v.traj(), "x", 5).select("event_id", "smooth")


@query("with " + TRAJ + """, j as (select *, sqrt((x - lag(x) over w) ** 2 + (y - lag(y) over w) ** 2) as jump from traj window w as (""" + _W + """))
 select episode, count(*) as n, coalesce(sum(jump), 0) as path_length, coalesce(max(jump), 0) as max_jump, sqrt((arg_max(x, step) - arg_min(x, step)) ** 2 + (arg_max(y, step) - arg_min(y, step)) ** 2) as span from j group by episode""")
def path_stats(v):
    return W.path_stats(v.traj())


@query("with " + TRAJ + " select a.event_id, b.x + 10 * (a.step % 4) as replay from traj a join traj b on a.episode = b.episode and b.step = a.step - a.step % 4")
def chunk_replay(v):
    predicted = v.traj().withColumn("chunk", F.array(*(F.col("x") + 10 * k for k in range(4))))
    return W.replayed(predicted, "chunk", 4).select("event_id", "replay")


@query("with " + TRAJ + " select event_id, (x - min(x) over w) / (max(x) over w - min(x) over w + 1e-6) as probe from traj window w as (" + _W + " rows between unbounded preceding and current row)")
def running_minmax(v):
    return W.running_range(v.traj(), "x").select("event_id", "probe")


@query("with " + TRAJ + " select event_id, case when x / 100 > 0.5 then 1 else -1 end as grip2 from traj")
def gripper_binary(v):
    return v.traj().select("event_id", (2 * (F.col("x") / 100 > 0.5).cast("long") - 1).alias("grip2"))


_FILL = """, f as (select *, last_value({c} ignore nulls) over b as a, last_value(case when {c} is not null then step end ignore nulls) over b as sa, first_value({c} ignore nulls) over n2 as z,
 first_value(case when {c} is not null then step end ignore nulls) over n2 as sz from {t} window b as (partition by episode order by step rows between unbounded preceding and current row),
 n2 as (partition by episode order by step rows between current row and unbounded following))"""
_VALUE = "case when {c} is not null then {c} when a is not null and z is not null then a + (z - a) * ((step - sa)::double / (sz - sa)) else coalesce(a, z{d}) end"


@query("with " + GAPS + _FILL.format(c="x", t="gaps") + " select event_id, least(100, greatest(0, " + _VALUE.format(c="x", d="") + ")) as x, case when x is not null then 'original' when a is not null and z is not null then 'interpolated' when a is not null then 'forward_fill' when z is not null then 'backfill' else 'none' end as how from f")
def interp_fill(v):
    return W.interpolate(v.gaps(), ["x"], clip=(0.0, 100.0), method="how").select("event_id", "x", "how")


_KEYED = GAPS + ", keyed as (select event_id, episode, step, case when is_keyframe then x end as x from gaps)"


@query("with " + _KEYED + _FILL.format(c="x", t="keyed") + " select event_id, " + _VALUE.format(c="x", d="") + " as x from f")
def keyframe_interp(v):
    d = v.gaps().withColumn("x", F.when(F.col("is_keyframe"), F.col("x")))
    return W.interpolate(d, ["x"]).select("event_id", "x")


@query("with " + GAPS + ", keyed as (select event_id, episode, step, case when is_keyframe and episode % 3 <> 0 then x end as x from gaps)" + _FILL.format(c="x", t="keyed") + " select event_id, " + _VALUE.format(c="x", d=", 50") + " as x from f")
def keyframe_interp_default(v):
    d = v.gaps().withColumn("x", F.when(F.col("is_keyframe") & (F.col("episode") % 3 != 0), F.col("x")))
    return W.interpolate(d, ["x"], default=50.0).select("event_id", "x")


@query("with " + GAPS + ", k as (select event_id as id, x as kx from gaps where is_keyframe) select event_id, coalesce(kx, value % 7) as x from gaps left join k on id = event_id")
def anchor_override(v):
    g = v.gaps()
    keys = g.where("is_keyframe").select(F.col("event_id"), F.col("x").alias("kx"))
    return g.select("event_id", "value").join(keys, "event_id", "left").select("event_id", F.coalesce("kx", F.col("value") % 7).alias("x"))


@query("with " + GAPS + " select episode, step from gaps where is_keyframe")
def select_keyframes(v):
    return v.gaps().where("is_keyframe").select("episode", "step")


@query("with " + GAPS + ", k as (select episode, step, row_number() over (partition by episode order by event_id) as r from gaps where is_keyframe) select distinct episode, step from k where r <= 5")
def keyframe_cap(v):
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy("episode").orderBy("event_id"))
    return v.gaps().where("is_keyframe").withColumn("r", r).where("r <= 5").select("episode", "step").distinct()


@query("with " + GAPS + " select event_id, coalesce(x between 10 and 90 and y between 10 and 90, false) as valid from gaps")
def coord_validate(v):
    return v.gaps().select("event_id", valid(F.col("x"), F.col("y"), 10.0, 90.0).alias("valid"))


@query("with " + GAPS + """, s as (select *, ['mask', 'clip', 'keep_raw'][episode % 3 + 1] as policy from gaps)
 select policy, case when x is null then 'projection_invalid' when x between 20 and 80 then 'projection_in_frame' when policy = 'clip' and y < 90 then 'projection_clipped' when policy = 'keep_raw' and y < 90 then 'projection_raw_out_of_frame' else 'projection_valid_other' end as source, count(*) as n from s group by all""")
def source_counts(v):
    policy = F.get(F.array(*map(F.lit, ("mask", "clip", "keep_raw"))), (F.col("episode") % 3).cast("int"))
    c = coordinate_source(F.col("x").isNotNull(), F.col("x").between(20, 80), F.col("y") < 90, F.col("policy"))
    return v.gaps().withColumn("policy", policy).groupBy("policy", c.alias("source")).agg(F.count(F.lit(1)).alias("n"))


_TASKS = "tasks as (select task, row_number() over (order by task) - 1 as task_index from (select distinct event_type as task from events))"


def _tasks(v):
    from frameflow.operators.joins import compact_ids

    return compact_ids(v.t("events").select(F.col("event_type").alias("task")), "task", to="task_index")


@query("with " + TRAJ + ", " + _TASKS + " select event_id, task_index from traj join tasks using (task)")
def task_join(v):
    return lookup(v.traj(), _tasks(v), "task").select("event_id", "task_index")


@query("with " + TRAJ + " select event_id, x, y as trace_y from traj")
def trace_attach(v):
    t = v.traj()
    return attach(t.select("episode", "step", "event_id", "x"), t.select("episode", "step", F.col("y").alias("trace_y")), ["episode", "step"]).select("event_id", "x", "trace_y")


@query("with " + TRAJ + ", tr as (select episode, step, y as trace_y from traj where episode % 2 = 0) select event_id, trace_y from traj left join tr using (episode, step)")
def trace_left_join(v):
    t = v.traj()
    return t.join(t.where("episode % 2 = 0").select("episode", "step", F.col("y").alias("trace_y")), ["episode", "step"], "left").select("event_id", "trace_y")


@query("with " + TRAJ + " select event_id from traj where task <> 'error'")
def nonempty_task(v):
    t = v.traj().withColumn("text", F.when(F.col("task") == "error", "").otherwise(F.col("task")))
    return t.where("trim(text) <> ''").select("event_id")


@query("with " + TRAJ + " select event_id, case when task <> 'error' then task when grip = 0 and x < 50 then 'x ' || event_id when y > 5 then 'more' else 'ds episode ' || episode end as instruction from traj")
def instruction_fallback(v):
    first = F.when(F.col("task") == "error", "").otherwise(F.col("task"))
    second = F.when((F.col("grip") == 0) & (F.col("x") < 50), F.concat(F.lit("x "), F.col("event_id").cast("string")))
    third = F.when(F.col("y") > 5, "more").otherwise("")
    return v.traj().select("event_id", X.first_text(F.concat(F.lit("ds episode "), F.col("episode").cast("string")), first, second, third).alias("instruction"))


@query("with " + TRAJ + " select a.event_id, b.task as later, c.x as earlier from (select *, count(*) over (partition by episode) as n from traj) a join traj b on b.episode = a.episode and b.step = least(a.step + 5, a.n - 1) join traj c on c.episode = a.episode and c.step = greatest(a.step - 3, 0)")
def clamped_lookup(v):
    t = W.at_offset(v.traj(), "task", 5, to="later")
    return W.at_offset(t, "x", -3, to="earlier").select("event_id", "later", "earlier")


@query("with " + TRAJ + ", t as (select a.event_id, a.step, b.step as s, b.x from traj a join traj b on b.episode = a.episode and b.step between a.step - 7 and a.step) select event_id, count(*) as n, min(s) as first, sum(x * (s - step + 8)) as weighted from t group by event_id")
def trail(v):
    # the padding in front repeats the first point; what a trail shows are the points there are
    t = W.trailing(v.traj(), ["x", "step"], 8).withColumn("n", F.least(F.col("step") + 1, F.lit(8)))
    shown = F.slice("x_window", (F.lit(9) - F.col("n")).cast("int"), F.col("n").cast("int"))
    weights = F.sequence(F.lit(9) - F.col("n"), F.lit(8).cast("long"))
    weighted = F.aggregate(F.zip_with(shown, weights, lambda x, k: x * k), F.lit(0.0), lambda s, x: s + x)
    return t.select("event_id", "n", F.element_at("step_window", (F.lit(9) - F.col("n")).cast("int")).cast("long").alias("first"), weighted.alias("weighted"))


@query("select event_id, case when event_id % 3 = 0 then event_type else json_extract_string(props, '$.k') end as action from events")
def key_fallback(v):
    named = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(F.col("event_type").alias("action"), F.lit(0).alias("k")))).otherwise(F.col("props"))
    return v.t("events").select("event_id", named.alias("props")).select("event_id", first_key("props", "action", "k").alias("action"))


@query("with " + QA + " select episode, count(*) as n, min(step) as first, max(step) as last, min(step) = 0 and max(step) = count(*) - 1 and count(distinct step) = count(*) as contiguous from qa group by episode".replace(" as first", ' as "first"').replace(" as last", ' as "last"'))
def contiguity_test(v):
    return contiguity(v.qa())


@query("with " + GAPS + " select count(*) as n_rows, count(distinct episode) as n_episodes, cast(sum(is_keyframe::int) as bigint) as n_keyframes, cast(sum((x is null)::int) as bigint) as n_null, min(x) as min_x, max(x) as max_x, min(y) as min_y, max(y) as max_y from gaps")
def bundle_summary(v):
    return bundle(v.gaps(), "x", "y", F.col("is_keyframe"))


@query("with " + QA + ", n as (select count(*) as n from qa group by episode) select min(n) as least, quantile_cont(n, 0.5) as median, max(n) as most from n")
def episode_len_stats(v):
    return v.qa().groupBy("episode").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("least"), F.percentile("n", F.lit(0.5)).alias("median"), F.max("n").alias("most"))


@query("with " + QA + ", n as (select count(*) as n from qa group by episode), r as (select n, row_number() over (order by n) as r, count(*) over () as c from n) select n as upper_median from r where r = c // 2 + 1")
def upper_median_length(v):
    return upper_median(v.qa().groupBy("episode").agg(F.count(F.lit(1)).alias("n")), "n")


@query("with " + GAPS + " select count(*) as n, count(distinct episode) as n_episodes, min(step) as first_step, max(step) as last_step, count(*) - count(x) as n_null, cast(sum((y not between 5 and 95)::int) as bigint) as n_bad from gaps")
def scan_stats(v):
    return v.gaps().agg(F.count(F.lit(1)).alias("n"), F.count_distinct("episode").alias("n_episodes"), F.min("step").alias("first_step"), F.max("step").alias("last_step"), (F.count(F.lit(1)) - F.count("x")).alias("n_null"), F.sum((~F.col("y").between(5, 95)).cast("long")).alias("n_bad"))


@query("with " + TRAJ + ", n as (select episode, count(*) as n from traj group by 1) select distinct episode, cast(round_even(i * (n - 1) / 6.0, 0) as bigint) as pos from n, range(7) r(i)")
def even_sample(v):
    n = v.traj().groupBy("episode").agg(F.count(F.lit(1)).alias("n"))
    return n.select("episode", F.explode(spread_positions(F.col("n"), 7)).alias("pos"))


@query("with " + QA + ", n as (select episode, count(*) as n from qa group by 1), b as (select count(*) as k from n where n between 60 and 70) select episode, n from n, b where case when k >= 10 then n between 60 and 70 else n between 10 and 400 end")
def band_pick(v):
    n = v.qa().groupBy("episode").agg(F.count(F.lit(1)).alias("n"))
    k = n.agg(F.sum(F.col("n").between(60, 70).cast("long")).alias("k"))
    return n.crossJoin(F.broadcast(k)).where(F.when(F.col("k") >= 10, F.col("n").between(60, 70)).otherwise(F.col("n").between(10, 400))).select("episode", "n")


@query("with " + QA + ", d as (select distinct episode % 4 as rank, step // 10 as item from qa) select a.rank as rank_a, b.rank as rank_b, count(*) as shared from d a join d b on a.item = b.item and a.rank < b.rank group by all")
def rank_overlap(v):
    d = v.qa().select((F.col("episode") % 4).alias("rank"), F.floor(F.col("step") / 10).alias("item")).distinct()
    a, b = d.select(F.col("rank").alias("rank_a"), "item"), d.select(F.col("rank").alias("rank_b"), "item")
    return a.join(b, "item").where("rank_a < rank_b").groupBy("rank_a", "rank_b").agg(F.count(F.lit(1)).alias("shared"))


@query("with " + TRAJ + ", p as (select episode, y, count(*) as c from traj group by all), e as (select episode, count(*) as used, sum(c) as n, ln(sum(c)) - sum(c * ln(c)) / sum(c) as entropy from p group by 1) select episode, used, cast(n as bigint) as n, entropy, exp(entropy) as perplexity from e")
def code_perplexity(v):
    from frameflow.operators.stats import perplexity

    return perplexity(v.traj(), "y", "episode")


_ENS = ", ".join(f"coalesce(exp(0.1 * ((a{k} * a0 + b{k} * b0) / (sqrt(a{k} * a{k} + b{k} * b{k}) * sqrt(a0 * a0 + b0 * b0) + 1e-7))), 0) as w{k}" for k in range(3))


@query("with " + TRAJ + """, p as (select event_id, x * 0.9 + y * 0.1 as a0, y - 50 as b0, lag(x * 0.9 + y * 0.1, 1) over w + 1 as a1, lag(y - 50, 1) over w - 1 as b1, lag(x * 0.9 + y * 0.1, 2) over w + 2 as a2, lag(y - 50, 2) over w - 2 as b2 from traj window w as (""" + _W + f""")),
 e as (select *, {_ENS} from p) select event_id, (w0 * a0 + w1 * coalesce(a1, 0) + w2 * coalesce(a2, 0)) / (w0 + w1 + w2) as first_dim, (w0 * b0 + w1 * coalesce(b1, 0) + w2 * coalesce(b2, 0)) / (w0 + w1 + w2) as second_dim from e""")
def adaptive_ensemble(v):
    q, y = F.col("x") * 0.9 + F.col("y") * 0.1, F.col("y") - 50
    d = v.traj().withColumn("c", F.array(*(F.array(q + k, y - k) for k in range(3))))
    return W.ensemble(d, "c", 3, 0.1).select("event_id", F.col("ensemble")[0].alias("first_dim"), F.col("ensemble")[1].alias("second_dim"))


@query("with " + TRAJ + " select event_id, x, y from traj where x between 0 and 100 or x < 0 or x > 100")
def gated_scan(v):
    return gate(v.traj(), F.col("y").between(0, 100), "coordinate out of range").select("event_id", "x", "y")


@query("with " + TRAJ + ", d as (select episode, step, event_id, row_number() over (partition by episode, step // 2 order by event_id) as r from traj) select episode, step, event_id from d where r = 1")
def trace_merge(v):
    t = v.traj().withColumn("half", F.floor(F.col("step") / 2))
    return first_of(t, ["episode", "half"], F.asc("event_id")).select("episode", "step", "event_id")


@query("with " + QA + ", odd as (select episode from qa where episode % 3 > 0) select range as episode from range((select max(user_id) + 1 from events)) where range not in (select episode from odd)")
def missing_episode_ids(v):
    total = v.t("events").agg(F.max("user_id")).first()[0] + 1
    return missing_ids(v.qa().where("episode % 3 > 0"), "episode", total)
