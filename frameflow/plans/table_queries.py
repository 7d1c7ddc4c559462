"""Queries over labels, shards, tracks and text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from frameflow.functions import text as X
from frameflow.operators import calibration, files, joins
from frameflow.operators import sampling as P
from frameflow.operators import traces as T
from frameflow.operators.checks import missing_ids
from frameflow.plans.registry import query
from frameflow.plans.views import LAB, SHARD, TRACK, TRAJ


@query(f"with {LAB} select doc_id, label from frames left join lab using (episode, step)")
def label_exact(v):
    return joins.label_join(v.frames(), v.labels(), "label").select("doc_id", "label")


_NEAR = f"""with {LAB}, j as (select f.*, l.label, case when l.label is not null then step end as at_ from frames f left join lab l using (episode, step)),
 n as (select *, last_value(label ignore nulls) over b as a, last_value(at_ ignore nulls) over b as sa, first_value(label ignore nulls) over n as z, first_value(at_ ignore nulls) over n as sz from j
 window b as (partition by episode order by step rows between unbounded preceding and current row), n as (partition by episode order by step rows between current row and unbounded following))"""


@query(_NEAR + " select doc_id, coalesce(a, z) as label from n")
def label_asof_clip(v):
    return joins.label_join(v.frames(), v.labels(), "label", "clip").select("doc_id", "label")


@query(_NEAR + " select doc_id, case when a is null then z when z is null then a when step - sa <= sz - step then a else z end as label from n")
def label_asof_nearest(v):
    return joins.label_join(v.frames(), v.labels(), "label", "nearest").select("doc_id", "label")


@query(f"with {LAB}, d as (select episode, step // 2 as pair, label, row_number() over (partition by episode, step // 2 order by step desc) as r from lab) select episode, pair, label from d where r = 1")
def label_last_wins(v):
    d = v.labels().withColumn("pair", F.floor(F.col("step") / 2))
    return joins.first_of(d, ["episode", "pair"], F.desc("step")).select("episode", "pair", "label")


@query("select range as doc_id from range((select max(doc_id) + 1 from documents)) where range not in (select doc_id from labels)")
def missing_ids_labels(v):
    total = v.t("documents").agg(F.max("doc_id")).first()[0] + 1
    return missing_ids(v.t("labels"), "doc_id", total)


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def missing_anti(v):
    return v.t("documents").select("doc_id").join(v.t("labels").select("doc_id"), "doc_id", "left_anti")


@query("select doc_id, n_chars from documents where doc_id in (select doc_id from labels where quality = 0)")
def target_semi(v):
    return v.t("documents").select("doc_id", "n_chars").join(v.t("labels").where("quality = 0").select("doc_id"), "doc_id", "left_semi")


@query("select event_id from events where user_id in (select user_id from events group by user_id having count(*) >= 65)")
def present_semi(v):
    e = v.t("events")
    present = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 65").select("user_id")
    return e.select("event_id", "user_id").join(present, "user_id", "left_semi").select("event_id")


@query("select 'either' as part, count(*) as n from (select doc_id from labels where quality = 0 union select doc_id from labels where toxic = 1) union all select 'both', count(*) from (select doc_id from labels where quality = 0 intersect select doc_id from labels where toxic = 1)")
def coverage_sets(v):
    q, x = v.t("labels").where("quality = 0").select("doc_id"), v.t("labels").where("toxic = 1").select("doc_id")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    return count(q.union(x).distinct(), "either").union(count(q.intersect(x), "both"))


@query("select source, count(*) as n, count(quality) as n_quality, count(case when coalesce(toxic, 1 - quality) = 1 then 1 end) as n_either from documents left join labels using (doc_id) group by source")
def coverage_counts(v):
    j = v.t("documents").select("doc_id", "source").join(v.t("labels"), "doc_id", "left")
    return j.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("quality").alias("n_quality"), F.count(F.when(F.coalesce("toxic", 1 - F.col("quality")) == 1, 1)).alias("n_either"))


@query("select doc_id, case when quality is null then 'no_label' when lang <> 'en' then 'language' when n_chars < 200 then 'short' else 'ok' end as reason from documents left join labels using (doc_id)")
def skip_reason(v):
    j = v.t("documents").select("doc_id", "lang", "n_chars").join(v.t("labels").select("doc_id", "quality"), "doc_id", "left")
    r = joins.first_failure([("no_label", F.col("quality").isNull()), ("language", F.col("lang") != "en"), ("short", F.col("n_chars") < 200)])
    return j.select("doc_id", r.alias("reason"))


@query("""with o as (select o_orderkey as k, o_custkey as c, case when o_orderkey % 11 = 0 then null else o_custkey end as serial from orders),
 r as (select k, c, case when o_orderstatus = 'F' then 'missing_calibration_entry' when serial is null then 'missing_camera_serial' when c_acctbal is null or c_acctbal <= 0 then 'missing_intrinsic'
 when c_nationkey >= 20 then 'missing_extrinsic' end as reason, c_acctbal from o join orders on o_orderkey = k left join customer on c_custkey = serial)
 select k::varchar as path, coalesce(reason, 'ok') as reason, case when reason is null or reason = 'missing_extrinsic' then c_acctbal / 2 end as fx from r""")
def calibration_chain(v):
    orders = v.t("orders").select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderkey").alias("episode_id"), F.col("o_custkey").cast("string").alias("serial"), "o_custkey", "o_orderstatus")
    owned = orders.join(v.t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    cameras = orders.where("episode_id % 11 <> 0").select("episode_id", F.create_map(F.lit("wrist"), F.col("serial")).alias("cameras"))
    size = [F.lit(float(x)).alias(n) for n, x in (("fy", 1), ("cx", 2), ("cy", 3), ("width", 640), ("height", 480))]
    lenses = owned.where("c_acctbal > 0").select("episode_id", "serial", F.col("c_acctbal").alias("fx"), *size)
    places = owned.where("c_nationkey < 20").select("episode_id", "serial", F.array(F.lit(1.0)).alias("matrix"))
    found = calibration.calibrated(orders.select("path"), orders.where("o_orderstatus <> 'F'").select("path", "episode_id"), cameras, lenses, places, ["wrist"])
    return found.select("path", F.coalesce("reason", F.lit("ok")).alias("reason"), calibration.rescaled(F.col("intrinsic"), F.lit(320), F.lit(480))["fx"].alias("fx"))


_RANGES = SHARD + ', ranges as (select shard, length, sum(length) over (order by shard) as "end", sum(length) over (order by shard) - length as start from shards)'


@query(f'with {_RANGES} select c_custkey as id, shard, c_custkey - start::bigint as local from customer join ranges on c_custkey >= start and c_custkey < "end"')
def shard_range_join(v):
    r = joins.prefix_ranges(v.shards(), "shard", "length")
    d = v.t("customer").select(F.col("c_custkey").alias("id"))
    return joins.range_join(d, "id", r, 256).select("id", "shard", (F.col("id") - F.col("start")).alias("local"))


@query(f"with {SHARD} select count(*) as n_shards, cast(sum(length) as bigint) as total, count(*) = (select count(*) from nation) as complete from shards")
def shard_check(v):
    s = v.shards().agg(F.count(F.lit(1)).alias("n_shards"), F.sum("length").alias("total"))
    n = v.t("nation").agg(F.count(F.lit(1)).alias("k"))
    return s.crossJoin(F.broadcast(n)).select("n_shards", "total", (F.col("n_shards") == F.col("k")).alias("complete"))


@query(f"with {SHARD}, p as (select shard, row_number() over (order by shard) - 1 as i from shards where shard % 7 <> 5) select shard from p where shard = i")
def contiguous_prefix(v):
    return P.positions(v.shards().where("shard % 7 <> 5"), "shard").where("shard = pos").select("shard")


@query("with k as (select event_type, user_id, row_number() over (order by event_type, user_id) - 1 as new_id from (select distinct event_type, user_id from events where value > 80)) select event_id, new_id from events join k using (event_type, user_id)")
def compact_reindex(v):
    e = v.t("events").select("event_id", "event_type", "user_id", "value")
    ids = joins.compact_ids(e.where("value > 80"), "event_type", "user_id")
    return e.join(ids, ["event_type", "user_id"]).select("event_id", "new_id")


@query("select c_custkey // 100 as shard, count(*) as n_rows, min(c_custkey) as first_key, max(c_custkey) as last_key from customer group by 1")
def shard_manifest(v):
    return files.manifest(v.t("customer"), "c_custkey", 100)


_SIZES = "items as (select shard, length / 10.0::double as mb, row_number() over (order by shard) as r from shards)"


@query(f"""with recursive {SHARD}, {_SIZES}, f as (select r, shard, mb, 0::bigint as file, case when mb >= 20 then 0 else mb end as used, mb >= 20 as closed from items where r = 1
 union all select i.r, i.shard, i.mb, f.file + f.closed::bigint, case when f.used + i.mb >= 20 then 0 else f.used + i.mb end, f.used + i.mb >= 20 from f join items i on i.r = f.r + 1)
 select shard, file, sum(mb) over (partition by file order by shard) - mb as begin_mb from f""")
def bin_pack_data(v):
    d = files.bin_pack(v.shards().withColumn("mb", F.col("length") / 10.0), "mb", "shard", 20.0)
    return files.within(d, "mb", "shard", "file").select("shard", "file", F.col("from").alias("begin_mb"))


@query(f"""with recursive {SHARD}, {_SIZES}, f as (select r, shard, mb, 0::bigint as file, mb as used from items where r = 1
 union all select i.r, i.shard, i.mb, f.file + (f.used + i.mb >= 20)::bigint, case when f.used + i.mb >= 20 then i.mb else f.used + i.mb end from f join items i on i.r = f.r + 1) select shard, file, used as end_mb from f""")
def bin_pack_video(v):
    d = files.bin_pack(v.shards().withColumn("mb", F.col("length") / 10.0), "mb", "shard", 20.0, before=True)
    return files.within(d, "mb", "shard", "file").select("shard", "file", F.col("to").alias("end_mb"))


@query("select o_orderkey as n, o_orderkey // 1000 as chunk, o_orderkey % 1000 as file from orders")
def chunk_rollover(v):
    c, f = files.chunk_and_file(F.col("o_orderkey"), 1000)
    return v.t("orders").select(F.col("o_orderkey").alias("n"), c.alias("chunk"), f.alias("file"))


@query("select l_orderkey as episode, max(case when l_linenumber = 1 then l_quantity end) as cam1, max(case when l_linenumber = 2 then l_quantity end) as cam2 from lineitem group by 1")
def camera_pivot(v):
    p = v.t("lineitem").groupBy(F.col("l_orderkey").alias("episode")).pivot("l_linenumber", [1, 2]).agg(F.max("l_quantity"))
    return p.withColumnsRenamed({"1": "cam1", "2": "cam2"})


@query("select o_orderkey as episode, c_name as name, n from orders join customer on o_custkey = c_custkey left join (select l_orderkey, count(*) as n from lineitem where l_quantity > 45 group by 1) on o_orderkey = l_orderkey")
def episode_meta_join(v):
    video = v.t("lineitem").where("l_quantity > 45").groupBy(F.col("l_orderkey").alias("episode")).agg(F.count(F.lit(1)).alias("n"))
    base = v.t("orders").select(F.col("o_orderkey").alias("episode"), F.col("o_custkey").alias("c_custkey"))
    return base.join(v.t("customer").select("c_custkey", F.col("c_name").alias("name")), "c_custkey").join(video, "episode", "left").select("episode", "name", "n")


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F')")
def resume_anti(v):
    done = v.t("orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return v.t("customer").select("c_custkey").join(done, "c_custkey", "left_anti")


@query("select event_type as task, max(event_id::varchar) as latest from events group by 1")
def latest_per_key(v):
    return v.t("events").groupBy(F.col("event_type").alias("task")).agg(F.max(F.col("event_id").cast("string")).alias("latest"))


@query("select count(distinct user_id) as total_episodes, count(*) as total_frames, max(user_id) // 10 + 1 as total_chunks, '0:' || count(distinct user_id) as split from events")
def info_totals(v):
    g = v.t("events").agg(F.count_distinct("user_id").alias("total_episodes"), F.count(F.lit(1)).alias("total_frames"), (F.floor(F.max("user_id") / 10) + 1).alias("total_chunks"))
    return g.withColumn("split", F.concat(F.lit("0:"), F.col("total_episodes").cast("string")))


@query("with d as (select date_trunc('month', o_orderdate) as month, sum(o_totalprice) as total from orders group by 1) select strftime(month, '%Y-%m') as month, total - lag(total) over (order by month) as gain1, total - lag(total, 3) over (order by month) as gain3 from d")
def throughput_lag(v):
    d = v.t("orders").groupBy(F.date_trunc("month", "o_orderdate").alias("m")).agg(F.sum("o_totalprice").alias("total"))
    w = Window.orderBy("m")
    return d.select(F.date_format("m", "yyyy-MM").alias("month"), (F.col("total") - F.lag("total").over(w)).alias("gain1"), (F.col("total") - F.lag("total", 3).over(w)).alias("gain3"))


@query(f"with {SHARD} select cast(sum(length) as bigint) as total, sum(length) = (select count(*) from customer) as as_expected from shards")
def grand_total(v):
    n = v.t("customer").agg(F.count(F.lit(1)).alias("k"))
    return v.shards().agg(F.sum("length").alias("total")).crossJoin(F.broadcast(n)).select("total", (F.col("total") == F.col("k")).alias("as_expected"))


_SUM = TRACK + """, j as (select *, sqrt((x - lag(x) over w) ** 2 + (y - lag(y) over w) ** 2) as jump from track window w as (partition by tag, track order by frame)),
 su as (select tag, track, coalesce(sum(jump), 0) as path, coalesce(max(jump), 0) as jump, coalesce(avg(jump), 0) as mean_step, avg(visibility) as seen, sqrt((arg_max(x, frame) - arg_min(x, frame)) ** 2 + (arg_max(y, frame) - arg_min(y, frame)) ** 2) as span from j group by tag, track),
 good as (select *, not (path < 70 and span < 70) and (count(*) over (partition by tag) <= 2 or seen >= 0.096 and jump < 55 and mean_step < 23.5) as passed from su),
 kept as (select *, passed or count(*) over (partition by tag) <= 2 or sum(passed::int) over (partition by tag) = 0 as kept, sum(passed::int) over (partition by tag) as n_passed from good)"""


_BOUNDS = {"least_path": 70.0, "most_jump": 55.0, "most_step": 23.5, "least_seen": 0.096}


def _summary(v):
    return T.tracks_kept(T.track_summary(v.tracks(), "tag", "track", "frame"), "tag", **_BOUNDS)


@query(f"with {_SUM} select tag, track, path, span, jump, mean_step, seen, kept from kept")
def track_filter(v):
    return _summary(v).select("tag", "track", "path", "span", "jump", "mean_step", "seen", "kept")


@query(f"with {_SUM}, r as (select tag, track, row_number() over (partition by tag order by passed desc, round(path, 9) desc, track) as rank, n_passed from kept where kept) select tag, track, rank from r where rank <= 3 or n_passed <= 3")
def topk_tracks(v):
    return T.longest(_summary(v).withColumn("path", F.round("path", 9)), "tag", "track", 3).select("tag", "track", "rank")


_FUSED = f"""{_SUM}, used as (select t.* from track t join (select tag, track, n_passed, row_number() over (partition by tag order by passed desc, path desc, track) as r from kept where kept) k using (tag, track) where r <= 20 or n_passed <= 20),
 c as (select tag, frame, case when sum(visibility) > 1e-6 then sum(x * visibility) / sum(visibility) else avg(x) end as vx, case when sum(visibility) > 1e-6 then sum(y * visibility) / sum(visibility) else avg(y) end as vy,
 quantile_cont(x, 0.5) as mx, quantile_cont(y, 0.5) as my, avg(x) as ax, avg(y) as ay, 1.0 / (1.0 + stddev_pop(x) + stddev_pop(y)) as c from used group by tag, frame),
 p as (select tag, frame, (1 * vx + 1 * mx + 1 * ax + c * ax) / (1 + 1 + 1 + c) as px, (1 * vy + 1 * my + 1 * ay + c * ay) / (1 + 1 + 1 + c) as py, count(*) over (partition by tag) as n from c)"""


@query(f"with {_FUSED} select tag, frame, case when n < 5 then px else avg(px) over w end as fused_x, case when n < 5 then py else avg(py) over w end as fused_y from p window w as (partition by tag order by frame rows between 2 preceding and 2 following)")
def track_fusion(v):
    return T.fuse(v.tracks(), "tag", "track", "frame", most_tracks=20, **_BOUNDS)


_CAM = [[0.8, 0.1, 0.0, 0.5], [0.0, 0.9, 0.1, -0.2], [0.1, 0.0, 0.7, 2.0]]
_UV = TRAJ + ", p as (select event_id, x / 100 as a, y / 100 as b, (x + y) / 200 as c from traj), d as (select *, 0.1 * a + 0.7 * c + 2.0 - 2.4 as depth from p), uv as (select event_id, case when depth > 0.05 then 200 * (0.8 * a + 0.1 * b + 0.5) / depth + 160 end as u, case when depth > 0.05 then 200 * (0.9 * b + 0.1 * c - 0.2) / depth + 120 end as v, depth from d)"


def _projected(v):
    t = v.traj().select("event_id", (F.col("x") / 100).alias("a"), (F.col("y") / 100).alias("b"), ((F.col("x") + F.col("y")) / 200).alias("c"))
    cam = [_CAM[0], _CAM[1], [*_CAM[2][:3], _CAM[2][3] - 2.4]]
    u, w, d = T.project(F.col("a"), F.col("b"), F.col("c"), cam, 200.0, 200.0, 160.0, 120.0, nearest=0.05)
    return t.select("event_id", u.alias("u"), w.alias("v"), d.alias("depth"))


@query(f"with {_UV} select event_id, u, v, depth, coalesce(u between 0 and 319 and v between 0 and 239, false) as inside from uv")
def project_points(v):
    return _projected(v).select("*", T.inside(F.col("u"), F.col("v"), 320, 240).alias("inside"))


@query(f"with {_UV}, i as (select *, coalesce(u between 0 and 319 and v between 0 and 239, false) as i from uv) select event_id, case when i then u end as masked, case when u is not null then greatest(0, least(319, u)) end as clipped, u as raw from i")
def oof_policy(v):
    d = _projected(v).withColumn("i", T.inside(F.col("u"), F.col("v"), 320, 240))
    clip = F.when(F.col("u").isNotNull(), T.frame_policy(F.col("u"), 320, "clip", F.col("i")))
    return d.select("event_id", T.frame_policy(F.col("u"), 320, "mask", F.col("i")).alias("masked"), clip.alias("clipped"), T.frame_policy(F.col("u"), 320, "keep_raw", F.col("i")).alias("raw"))


@query(f"with {TRAJ} select event_id, x * 2.55 / 255 * 100 as normal from traj")
def pixel_to_norm(v):
    return v.traj().select("event_id", T.to_normal(F.col("x") * 2.55, 256).alias("normal"))


@query(f"with {TRAJ} select event_id, greatest(0, least(255, cast(round_even(x / 100.0 * 255, 0) as bigint))) as px, 0 as one from traj")
def coord_to_pixel(v):
    return v.traj().select("event_id", T.to_pixel(F.col("x"), 256).alias("px"), T.to_pixel(F.col("x"), 1).alias("one"))


@query("with q as (select vec_id as q, (vec_id % 50) * 0.37::double as ts from embeddings), f as (select k as frame, k / 5.0::double as at_ from range(100) r(k)) select q, arg_min(frame, struct_pack(d := round(abs(at_ - ts), 9), f := frame)) as frame from q, f group by q")
def nearest_frame(v):
    # frames are evenly spaced, so only the neighbours of ts * fps can be nearest
    at = (F.col("vec_id") % 50) * 0.37
    near = F.transform(F.sequence(F.floor(at * 5), F.floor(at * 5) + 1), lambda k: F.struct(F.round(F.abs(k / 5.0 - at), 9).alias("d"), k.alias("frame")))
    return v.t("embeddings").select(F.col("vec_id").alias("q"), F.array_min(near)["frame"].alias("frame"))


@query("with d as (select vec_id, 1.0 + vec_id % 40 as dur from embeddings), k as (select vec_id, greatest(4, least(16, cast(round_even(dur / 2.0, 0) as int))) as want, cast(dur * 5 as bigint) as frames from d) select distinct vec_id, cast(floor(i * (frames - 1) / (want - 1)::double) as bigint) as frame from k, range(16) r(i) where i < want")
def frame_budget(v):
    d = v.t("embeddings").select("vec_id", (1.0 + F.col("vec_id") % 40).alias("dur"))
    return d.select("vec_id", F.explode(P.frame_budget(F.col("dur"), (F.col("dur") * 5).cast("long"), 2.0, 4, 16)).alias("frame"))


@query("""with recursive """ + TRAJ + """, s as (select episode, step, x / 100 as g from traj), a as (select episode, step, g as ref, false as held, 0::double as hold, 0 as told, 0::double as sticky from s where step = 0
 union all select episode, step, ref, held and told < 3, hold, case when held and told < 3 then told else 0 end, case when held then hold else ref0 - g end from (
  select s.episode, s.step, s.g, a.ref as ref0, a.held or abs(a.ref - s.g) > 0.5 as held, case when a.held then a.hold else a.ref - s.g end as hold,
  case when a.held or abs(a.ref - s.g) > 0.5 then a.told + 1 else a.told end as told, case when not a.held and abs(a.ref - s.g) > 0.5 then s.g else a.ref end as ref from a join s on s.episode = a.episode and s.step = a.step + 1))
 select episode, step, sticky from a""")
def sticky_gripper(v):
    from frameflow.streaming.control import sticky

    return sticky(v.traj().select("episode", "step", (F.col("x") / 100).alias("g")), "g", threshold=0.5, repeats=3)


@query("select conv_id from conversations group by conv_id having sum(array_length(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))) <= 200")
def conv_word_filter(v):
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return v.t("conversations").groupBy("conv_id").agg(F.sum(words).alias("n")).where("n <= 200").select("conv_id")


@query("select conv_id, cast(sum(array_length(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))) + 128 * (conv_id % 2) as bigint) as length from conversations group by conv_id")
def conv_lengths(v):
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return v.t("conversations").groupBy("conv_id").agg(F.sum(words).alias("n")).select("conv_id", (F.col("n") + 128 * (F.col("conv_id") % 2)).alias("length"))


@query("with c as (select conv_id, turn, case role when 'user' then 'human' when 'assistant' then 'gpt' else role end as role, row_number() over (partition by conv_id order by turn) as r from conversations) select conv_id, turn, case role when 'human' then 'user' when 'gpt' then 'assistant' else role end as role from c where not (r = 1 and role <> 'human')")
def role_map(v):
    c = v.t("conversations").withColumn("role", F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role")))
    r = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.withColumn("r", r).where("not (r = 1 and role <> 'human')").select("conv_id", "turn", X.role(F.col("role")).alias("role"))


_SAID = """case event_id % 6 when 0 then 'no point here, 43 58' when 1 then '<point x="' || cast(floor(y) as int) || '" y="' || cast(floor(x) as int) || '" alt="grip">' when 2 then 'Gripper coordinates: ' || cast(floor(y) as int) || ', ' || cast(floor(x) as int) || ' near (1, 2)'
 when 3 then '(999, 1) or X: ' || cast(floor(y) as int) || '.5, then Y: ' || cast(floor(x) as int) when 4 then 'first (7, 8); the coordinate (' || cast(floor(y) as int) || ' , ' || cast(floor(x) as int) || ')' else '[' || cast(floor(y) as int) || ', ' || cast(floor(x) as int) || ']' end"""
_FOUND = ", ".join(f"case when regexp_extract(said, '{p}', 1) <> '' and cast(regexp_extract(said, '{p}', 1) as double) between 0 and 100 and cast(regexp_extract(said, '{p}', 2) as double) between 0 and 100 then [cast(regexp_extract(said, '{p}', 1) as double), cast(regexp_extract(said, '{p}', 2) as double)] end" for p in X.POINT_PATTERNS)


@query("with " + TRAJ + f", t as (select event_id, lower({_SAID}) as said from traj) select event_id, coalesce({_FOUND})[1] as px, coalesce({_FOUND})[2] as py from t")
def parse_point(v):
    a, b = F.floor("y").cast("string"), F.floor("x").cast("string")
    k = F.col("event_id") % 6
    text = (
        F.when(k == 0, F.lit("no point here, 43 58"))
        .when(k == 1, F.concat(F.lit('<point x="'), a, F.lit('" y="'), b, F.lit('" alt="grip">')))
        .when(k == 2, F.concat(F.lit("Gripper coordinates: "), a, F.lit(", "), b, F.lit(" near (1, 2)")))
        .when(k == 3, F.concat(F.lit("(999, 1) or X: "), a, F.lit(".5, then Y: "), b))
        .when(k == 4, F.concat(F.lit("first (7, 8); the coordinate ("), a, F.lit(" , "), b, F.lit(")")))
        .otherwise(F.concat(F.lit("["), a, F.lit(", "), b, F.lit("]")))
    )
    p = X.parse_point(text)
    return v.traj().select("event_id", p["x"].alias("px"), p["y"].alias("py"))


_TEXT = "with " + TRAJ + " select event_id, '[[' || cast(round_even(y * 10, 0) as int) || ', ' || cast(round_even(least(1, greatest(0, x / 100)) * 1000, 0) as int) || '], [500, 1000]]' as text from traj"


def _points():
    s = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    return F.array(s(F.col("y") / 100, F.col("x") / 100), s(F.lit(0.5), F.lit(1.5)))


@query(_TEXT)
def trace_to_text(v):
    return v.traj().select("event_id", X.trace_to_text(_points()).alias("text"))


@query("with " + TRAJ + " select event_id, cast(round_even(y * 10, 0) as int) / 1000.0::double as x0, 0.5::double as x1, 0.5::double as x3, 1.0::double as y3, 4 as size from traj")
def text_to_trace(v):
    t = v.traj().select("event_id", X.text_to_trace(X.trace_to_text(_points())).alias("p"))
    return t.select("event_id", F.col("p")[0]["x"].alias("x0"), F.col("p")[1]["x"].alias("x1"), F.col("p")[3]["x"].alias("x3"), F.col("p")[3]["y"].alias("y3"), F.size("p").cast("long").alias("size"))


@query("with " + TRAJ + " select event_id, task || '. Predict the gripper trace as 4 anchor points (start, intermediate, end) in [[x,y]] format with coords 0-1000.' as prompt, task || '. Predict 8 latent action tokens, then To identify the gripper trace, locate 6 anchor points in [[x,y]] format with coords 0-1000.' as both_parts from traj")
def prompt_text(v):
    return v.traj().select("event_id", X.prompt(F.col("task"), X.trace_prompt("plain")).alias("prompt"), X.prompt(F.col("task"), X.semantic_prompt("trace_latent", "cot_bbox", 6, 8, "latent_trace")).alias("both_parts"))


@query("with " + TRAJ + " select event_id, '<LAM_' || step || '><LAM_' || (step + 1) || '>' as tokens, step + 1 as second from traj")
def lam_tokens(v):
    t = v.traj().select("event_id", X.latent_tokens(F.array("step", F.col("step") + 1)).alias("tokens"))
    return t.select("event_id", "tokens", X.latent_codes(F.col("tokens"), 4)[1].alias("second"))


@query("with " + TRAJ + " select event_id, '<LAM_' || step || '>[[' || cast(round_even(y * 10, 0) as int) || ', 250]]' as target, '[[' || cast(round_even(y * 10, 0) as int) || ', 250]]<LAM_' || step || '>' as trace_first, '<LAM_' || step || '>' as latent_only from traj")
def semantic_target(v):
    latent = X.latent_tokens(F.array("step"))
    trace = X.trace_to_text(F.array(F.struct((F.col("y") / 100).alias("x"), F.lit(0.25).alias("y"))), "cot_bbox")
    say = lambda mode, order="trace_latent": X.semantic_target(mode, trace, latent, order)
    return v.traj().select("event_id", say("trace_latent", "latent_trace").alias("target"), say("trace_latent").alias("trace_first"), say("latent_only").alias("latent_only"))


_ANSWERS = """case event_id % 4 when 0 then '[[' || cast(y as int) || '.7, 900], [-5, 2000]]' when 1 then 'Sure: [' || cast(y as int) || ', 900] and [0.5, 3], then [7,8]' when 2 then '[{"point_2d": [' || cast(y as int) || ', 900], "label": "start"}, {"label": "end"}]' else 'nothing' end"""


@query("with " + TRAJ + """ select event_id, '[{"point_2d": [' || cast(round_even(y * 10, 0) as int) || ', 500], "label": "start"}, {"point_2d": [0, 0], "label": "one_third"}, {"point_2d": [0, 0], "label": "two_third"}, {"point_2d": [0, 0], "label": "end"}, {"point_2d": [0, 1000], "label": "anchor_4"}]' as text from traj""")
def trace_labels(v):
    s = lambda a, b: F.struct(a.alias("x"), F.lit(b).alias("y"))
    points = F.array(s(F.col("y") / 100, 0.5), *[s(F.lit(0.0), 0.0)] * 3, s(F.lit(-0.5), 1.0))
    return v.traj().select("event_id", X.trace_to_text(points, "qwen_point_2d").alias("text"))


@query("with " + TRAJ + f""", t as (select event_id, y, {_ANSWERS} as answer from traj) select event_id, answer,
 case when event_id % 4 = 3 then 0 else cast(y as int) / 1000.0::double end as x0, case when event_id % 4 = 3 then 0 else 0.9::double end as y0,
 case event_id % 4 when 0 then 0 when 1 then 0.007::double when 2 then cast(y as int) / 1000.0::double else 0 end as x1,
 case event_id % 4 when 0 then 1 when 1 then 0.008::double when 2 then 0.9::double else 0 end as y1 from t""")
def trace_answers(v):
    y = F.col("y").cast("int").cast("string")
    k = F.col("event_id") % 4
    answer = (
        F.when(k == 0, F.concat(F.lit("[["), y, F.lit(".7, 900], [-5, 2000]]")))
        .when(k == 1, F.concat(F.lit("Sure: ["), y, F.lit(", 900] and [0.5, 3], then [7,8]")))
        .when(k == 2, F.concat(F.lit('[{"point_2d": ['), y, F.lit(', 900], "label": "start"}, {"label": "end"}]')))
        .otherwise("nothing")
    )
    read = F.when(k == 2, X.text_to_trace(F.col("answer"), 2, "qwen_point_2d")).otherwise(X.text_to_trace(F.col("answer"), 2))
    t = v.traj().select("event_id", answer.alias("answer")).withColumn("p", read)
    return t.select("event_id", "answer", *(F.col("p")[i][c].alias(f"{c}{i}") for i in (0, 1) for c in ("x", "y")))


@query("select event_id, props as obj, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def extract_json(v):
    found = X.json_object(F.concat(F.lit("Sure! Here it is:\n"), F.col("props"), F.lit("\nDone.")))
    return v.t("events").select("event_id", found.alias("obj")).withColumn("k", F.get_json_object("obj", "$.k").cast("long"))


@query("select label_, case when label_ % 5 < 4 then (['spatial', 'object', 'goal', '10'])[label_ % 5 + 1] else '' end as suite from (select distinct label as label_ from embeddings)")
def suite_parse(v):
    k = F.col("label_") % 5
    name = F.concat(F.lit("LIBERO_"), F.element_at(F.array(*map(F.lit, ("spatial", "object", "goal", "10", "90"))), k + 1), F.lit("_no_noops"))
    return v.t("embeddings").select(F.col("label").alias("label_")).distinct().select("label_", X.suite(name).alias("suite"))


@query("""select p_partkey, case p_partkey % 6 when 0 then p_size::double when 1 then p_size / 1024.0::double when 2 then p_size * 1024.0::double when 3 then p_size / 1048576.0::double
 when 4 then p_size / 1073741824.0::double else 0 end as gb from part""")
def size_parse(v):
    unit = F.get(F.array(*map(F.lit, ("GB", "MB/9G", "T", "kB", " MB"))), (F.col("p_partkey") % 6).cast("int"))
    return v.t("part").select("p_partkey", X.gigabytes(F.coalesce(F.concat(F.lit(" "), F.col("p_size").cast("string"), unit), F.lit("size 5GB"))).alias("gb"))


@query("select p_partkey, replace(replace(replace(lower(p_name || ' / ' || p_brand || '_(x)'), '_', '-'), '/', '-'), ' ', '-') as slug from part")
def slugify(v):
    return v.t("part").select("p_partkey", X.slug(F.concat(F.lit("  "), "p_name", F.lit(" / "), "p_brand", F.lit("_(x) "))).alias("slug"))


@query("select event_id, case event_type when 'click' then 'delta' when 'view' then 'rel' else 'abs' end as mode from events")
def mode_normalise(v):
    raw = F.when(F.col("event_type") == "click", "Delta").when(F.col("event_type") == "view", "rel").when(F.col("event_type") == "error", "raw").otherwise("what")
    return v.t("events").select("event_id", X.mode(raw).alias("mode"))


@query("select c_custkey, substr(md5(c_name || '|' || c_mktsegment), 1, 12) as key from customer")
def config_hash(v):
    return v.t("customer").select("c_custkey", X.config_key(F.col("c_name"), F.col("c_mktsegment")).alias("key"))


@query("select c_custkey, case c_custkey % 3 when 0 then 'observation.images.cam.' || c_nationkey when 1 then 'action_dict.' || c_nationkey else 'observation.state' end as name from customer".replace("images.cam.", "images.image_"))
def column_name(v):
    k, n = F.col("c_custkey") % 3, F.col("c_nationkey").cast("string")
    path = F.when(k == 0, F.concat(F.lit("steps/observation/image_"), n)).when(k == 1, F.concat(F.lit("steps/action_dict/"), n)).otherwise("steps/observation/state")
    return v.t("customer").select("c_custkey", X.column_name(path).alias("name"))


@query("select distinct user_id as episode from events where user_id % 3 = 0")
def episode_list(v):
    from frameflow.sources.text import episodes_of_lines

    lines = v.t("events").select(F.when(F.col("user_id") % 3 == 0, F.concat(F.col("user_id").cast("string"), F.lit(" some note"))).otherwise(F.concat(F.lit("# "), F.col("user_id").cast("string"))).alias("value"))
    return episodes_of_lines(lines)


@query("with p as (select c_custkey, 'set' || c_nationkey || case when c_custkey % 2 = 0 then '%' || (c_custkey % 90 + 10) else '' end as name, case when c_custkey % 2 = 0 then (c_custkey % 90 + 10) / 100.0::double else 1.0 end as rate from customer) select * from p")
def rate_suffix(v):
    n = F.concat(F.lit("set"), F.col("c_nationkey").cast("string"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("%"), (F.col("c_custkey") % 90 + 10).cast("string"))).otherwise(""))
    return v.t("customer").select("c_custkey", n.alias("name")).withColumn("rate", X.rate(F.col("name")))
