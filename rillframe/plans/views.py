"""Queries of calibration views, graphs, selections and pairings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillframe.functions import camera, scalars
from rillframe.functions import geometry as G
from rillframe.operators import calibrate, graphs, sequence
from rillframe.operators.grid import finite
from rillframe.plans.clock import FRAMES_SQL, frames
from rillframe.plans.registry import Registry
from rillframe.sources import probes
from rillframe.sources.tables import table

query = Registry()


@query("""
with c as (select l_orderkey % 500 as pair, l_partkey % 40 as corner, l_linenumber % 2 as side, min(l_quantity) as x from lineitem group by 1, 2, 3),
b as (select l.pair, l.corner, l.x as left_x, r.x as right_x, count(*) over (partition by l.pair) as n from c l join c r on l.pair = r.pair and l.corner = r.corner and l.side = 0 and r.side = 1)
select pair, corner, left_x, right_x from b where n >= 3""")
def shared_corners(spark: SparkSession, folder: str) -> DataFrame:
    """Corners that both sides of a pair see, where these are three at least."""
    c = table(spark, folder, "lineitem").groupBy((F.col("l_orderkey") % 500).alias("pair"), (F.col("l_partkey") % 40).alias("corner"), (F.col("l_linenumber") % 2).alias("side")).agg(F.min("l_quantity").alias("x"))
    left, right = (c.where(F.col("side") == k).select("pair", "corner", F.col("x").alias(name)) for k, name in ((0, "left_x"), (1, "right_x")))
    return calibrate.shared_corners(left, right, on=["pair"], least=3).select("pair", "corner", "left_x", "right_x")


@query("""
select l_orderkey, l_linenumber, l_quantity / 50 >= 0.35 and l_linenumber * 4 >= greatest(6, floor(l_suppkey % 40 / 2)) as sharp,
 case when l_tax / 40 > 0.001 then 'clipped' when l_quantity / 50 < 0.15 then 'too dark' end as refusal,
 case when l_tax / 40 > 0.001 then 'clipping' when l_quantity / 50 > 0.70 then 'too bright' when l_quantity / 50 < 0.40 then 'too dark' else 'ok' end as band from lineitem""")
def view_gates(spark: SparkSession, folder: str) -> DataFrame:
    """Whether views are sharp enough, and where white measurements lie."""
    level, clipped = F.col("l_quantity") / 50, F.col("l_tax") / 40
    sharp = calibrate.sharp_enough(level, F.col("l_linenumber") * 4, F.col("l_suppkey") % 40)
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", sharp.alias("sharp"), calibrate.white_refusal(clipped, level).alias("refusal"), calibrate.white_band(clipped, level).alias("band"))


@query("""
with p as (select label, vec_id, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z, 0.2 * embedding[4]::double as a from embeddings),
l as (select *, lag(x) over w as px, lag(y) over w as py, lag(z) over w as pz, lag(a) over w as pa from p window w as (partition by label order by vec_id))
select label, vec_id, coalesce(sqrt((x - px) ^ 2 + (y - py) ^ 2 + (z - pz) ^ 2) < 0.25 and degrees(abs(a - pa)) < 2.5, false) as steady from l""")
def steady_views(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a view has hardly moved or turned since the one before."""
    e = lambda k: F.col("embedding")[k].cast("double")
    about_z = G.quat_from_axis_angle(G.vec(F.lit(0.0), F.lit(0.0), 0.2 * e(3)))
    rows = table(spark, folder, "embeddings").select("label", "vec_id", G.pose(about_z, G.vec(e(0), e(1), e(2))).alias("pose"))
    return rows.select("label", "vec_id", calibrate.steady(["label"], "vec_id", "pose", shift=0.25, degrees=2.5).alias("steady"))


@query("""
with recursive p as (select label, vec_id, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z, row_number() over (partition by label order by vec_id) as n from embeddings),
r as (select distinct label, 0::bigint as n, []::struct(x double, y double, z double)[] as kept, null::bigint as vec_id from p union all
 select p.label, p.n, case when len(list_filter(kept, lambda k: sqrt((k.x - p.x) ^ 2 + (k.y - p.y) ^ 2 + (k.z - p.z) ^ 2) < 0.2)) = 0 then list_append(kept, {'x': p.x, 'y': p.y, 'z': p.z}) else kept end,
  case when len(list_filter(kept, lambda k: sqrt((k.x - p.x) ^ 2 + (k.y - p.y) ^ 2 + (k.z - p.z) ^ 2) < 0.2)) = 0 then p.vec_id end from r join p on p.label = r.label and p.n = r.n + 1)
select label, vec_id from r where vec_id is not null""")
def novel_views(spark: SparkSession, folder: str) -> DataFrame:
    """Views away from all that were kept before."""
    e = lambda k: F.col("embedding")[k].cast("double")
    still = G.quat(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))
    rows = table(spark, folder, "embeddings").select("label", "vec_id", G.pose(still, G.vec(e(0), e(1), e(2))).alias("pose"))
    return calibrate.novel_views(rows, by=["label"], order="vec_id", pose="pose", shift=0.2, degrees=10.0)


@query(f"""
with k as (select recording_id, frame from ({FRAMES_SQL}) where frame % 7 = 0), t as (select distinct chunk_id, recording_id, start_frame as a, end_frame as b from chunks where start_frame is not null and end_frame is not null),
m as (select t.*, (select k.frame from k where k.recording_id = t.recording_id order by abs(k.frame - t.a), k.frame limit 1) as fa, (select k.frame from k where k.recording_id = t.recording_id order by abs(k.frame - t.b), k.frame limit 1) as fb from t)
select chunk_id, fa as frame_a, fb as frame_b from m""")
def snapped_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Ends of chunks moved to the nearest of every seventh frame."""
    kept = frames(spark, folder).where("frame % 7 = 0").select("recording_id", "frame")
    pairs = table(spark, folder, "chunks").select("chunk_id", "recording_id", F.col("start_frame").alias("frame_a"), F.col("end_frame").alias("frame_b")).dropna(subset=["frame_a", "frame_b"]).distinct()
    return graphs.snapped_pairs(pairs, kept, by=["recording_id"], frame="frame", a="frame_a", b="frame_b").select("chunk_id", "frame_a", "frame_b")


@query("""
with a as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as n from orders), b as (select user_id, event_id, row_number() over (partition by user_id order by event_id) as n from events)
select o_custkey as key, o_orderkey, event_id from a join b on a.o_custkey = b.user_id and a.n = b.n""")
def zipped_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's n-th order with their n-th event."""
    a = table(spark, folder, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("day"))
    b = table(spark, folder, "events").select(F.col("user_id").alias("key"), "event_id")
    return sequence.zip_rows(a, b, by=["key"], left_order=["day", "o_orderkey"], right_order=["event_id"]).select("key", "o_orderkey", "event_id")


@query("select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as n from orders) where n = 1")
def first_per_key(spark: SparkSession, folder: str) -> DataFrame:
    """Each customer's dearest order."""
    rows = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return sequence.first_per_key(rows, keys=["o_custkey"], order=[F.col("o_totalprice").desc(), F.col("o_orderkey")])


@query("""
with u as (select user_id, list(distinct event_type) as kinds from events group by 1)
select a.user_id, len(list_filter(a.kinds, lambda k: not list_contains(b.kinds, k))) = 0 as held from u a join u b on b.user_id = a.user_id + 1""")
def subset_of_next(spark: SparkSession, folder: str) -> DataFrame:
    """Whether all kinds of a user's events are among the next user's."""
    u = table(spark, folder, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"))
    other = u.select((F.col("user_id") - 1).alias("user_id"), F.col("kinds").alias("others"))
    return u.join(other, "user_id").select("user_id", graphs.is_subset(F.col("kinds"), F.col("others")).alias("held"))


@query("select l_orderkey, l_linenumber, abs(l_extendedprice - l_quantity * 1000) <= greatest(5000.0, 0.1 * abs(l_quantity * 1000)) as within from lineitem")
def within_tolerance(spark: SparkSession, folder: str) -> DataFrame:
    """Prices near a thousand a piece."""
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", scalars.within_tolerance(F.col("l_extendedprice"), F.col("l_quantity") * 1000, 5000.0, 0.1).alias("within"))


@query("select stream_id, sample, bool_or(ax is not null and not isnan(ax)) as ax_finite, bool_or(mx is not null and not isnan(mx)) as mx_finite from imu_sample group by 1, 2")
def finite_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Which readings are numbers."""
    rows = table(spark, folder, "imu_sample").groupBy("stream_id", "sample").agg(*(F.bool_or(finite(F.col(c))).alias(f"{c}_finite") for c in ("ax", "mx")))
    return rows


@query("select distinct calib_id, num_views * 3.5 - (calib_id % 64) as cx, num_views * 2.5 - (calib_id % 32) as cy from calibrations")
def roi_shift(spark: SparkSession, folder: str) -> DataFrame:
    """Principal points in the coordinates of a cut-out."""
    c = camera.shift_to_roi(F.col("num_views") * 3.5, F.col("num_views") * 2.5, F.col("calib_id") % 64, F.col("calib_id") % 32)
    rows = table(spark, folder, "calibrations").select("calib_id", c.alias("c")).distinct()
    return rows.select("calib_id", F.col("c.cx").alias("cx"), F.col("c.cy").alias("cy"))


@query("""
with t as (select distinct trigger_id, recording_id, start_us / 1e6 as packet, end_us / 1e6 as finish, has_imu_log from triggers join recordings using (recording_id))
select trigger_id, start_us, case when start_us > 0 and end_us >= start_us then end_us - start_us else end_us end / 1e6 as length
from (select trigger_id, case when trigger_id % 3 = 0 then floor(7 * 1e6 + 0.5) else round(packet * 1e6) end::bigint as start_us, round(finish * 1e6)::bigint as end_us from t)""")
def audio_starts(spark: SparkSession, folder: str) -> DataFrame:
    """Where probed audio starts and how long it is: the packet's time, else the stream's."""
    from rillframe.plans.joins import triggers

    text = lambda us: F.format_string("%.6f", us / F.lit(1e6))
    third = F.col("trigger_id") % 3 == 0
    rows = triggers(spark, folder).join(table(spark, folder, "recordings").select("recording_id"), "recording_id").select("trigger_id", F.when(third, F.lit("N/A")).otherwise(text(F.col("start_us"))).alias("packet_pts"), F.lit("7.000000").alias("stream_start"), F.lit("N/A").alias("stream_duration"), text(F.col("end_us")).alias("format_duration"))
    return probes.audio_probe(rows).select("trigger_id", F.col("start_pts_us").alias("start_us"), F.col("duration_s").alias("length"))


@query("""
select l_orderkey, min_by(t, n) as first_us, max_by(t, n) as last_us from (select l_orderkey, (l_linenumber::bigint * 1000000000 + l_partkey) * 1000 + l_quantity::bigint as n, case when l_quantity > 3 then round(l_quantity * 1e6)::bigint end as t from lineitem) where t is not null group by 1""")
def audio_spans(spark: SparkSession, folder: str) -> DataFrame:
    """First and last packet times of printed lines, of which some aren't numbers."""
    li = table(spark, folder, "lineitem")
    some = li.where("l_quantity > 3").select("l_orderkey").distinct()
    line = F.when(F.col("l_quantity") > 3, F.concat(F.col("l_quantity").cast("string"), F.lit(","))).otherwise("N/A")
    rows = li.join(some, "l_orderkey", "left_semi").select(F.col("l_orderkey").alias("recording_id"), ((F.col("l_linenumber").cast("long") * 10**9 + F.col("l_partkey")) * 1000 + F.col("l_quantity").cast("long")).alias("n"), line.alias("line"))
    return probes.audio_spans(rows).withColumnRenamed("recording_id", "l_orderkey")


@query("""
with p as (select l_returnflag as g, l_quantity as x, l_tax * 100 as y, l_discount * 100 as z from lineitem)
select g, count(*) as n, round(avg(x) + 1.5, 6) as x, round(avg(y) - 2.0, 6) as y, round(avg(z) + 0.25, 6) as z from p group by 1""")
def rigid_shift(spark: SparkSession, folder: str) -> DataFrame:
    """Where the fitted rotation and shift bring the middle of points that were all moved alike."""
    li = table(spark, folder, "lineitem")
    x, y, z = F.col("l_quantity"), F.col("l_tax") * 100, F.col("l_discount") * 100
    rows = li.select(F.col("l_returnflag").alias("g"), x.alias("ax"), y.alias("ay"), z.alias("az"), (x + 1.5).alias("bx"), (y - 2.0).alias("by"), (z + 0.25).alias("bz"))
    fits = calibrate.rigid_fits(rows, by=["g"], a=["ax", "ay", "az"], b=["bx", "by", "bz"])
    middle = rows.groupBy("g").agg(*(F.avg(c).alias(c) for c in ("ax", "ay", "az")))
    moved = lambda k: sum((F.col("rotation")[3 * k + j] * F.col(c) for j, c in enumerate(("ax", "ay", "az"))), F.col("shift")[k])
    return fits.join(middle, "g").select("g", "n", *(F.round(moved(k), 6).alias(c) for k, c in enumerate("xyz")))


# Depth pictures of 32 by 32, one for every label: a slope whose height is the label's.
_PIXELS = "select l as view, u, v, 2.0 + (l % 3) * 0.1 + u * 0.001 as depth, 1.0 + (u * 7 + v * 3 + l) % 10 as confidence from (select distinct label as l from embeddings), range(32) r(u), range(32) s(v)"


@query(f"""
with px as ({_PIXELS}), lim as (select view, quantile_cont(confidence, 0.5) as lim from px group by 1), good as (select px.* from px join lim using (view) where confidence >= lim),
pairs as (select distinct a.label as a, b.label as b from embeddings a, embeddings b where b.label = a.label + 1),
ways as (select a, b, a as f, b as t from pairs union all select a, b, b, a from pairs),
p as (select w.*, g.u, g.v, g.depth from ways w join good g on g.view = w.f where (g.u - 2) % 4 = 0 and (g.v - 2) % 4 = 0 and g.u >= 2 and g.v >= 2),
m as (select p.*, q.depth as d from p left join good q on q.view = p.t and q.u = p.u and q.v = p.v),
s as (select a, b, f, avg(case when abs(depth - d) <= 0.05 * greatest(least(depth, d), 1e-6) then 1.0 else 0.0 end) as share from m group by 1, 2, 3)
select a, b, min(share) as overlap from s group by 1, 2""")
def depth_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """How far the depths of views that follow each other confirm each other."""
    labels = table(spark, folder, "embeddings").select(F.col("label").alias("view")).distinct()
    still = G.pose(G.quat(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)), G.vec(F.lit(0.0), F.lit(0.0), F.lit(0.0)))
    views = labels.select("view", still.alias("pose"), *(F.lit(v).alias(c) for c, v in (("fx", 20.0), ("fy", 20.0), ("cx", 16.0), ("cy", 16.0))))
    grid = labels.select("view", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("u")).select("view", "u", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("v"))
    pixels = grid.select("view", "u", "v", (2.0 + F.col("view") % 3 * F.lit(0.1) + F.col("u") * 0.001).alias("depth"), (1.0 + (F.col("u") * 7 + F.col("v") * 3 + F.col("view")) % 10).alias("confidence"))
    pairs = labels.select(F.col("view").alias("a")).join(labels.select(F.col("view").alias("b")), F.col("b") == F.col("a") + 1)
    return calibrate.depth_overlap(pairs, views, pixels, tolerance=0.05)


@query("""
with p as (select vec_id, list_transform(embedding[1:6], lambda x: x::double) as e, vec_id % 5 = 0 as same from embeddings),
g as (select vec_id, [e[1], e[2], e[3]] as g, case when same then [2 * e[1], 2 * e[2], 2 * e[3]] else [e[4], e[5], e[6]] end as b from p),
z as (select vec_id, list_transform(g, lambda x: x / sqrt(list_sum(list_transform(g, lambda y: y * y)))) as z, b from g),
a as (select vec_id, z, list_transform([1, 2, 3], lambda i: b[i] - list_dot_product(b, z) * z[i]) as x, list_transform([1, 2, 3], lambda i: case when i = 3 then 1.0 else 0.0 end - z[3] * z[i]) as o from z),
c as (select vec_id, z, case when sqrt(list_dot_product(x, x)) > 1e-6 then x else o end as x from a),
d as (select vec_id, z, list_transform(x, lambda v: v / sqrt(list_dot_product(x, x))) as x from c)
select vec_id, round(x[1], 6) as xx, round(x[2], 6) as xy, round(x[3], 6) as xz, round(z[2] * x[3] - z[3] * x[2], 6) as yx, round(z[3] * x[1] - z[1] * x[3], 6) as yy, round(z[1] * x[2] - z[2] * x[1], 6) as yz from d""")
def aligned_axes(spark: SparkSession, folder: str) -> DataFrame:
    """Axes of cameras whose rows run along a baseline; every fifth looks along it."""
    e = lambda k: F.col("embedding")[k].cast("double")
    same = F.col("vec_id") % 5 == 0
    base = G.vec(*(F.when(same, e(k) * 2).otherwise(e(k + 3)) for k in range(3)))
    rows = table(spark, folder, "embeddings").select("vec_id", camera.aligned_axes(G.vec(e(0), e(1), e(2)), base).alias("r"))
    return rows.select("vec_id", *(F.round(F.col("r")[a][c], 6).alias(f"{a}{c}") for a in "xy" for c in "xyz"))


@query("""
with r as (select l_orderkey, l_linenumber % 2 as s, l_linenumber as p from lineitem),
g as (select l_orderkey, s, list_sort(list(p)) as ps from r group by 1, 2)
select x.l_orderkey, x.ps[len(x.ps) // 2 + 1] as a, y.ps[len(y.ps) // 2 + 1] as b from g x join g y on x.l_orderkey = y.l_orderkey and x.s = 0 and y.s = 1""")
def loop_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges between the middles of the even and the odd lines of each order."""
    rows = table(spark, folder, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 2).alias("s"), F.col("l_linenumber").alias("p"))
    return graphs.loop_edges(rows, by=["l_orderkey"], segment="s", position="p")


@query("select distinct trigger_id, case when coalesce(case when trigger_id % 4 > 0 then start_us end, -1) < 0 and coalesce(has_imu_log, false) then end_us else coalesce(case when trigger_id % 4 > 0 then start_us end, -1) end as host_us from triggers join recordings using (recording_id)")
def clock_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """Times on the host clock, of which every fourth is missing."""
    from rillframe.plans.joins import triggers

    rows = triggers(spark, folder).join(table(spark, folder, "recordings").select("recording_id", "has_imu_log"), "recording_id")
    own = F.when(F.col("trigger_id") % 4 > 0, F.col("start_us"))
    return rows.select("trigger_id", scalars.host_time(own, F.col("end_us"), F.col("has_imu_log")).alias("host_us"))
