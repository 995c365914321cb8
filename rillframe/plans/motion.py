"""Queries of inertial priors, poses, smoothing and the training table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillframe.functions import geometry as G
from rillframe.functions import scalars
from rillframe.operators import asof as A
from rillframe.operators import kinematics as K
from rillframe.operators import stats
from rillframe.plans.clock import FRAMES_SQL, HOST_SQL, frames, host_frames
from rillframe.plans.joins import IMU_SQL, TRIGGERS_SQL, imu, triggers
from rillframe.plans.registry import Registry
from rillframe.sources.tables import table

query = Registry()
GYRO = ["gx_rad_s", "gy_rad_s", "gz_rad_s"]
ACCEL = ["ax_g", "ay_g", "az_g"]


def _clean_imu(spark: SparkSession, folder: str, cols: list[str]) -> DataFrame:
    rows = imu(spark, folder).select("recording_id", "host_time_us", *cols).dropna()
    for c in cols:
        rows = rows.where(~F.isnan(c))
    return rows


@query(f"""
with h as (select recording_id, frame, host_us from ({HOST_SQL}) where host_us is not null),
i as (select recording_id, host_time_us, min(struct_pack(at := host_time_us, x := ax_g, y := ay_g, z := az_g)) as r from ({IMU_SQL}) where ax_g is not null and ay_g is not null and az_g is not null group by 1, 2),
j as (select recording_id, host_time_us as t, ax_g as x, ay_g as y, az_g as z from ({IMU_SQL}) where ax_g is not null and ay_g is not null and az_g is not null),
l as (select recording_id, max(r) as r from i group by 1),
n as (select h.*, coalesce(i.r, l.r) as r from (select h.recording_id, h.frame, h.host_us from h) h asof left join i on h.recording_id = i.recording_id and h.host_us <= i.host_time_us left join l on l.recording_id = h.recording_id),
m as (select n.recording_id, n.frame, coalesce(avg(j.x), any_value(n.r.x)) as x, coalesce(avg(j.y), any_value(n.r.y)) as y, coalesce(avg(j.z), any_value(n.r.z)) as z, count(j.x) as n from n left join j on j.recording_id = n.recording_id and j.t between n.host_us - 50000 and n.host_us + 50000 group by 1, 2),
k as (select *, sqrt(x*x + y*y + z*z) as g from m where x is not null)
select recording_id, frame, n, round(-x / g, 5) as down_x, round(-y / g, 5) as down_y, round(-z / g, 5) as down_z, round(greatest(0.0, 1 - abs(g - 1) / 0.15), 5) as weight from k""")
def frame_gravity(spark: SparkSession, folder: str) -> DataFrame:
    """Which way is down at each frame: the mean acceleration around it, else the next reading, else the last."""
    accel = _clean_imu(spark, folder, ACCEL)
    left = host_frames(spark, folder).select("recording_id", "frame", "host_us").where("host_us is not null")
    near = A.interval_window(left, accel, by=["recording_id"], left_time="host_us", right_time="host_time_us", half=50_000, aggs={"n": F.count("ax_g"), **{f"m{c}": F.avg(c) for c in ACCEL}})
    rows = A.at_or_after_else_last(near, accel, by=["recording_id"], left_time="host_us", right_time="host_time_us", take=ACCEL)
    rows = rows.select("recording_id", "frame", "n", *(F.coalesce(f"m{c}", f"match.{c}").alias(c) for c in ACCEL)).where("ax_g is not null")
    g = F.sqrt(sum((F.col(c) * F.col(c) for c in ACCEL), F.lit(0.0)))
    rows = rows.withColumn("g", g)
    return rows.select("recording_id", "frame", "n", *(F.round(-F.col(c) / F.col("g"), 5).alias(f"down_{x}") for c, x in zip(ACCEL, "xyz")), F.round(scalars.linear_taper(F.col("g") - 1, 0.15), 5).alias("weight"))


@query()
def relative_rotation(spark: SparkSession, folder: str) -> DataFrame:
    """How the rig turned from each frame to the next, by its angular rates."""
    left = host_frames(spark, folder).select("recording_id", "frame", "host_us").where("host_us is not null")
    rows = K.relative_rotations(left, _clean_imu(spark, folder, GYRO), by=["recording_id"], frame="frame", frame_time="host_us", gyro_time="host_time_us", rates=GYRO)
    return rows.select("recording_id", "frame", *(F.round(F.col("rotation")[c], 6).alias(f"q{c}") for c in "wxyz"), "n_steps", "valid")


@query()
def quat_fold(spark: SparkSession, folder: str) -> DataFrame:
    """All rotations of a recording, one after the other."""
    left = host_frames(spark, folder).select("recording_id", "frame", "host_us").where("host_us is not null")
    rows = K.relative_rotations(left, _clean_imu(spark, folder, GYRO), by=["recording_id"], frame="frame", frame_time="host_us", gyro_time="host_time_us", rates=GYRO)
    out = K.quat_product(rows.where("valid"), by=["recording_id"], order=["frame"], quat="rotation")
    return out.select("recording_id", "n", *(F.round(c, 6).alias(c) for c in "wxyz"))


@query("""
with recursive s as (select label, vec_id, row_number() over (partition by label order by vec_id) as n, list_transform(embedding[1:7], lambda x: x::double) as p from embeddings),
e as (select *, sqrt(p[1] * p[1] + p[2] * p[2] + p[3] * p[3] + p[4] * p[4]) as m from s),
r as (select distinct label, null::bigint as vec_id, 0::bigint as n, 1.0::double as w, 0.0::double as x, 0.0::double as y, 0.0::double as z, [0.0, 0.0, 0.0]::double[] as t from e union all
 select label, vec_id, n, a * w - b * x - c * y - d * z, a * x + b * w + c * z - d * y, a * y - b * z + c * w + d * x, a * z + b * y - c * x + d * w,
  [t[1] + a * u + c * k - d * v + p[5], t[2] + a * v + d * u - b * k + p[6], t[3] + a * k + b * v - c * u + p[7]] from (
  select *, 2 * (c * t[3] - d * t[2]) as u, 2 * (d * t[1] - b * t[3]) as v, 2 * (b * t[2] - c * t[1]) as k from (
   select e.label, e.vec_id, e.n, e.p, r.w, r.x, r.y, r.z, r.t, p[1] / m as a, p[2] / m as b, p[3] / m as c, p[4] / m as d from r join e on e.label = r.label and e.n = r.n + 1)))
select label, vec_id, round(w, 5) as qw, round(x, 5) as qx, round(y, 5) as qy, round(z, 5) as qz, round(t[1], 5) as tx, round(t[2], 5) as ty, round(t[3], 5) as tz from r where n > 0""")
def pose_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Poses reached by chaining the vectors' relative poses, label by label."""
    e = F.col("embedding").cast("array<double>")
    p = table(spark, folder, "embeddings").select("label", "vec_id", G.from_row(F.slice(e, 1, 7)).alias("p"))
    out = K.chain_poses(p, by=["label"], order="vec_id", pose="p")
    return out.select("label", "vec_id", *(F.round(F.col("pose.q")[c], 5).alias(f"q{c}") for c in "wxyz"), *(F.round(F.col("pose.t")[c], 5).alias(f"t{c}") for c in "xyz"))


@query(f"""
with recursive v as (select recording_id, t_left_us as t, skew_us::double as v from ({FRAMES_SQL}) where skew_us is not null),
f as (select *, row_number() over w as n, 1 - exp(-(t - lag(t) over w) / 1e6 / 0.2) as k, row_number() over (partition by recording_id order by t desc, v desc) as m, 1 - exp(-(lead(t) over w - t) / 1e6 / 0.2) as km from v window w as (partition by recording_id order by t, v)),
a as (select recording_id, n, v as x from f where n = 1 union all select f.recording_id, f.n, x + k * (v - x) from a join f on f.recording_id = a.recording_id and f.n = a.n + 1),
b as (select recording_id, m, v as x from f where m = 1 union all select f.recording_id, f.m, x + km * (v - x) from b join f on f.recording_id = b.recording_id and f.m = b.m + 1)
select recording_id, t, round((a.x + b.x) / 2, 2) as smooth from f join a using (recording_id, n) join b using (recording_id, m)""")
def ema_bidirectional(spark: SparkSession, folder: str) -> DataFrame:
    """Skew smoothed forwards and backwards."""
    rows = frames(spark, folder).where("skew_us is not null").select("recording_id", F.col("t_left_us").alias("t"), F.col("skew_us").cast("double").alias("skew"))
    out = K.smooth_both_ways(rows, by=["recording_id"], time="t", value="skew", tau=0.2)
    return out.select("recording_id", "t", F.round("smooth", 2).alias("smooth"))


@query("""
with recursive e as (select user_id, value / 40 as level, row_number() over (partition by user_id order by event_id) as n from events),
r as (select distinct user_id, 0::bigint as n, 8.3333::double as exposure, 1.0::double as gain from e union all
 select user_id, n, case when still then old else chosen end, case when still then old_gain else least(16.0, greatest(1.0, light / chosen)) end from (
  select *, case when light > 8.3333 * 16 or (old > 8.3333 and light > 8.3333 * 16 * 0.9) then 16.6667 else 8.3333 end as chosen from (
   select e.user_id, e.n, exposure as old, gain as old_gain, level is null or abs(ln(0.35 / greatest(level, 1e-4))) <= 0.08 as still,
    exposure * gain * exp(least(ln(1.5), greatest(-ln(1.5), 0.25 * ln(0.35 / greatest(coalesce(level, 1), 1e-4))))) as light from r join e on e.user_id = r.user_id and e.n = r.n + 1)))
select user_id, n - 1 as step, round(exposure, 5) as exposure, round(gain, 5) as gain from r where n > 0""")
def exposure_control(spark: SparkSession, folder: str) -> DataFrame:
    """Exposure and gain that follow each user's events as if they were metered levels."""
    ev = table(spark, folder, "events").select("user_id", "event_id", (F.col("value") / 40).alias("level"))
    out = K.exposure_steps(ev, by=["user_id"], order=["event_id"], level="level")
    return out.select("user_id", "step", F.round("exposure", 5).alias("exposure"), F.round("gain", 5).alias("gain"))


@query(f"""
with l as (select recording_id, frame, host_us, skew_us, fresh from ({HOST_SQL})), n as (select recording_id, unnest(range(0, frame_count)) as frame from recordings where recording_id in (select recording_id from sync_log) and frame_count is not null),
h as (select recording_id, host_us, min(frame) as frame from l where host_us is not null group by 1, 2), t as ({TRIGGERS_SQL}),
b as (select trigger_id, t.recording_id, h.frame, start_us - h.host_us as d from t asof left join h on t.recording_id = h.recording_id and t.start_us >= h.host_us),
f as (select trigger_id, h.frame, h.host_us - start_us as d from t asof left join h on t.recording_id = h.recording_id and t.start_us <= h.host_us),
v as (select recording_id, case when b.d is null or f.d < b.d then f.frame else b.frame end as frame, count(*) as voice from b join f using (trigger_id) group by 1, 2)
select recording_id, frame, coalesce(host_us, -1) as host_us, host_us is not null as logged, coalesce(fresh, 0) = 1 as fresh, skew_us, coalesce(voice, 0) as voice from n left join l using (recording_id, frame) left join v using (recording_id, frame)""")
def training_table(spark: SparkSession, folder: str) -> DataFrame:
    """One row for every frame of a recording: time, skew and how many commands were given at it."""
    log = host_frames(spark, folder).select("recording_id", "frame", "host_us", "skew_us", "fresh")
    rec = table(spark, folder, "recordings").select("recording_id", "frame_count").where("frame_count > 0").join(table(spark, folder, "sync_log").select("recording_id"), "recording_id", "left_semi")
    spine = rec.select("recording_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("frame_count") - 1)).alias("frame"))
    said = A.asof(triggers(spark, folder).select("recording_id", "trigger_id", "start_us"), log.where("host_us is not null"), by=["recording_id"], left_time="start_us", right_time="host_us", take=["frame"], direction="nearest")
    said = said.groupBy("recording_id", F.col("match.frame").alias("frame")).agg(F.count(F.lit(1)).alias("voice"))
    rows = spine.join(log, ["recording_id", "frame"], "left").join(said, ["recording_id", "frame"], "left")
    return rows.select("recording_id", "frame", F.coalesce("host_us", F.lit(-1)).cast("long").alias("host_us"), F.col("host_us").isNotNull().alias("logged"), (F.coalesce("fresh", F.lit(0)) == 1).alias("fresh"), "skew_us", F.coalesce("voice", F.lit(0)).cast("long").alias("voice"))


@query("""
with r as (select l_orderkey, l_extendedprice / 1000 - 35 as r from lineitem)
select l_orderkey, round(sqrt(avg(r * r)), 6) as rms, round(sum(r * r), 3) as cost from r group by 1""")
def residual_cost(spark: SparkSession, folder: str) -> DataFrame:
    """Root mean square and sum of squares of residuals."""
    r = F.col("l_extendedprice") / 1000 - 35
    return table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.round(stats.rms(r), 6).alias("rms"), F.round(F.sum(r * r), 3).alias("cost"))
