"""Queries on frame clocks, decimation and windows of frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillframe.functions import scalars
from rillframe.operators import sequence, stats
from rillframe.operators.folds import keep_cadence
from rillframe.plans.registry import Registry
from rillframe.sources.tables import table

query = Registry()

FRAMES_SQL = "select distinct recording_id, frame, t_left_us, t_right_us, skew_us, fresh from sync_log where t_left_us is not null"


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """Logged frames with a left time, once each."""
    cols = ["recording_id", "frame", "t_left_us", "t_right_us", "skew_us", "fresh"]
    return table(spark, folder, "sync_log").select(*cols).where("t_left_us is not null").dropDuplicates(["recording_id", "frame"])


def host_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Frames on the host clock."""
    rec = table(spark, folder, "recordings").select("recording_id", "cam_reset_perf_counter_us")
    return frames(spark, folder).join(rec, "recording_id").withColumn("host_us", F.try_add("cam_reset_perf_counter_us", "t_left_us"))


HOST_SQL = f"select f.*, cam_reset_perf_counter_us + t_left_us as host_us from ({FRAMES_SQL}) f join recordings using (recording_id)"


@query(f"select recording_id, frame, host_us from ({HOST_SQL})")
def host_clock(spark: SparkSession, folder: str) -> DataFrame:
    """Camera counter to host clock."""
    return host_frames(spark, folder).select("recording_id", "frame", "host_us")


@query(f"select recording_id, frame, coalesce(lead(t_left_us) over w > t_left_us, true) as valid from ({FRAMES_SQL}) window w as (partition by recording_id order by frame)")
def monotonic_valid(spark: SparkSession, folder: str) -> DataFrame:
    """Frames whose successor is later."""
    return sequence.mark_monotonic(frames(spark, folder), by=["recording_id"], order=["frame"], time="t_left_us").select("recording_id", "frame", "valid")


@query(f"""
with v as (select recording_id, frame, t_left_us, coalesce(lead(t_left_us) over w > t_left_us, true) as ok from ({FRAMES_SQL}) window w as (partition by recording_id order by frame)),
m as (select *, max(case when ok then t_left_us end) over (partition by recording_id order by frame rows between unbounded preceding and 1 preceding) as most from v)
select recording_id, frame, t_left_us from m where ok and (most is null or t_left_us > most)""")
def monotonic_run(spark: SparkSession, folder: str) -> DataFrame:
    """The strictly increasing run of valid frames."""
    return sequence.increasing_run(frames(spark, folder), by=["recording_id"], order=["frame"], time="t_left_us").select("recording_id", "frame", "t_left_us")


@query(f"""
with d as (select recording_id, frame, t_left_us - lag(t_left_us) over (partition by recording_id order by frame) as d from ({FRAMES_SQL})),
m as (select *, median(case when d > 0 then d end) over (partition by recording_id) as med from d)
select recording_id, frame, round(sum(case when d > 0 then d::double when d is not null then med else 0 end) over (partition by recording_id order by frame rows unbounded preceding) / 1e6, 7) as time_s from m""")
def repaired_timeline(spark: SparkSession, folder: str) -> DataFrame:
    """Seconds since the first frame, with steps that don't advance replaced."""
    rows = sequence.repaired_timeline(frames(spark, folder), by=["recording_id"], order=["frame"], time="t_left_us")
    return rows.select("recording_id", "frame", F.round("time_s", 7).alias("time_s"))


@query(f"""
with d as (select recording_id, t_left_us - lag(t_left_us) over (partition by recording_id order by frame) as d from ({FRAMES_SQL}))
select recording_id, median(case when d > 0 then d end)::double as median_delta, count(case when d > 0 then 1 end) as n from d group by recording_id""")
def median_delta(spark: SparkSession, folder: str) -> DataFrame:
    """Median positive frame step per recording."""
    return stats.median_positive_delta(frames(spark, folder), by=["recording_id"], order=["frame"], value="t_left_us")


@query(f"select recording_id, frame, t_left_us from (select *, row_number() over (partition by recording_id order by frame) - 1 as n from ({FRAMES_SQL})) where n % 4 = 0")
def stride_decimation(spark: SparkSession, folder: str) -> DataFrame:
    """Every fourth matched frame."""
    return sequence.stride(frames(spark, folder), by=["recording_id"], order=["frame"], every=4).select("recording_id", "frame", "t_left_us")


@query("""
with s as (select recording_id, frame_count as n, greatest(fps / 12.0, 1.0) as step from recordings where fps is not null and frame_count is not null),
k as (select recording_id, n, step, unnest(range(0, ceil(n / step)::bigint)) as k from s)
select distinct recording_id, round_even(k * step, 0)::bigint as frame from k where round_even(k * step, 0) < n""")
def fractional_decimation(spark: SparkSession, folder: str) -> DataFrame:
    """Frames kept when a recording is brought down to twelve a second."""
    rec = table(spark, folder, "recordings").where("fps is not null and frame_count is not null")
    return rec.select("recording_id", F.explode(sequence.fractional_indices(F.col("frame_count"), F.col("fps") / F.lit(12.0))).alias("frame"))


@query(f"""
select recording_id, frame, (n % 15 = 0 or last) as right_eye from (
  select recording_id, frame, row_number() over w - 1 as n, lead(frame) over w is null as last from ({FRAMES_SQL}) window w as (partition by recording_id order by frame))""")
def sparse_sampling(spark: SparkSession, folder: str) -> DataFrame:
    """Frames whose right eye is used: every fifteenth and the last."""
    return sequence.sparse_sample(frames(spark, folder), by=["recording_id"], order=["frame"], every=15).select("recording_id", "frame", "right_eye")


@query("""
with s as (select recording_id, frame_count as n from recordings where frame_count is not null)
select recording_id, case when n <= 64 then 0 else u end as first_frame from (
  select recording_id, n, unnest(case when n <= 64 then [0] when (n - 64) % 48 = 0 then range(0, n - 64 + 1, 48) else list_append(range(0, n - 64 + 1, 48), n - 64) end)::bigint as u from s)""")
def overlap_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of 64 frames that overlap by 16, the last one at the end."""
    rec = table(spark, folder, "recordings").where("frame_count is not null")
    return rec.select("recording_id", F.explode(sequence.window_starts(F.col("frame_count"), 64, 16)).alias("first_frame"))


@query("""
with c as (select calib_id, num_views as n from (select distinct calib_id, num_views from calibrations) where num_views > 0),
f as (select calib_id, n, unnest(range(0, n)) as i from c)
select calib_id, i::bigint as center, greatest(0, least(i - 4, n - 8))::bigint as first from f""")
def centered_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of eight around each view, moved inside where they would stick out."""
    c = table(spark, folder, "calibrations").select("calib_id", F.col("num_views").cast("long").alias("n")).dropDuplicates(["calib_id"]).where("n > 0")
    rows = c.withColumn("center", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return rows.select("calib_id", "center", F.greatest(F.lit(0), F.least(F.col("center") - 4, F.col("n") - 8)).cast("long").alias("first"))


@query(f"""
with w as (select recording_id, frame, t_left_us as t, lag(frame) over w as pf, lead(frame) over w as nf, lag(t_left_us) over w as pt, lead(t_left_us) over w as nt from ({FRAMES_SQL}) window w as (partition by recording_id order by frame)),
r as (select *, median(case when frame - pf = 1 then t - pt end) over (partition by recording_id) as ref from w)
select recording_id, frame, round(case when t > pt then ref / (t - pt) end, 9) as prev_scale, round(case when nt > t then ref / (nt - t) end, 9) as next_scale
from r where frame - pf = 1 and nf - frame = 1""")
def accel_triples(spark: SparkSession, folder: str) -> DataFrame:
    """Frames with both neighbours, and how their steps compare to the usual one."""
    rows = sequence.accel_triples(frames(spark, folder), by=["recording_id"], frame="frame", time="t_left_us")
    return rows.select("recording_id", "frame", F.round("prev_scale", 9).alias("prev_scale"), F.round("next_scale", 9).alias("next_scale"))


@query(f"""
select recording_id, frame, (0.5 * (lag(t_left_us) over w - t_left_us) + 0.25 * (lead(t_left_us) over w - t_left_us))::double as second
from ({FRAMES_SQL}) window w as (partition by recording_id order by frame)""")
def second_difference(spark: SparkSession, folder: str) -> DataFrame:
    """Scaled second differences of frame times."""
    rows = sequence.second_difference(frames(spark, folder), by=["recording_id"], order=["frame"], value="t_left_us", prev_scale=F.lit(0.5), next_scale=F.lit(0.25))
    return rows.select("recording_id", "frame", "second")


@query(f"""
with w as (select recording_id, frame, t_left_us as t, skew_us as s, lead(frame) over w as nf, lead(t_left_us) over w as nt, lead(skew_us) over w as ns from ({FRAMES_SQL}) window w as (partition by recording_id order by frame)),
g as (select *, unnest(range(frame + 1, nf)) as f from w where nf - frame between 2 and 6)
select recording_id, frame, round(s::double, 3) as skew_us, false as interpolated from w
union all
select recording_id, f, round(s + (f - frame)::double / (nf - frame) * (ns - s), 3), true from g""")
def gap_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Skews of frames that were never logged, in gaps of at most five."""
    rows = sequence.fill_gaps(frames(spark, folder), by=["recording_id"], frame="frame", time="t_left_us", values=["skew_us"], longest=5)
    return rows.select("recording_id", "frame", F.round(F.col("skew_us").cast("double"), 3).alias("skew_us"), "interpolated")


@query(f"""
with recursive f as (select distinct recording_id, frame from ({FRAMES_SQL})),
k as (select recording_id, min(frame) as frame from f group by recording_id
      union all select k.recording_id, (select min(f.frame) from f where f.recording_id = k.recording_id and f.frame >= k.frame + 97) from k where k.frame is not null)
select recording_id, frame from k where frame is not null union select recording_id, max(frame) from f group by recording_id""")
def cadence_sample(spark: SparkSession, folder: str) -> DataFrame:
    """First and last frame and those 97 frames after the last one kept."""
    return keep_cadence(frames(spark, folder).select("recording_id", "frame"), by=["recording_id"], frame="frame", gap=97)


@query("""
with s as (select distinct stream_id, sample, host_time_s as t from imu_sample where host_time_s is not null)
select stream_id, sample, round(t::decimal(28,9) * 1000000, 0)::bigint as half_up, round_even(t * 1e6, 0)::bigint as half_even, trunc(t * 1e6)::bigint as cut, floor(t * 1e6)::bigint as floored from s""")
def rounding_modes(spark: SparkSession, folder: str) -> DataFrame:
    """The four ways from seconds to microseconds."""
    s = table(spark, folder, "imu_sample").select("stream_id", "sample", F.col("host_time_s").alias("t")).where("t is not null").dropDuplicates(["stream_id", "sample"])
    t = F.col("t")
    return s.select("stream_id", "sample", scalars.us_half_up(t).alias("half_up"), scalars.us_half_even(t).alias("half_even"), scalars.us_truncated(t).alias("cut"), scalars.us_floored(t).alias("floored"))


@query(f"""
with c as (select distinct chunk_id, recording_id, start_frame, end_frame from chunks where end_frame >= start_frame)
select chunk_id, frame, frame - start_frame as chunk_frame from ({FRAMES_SQL}) f join c using (recording_id) where frame between start_frame and end_frame""")
def frame_slice(spark: SparkSession, folder: str) -> DataFrame:
    """Each chunk's frames, counted from its first."""
    from rillframe.operators.asof import range_join

    c = table(spark, folder, "chunks").select("chunk_id", "recording_id", F.col("start_frame").alias("first"), "end_frame").dropDuplicates(["chunk_id"])
    rows = range_join(frames(spark, folder).select("recording_id", "frame"), c, by=["recording_id"], time="frame", start="first", end="end_frame", take=["chunk_id", "first"], width=1000)
    return rows.select("chunk_id", "frame", (F.col("frame") - F.col("first")).alias("chunk_frame"))


@query("""
select recording_id, chunk_id, row_number() over (partition by recording_id order by start_time_us, chunk_id) - 1 as idx, recording_id || '_' || lpad((row_number() over (partition by recording_id order by start_time_us, chunk_id) - 1)::varchar, 3, '0') as name
from (select distinct chunk_id, recording_id, start_time_us, end_time_us from chunks) where end_time_us >= start_time_us""")
def renumber(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks that aren't void, numbered and named anew."""
    c = table(spark, folder, "chunks").select("chunk_id", "recording_id", "start_time_us", "end_time_us").dropDuplicates(["chunk_id"]).where("end_time_us >= start_time_us")
    rows = sequence.renumber(c, by=["recording_id"], order=["start_time_us", "chunk_id"], out="idx")
    return rows.select("recording_id", "chunk_id", F.col("idx").cast("long").alias("idx"), F.concat_ws("_", "recording_id", F.lpad(F.col("idx").cast("string"), 3, "0")).alias("name"))


@query("""
with n as (select recording_id, unnest(range(0, frame_count)) as frame from recordings where frame_count is not null),
s as (select distinct recording_id, frame, t_left_us, fresh from sync_log)
select n.recording_id, n.frame, coalesce(t_left_us, -1) as t_left_us, coalesce(fresh, 0) = 1 as fresh from n left join s using (recording_id, frame)
where n.recording_id in (select recording_id from sync_log)""")
def dense_spine(spark: SparkSession, folder: str) -> DataFrame:
    """Every frame of the recordings that keep a log, logged or not; -1 where the time is missing."""
    log = table(spark, folder, "sync_log").select("recording_id", "frame", "t_left_us", "fresh").dropDuplicates(["recording_id", "frame"])
    rec = table(spark, folder, "recordings").select("recording_id", "frame_count").where("frame_count > 0").join(log.select("recording_id"), "recording_id", "left_semi")
    spine = rec.select("recording_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("frame_count") - 1)).alias("frame"))
    rows = spine.join(log, ["recording_id", "frame"], "left")
    return rows.select("recording_id", "frame", F.coalesce("t_left_us", F.lit(-1)).cast("long").alias("t_left_us"), (F.coalesce("fresh", F.lit(0)) == 1).alias("fresh"))
