"""Queries of the stateful stream steps, run over tables: their SQL goes from row to row by recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillframe.plans.registry import Registry
from rillframe.session import write_steps_small
from rillframe.sources.tables import table
from rillframe.streaming import operators as S
from rillframe.streaming import steps

query = Registry()

# Every user's events in order, as rows of two sides that put and take; levels are a fortieth of the value.
_EVENTS = "select user_id, event_id as t, event_id % 2 as side, value as v, case when event_id % 3 = 2 then 'take' else 'put' end as op, round(value / 10) * 2 + 8 as exposure, round((20 - value) / 5) + 5 as gain from events"
_NUMBERED = f"with recursive e as (select *, row_number() over (partition by user_id order by t) as n from ({_EVENTS}))"


def _events(spark: SparkSession, folder: str) -> DataFrame:
    ev = table(spark, folder, "events")
    return ev.select(
        "user_id", F.col("event_id").alias("t"), (F.col("event_id") % 2).cast("int").alias("side"), F.col("value").alias("v"),
        F.when(F.col("event_id") % 3 == 2, "take").otherwise("put").alias("op"), (F.round(F.col("value") / 10) * 2 + 8).alias("exposure"), (F.round((20 - F.col("value")) / 5) + 5).alias("gain"),
    )


def _fold(spark: SparkSession, folder: str, step: steps.Step, schema: str) -> DataFrame:
    return S.fold_table(_events(spark, folder), key="user_id", order="t", step=step, schema=schema)


@query(f"select user_id, row_number() over (partition by user_id order by t) - 1 as number, t from ({_EVENTS})")
def stream_sequence(spark: SparkSession, folder: str) -> DataFrame:
    """Sequence numbers from 0."""
    return _fold(spark, folder, steps.sequence(), "number long, t long")


@query(f"""
with e as ({_EVENTS}), p as (select l.user_id, l.t, r.t as u, row_number() over (partition by l.user_id, l.t order by r.t desc) as back from e l join e r on l.user_id = r.user_id and l.side = 0 and r.side = 1 and r.t < l.t)
select user_id, t as left_t, arg_min(u, (abs(u - t), u)) as right_t from p where back <= 4 group by 1, 2""")
def stream_ring(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest of the last four rows of the other side."""
    return _fold(spark, folder, steps.nearest_in_ring(4), "left_t long, right_t long")


def _queue_sql(full: str) -> str:
    return f"""{_NUMBERED},
r as (select distinct user_id, 0::bigint as n, []::bigint[] as held, 0 as dropped, null::bigint as t, 0 as told from e union all
 select e.user_id, e.n, case when op = 'take' then held[2:] when len(held) < 3 then list_append(held, e.t) else {full} end, dropped + case when op = 'put' and len(held) >= 3 then 1 else 0 end,
  case when op = 'take' then held[1] end, dropped from r join e on e.user_id = r.user_id and e.n = r.n + 1)
select user_id, t, told as dropped from r where t is not null"""


@query(_queue_sql("held"))
def stream_queue_newest(spark: SparkSession, folder: str) -> DataFrame:
    """A queue of three from which the newest falls when it is full."""
    return _fold(spark, folder, steps.bounded_queue(3, "newest"), "t long, dropped int")


@query(_queue_sql("list_append(held[2:], e.t)"))
def stream_queue_oldest(spark: SparkSession, folder: str) -> DataFrame:
    """A queue of three from which the oldest falls when it is full."""
    return _fold(spark, folder, steps.bounded_queue(3, "oldest"), "t long, dropped int")


@query(f"""
with e as ({_EVENTS}), b as (select user_id, min(t) as first, max(t) as last from e group by 1), k as (select user_id, first + unnest(generate_series(1, (last - first) // 40)) * 40 as tick from b),
m as (select k.user_id, tick, e.t, e.v from k asof join e on k.user_id = e.user_id and k.tick > e.t)
select user_id, tick, v, row_number() over (partition by user_id, t order by tick) - 1 as sent from m""")
def stream_mailbox(spark: SparkSession, folder: str) -> DataFrame:
    """The latest value every forty ticks. Many times what is read comes out: files hold ticks and counts by their differences."""
    write_steps_small(spark, ["tick", "sent"])
    out = S.mailbox_table(_events(spark, folder), key="user_id", order="t", value="v", period=40)
    return out.withColumn("sent", F.col("sent").cast("int"))


@query(f"""{_NUMBERED},
r as (select distinct user_id, 0::bigint as n, null::bigint as last, null::bigint as t, null::double as v from e union all
 select e.user_id, e.n, case when abs(e.v) > 25 and (last is null or e.t - last >= 500) then e.t else last end, case when abs(e.v) > 25 and (last is null or e.t - last >= 500) then e.t end, e.v from r join e on e.user_id = r.user_id and e.n = r.n + 1)
select user_id, t, v from r where t is not null""")
def stream_drift_warning(spark: SparkSession, folder: str) -> DataFrame:
    """High values, told at most once in five hundred."""
    return _fold(spark, folder, steps.drift_warning(25.0, 500), "t long, v double")


@query(f"""{_NUMBERED},
r as (select user_id, n, t, exposure as e, gain as g, null::int as later, null::double as waiting, 0 as rest from e where n = 1 union all
 select e.user_id, e.n, e.t,
  case when later = 0 and rest = 1 then waiting when later is not null then r.e when abs(exposure - r.e) > 1e-4 and abs(gain - r.g) > 1e-3 then case when exposure < r.e then exposure else r.e end else exposure end,
  case when later = 1 and rest = 1 then waiting when later is not null then r.g when abs(exposure - r.e) > 1e-4 and abs(gain - r.g) > 1e-3 then case when exposure < r.e then r.g else gain end else gain end,
  case when later is not null then case when rest > 1 then later end when abs(exposure - r.e) > 1e-4 and abs(gain - r.g) > 1e-3 then case when exposure < r.e then 1 else 0 end end,
  case when later is not null then waiting when exposure < r.e then gain else exposure end,
  case when later is not null then rest - 1 else 2 end from r join e on e.user_id = r.user_id and e.n = r.n + 1)
select user_id, t, e as exposure, g as gain from r""")
def stream_deferred_write(spark: SparkSession, folder: str) -> DataFrame:
    """Settings in effect when the brighter half of a pair waits two rows."""
    return _fold(spark, folder, steps.deferred_write(2), "t long, exposure double, gain double")


@query("""
select user_id, ts, arg_min(ts2, (abs(epoch_us(ts2) - epoch_us(ts)), ts2)) as right_time from (select l.user_id, l.ts, r.ts as ts2 from (select distinct user_id, ts from events where event_id % 2 = 0) l
 join (select user_id, ts from events where event_id % 2 = 1) r on l.user_id = r.user_id and abs(epoch_us(r.ts) - epoch_us(l.ts)) <= 21600000000) group by 1, 2""")
def stream_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Each even event's nearest odd one of its user within six hours."""
    ev = table(spark, folder, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 2).alias("side"))
    out = S.paired_in_time(ev.where("side = 0"), ev.where("side = 1"), key="user_id", time="ts", tolerance="6 hours", watermark="1 day")
    return out.select("user_id", F.col("left_time").cast("timestamp_ntz").alias("ts"), F.col("right_time").cast("timestamp_ntz").alias("right_time"))


@query("select recording_id, frame from (select distinct recording_id, frame, t_left_us from sync_log) s join recordings using (recording_id) where t_left_us <= end_time_us - start_time_us + 1000000")
def stream_without_stale(spark: SparkSession, folder: str) -> DataFrame:
    """Frames whose camera time isn't ahead of all the time their recording took."""
    log = table(spark, folder, "sync_log").select("recording_id", "frame", "t_left_us").dropDuplicates(["recording_id", "frame"])
    rows = log.join(table(spark, folder, "recordings").select("recording_id", "start_time_us", "end_time_us"), "recording_id")
    return S.without_stale(rows, time_us=F.col("t_left_us"), elapsed_us=F.col("end_time_us") - F.col("start_time_us")).select("recording_id", "frame")


@query("select event_id::varchar as key, '{\"sequence\":' || event_id || ',\"rig_sha256\":\"' || sha256('rig ' || user_id) || '\",\"user_id\":' || user_id || '}' as value from events")
def stream_packets(spark: SparkSession, folder: str) -> DataFrame:
    """Messages with number and hash of the sender's description."""
    ev = table(spark, folder, "events").select("event_id", "user_id")
    return S.packets(ev, header=["user_id"], number="event_id", rig=F.concat(F.lit("rig "), F.col("user_id").cast("string")))
