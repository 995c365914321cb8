"""Queries on spoken commands, windows and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillframe.functions.scalars import tokens
from rillframe.operators import sequence
from rillframe.operators.folds import keep_spaced
from rillframe.operators.split import resolve_chunks
from rillframe.plans.clock import HOST_SQL, host_frames
from rillframe.plans.joins import TRIGGERS_SQL, triggers
from rillframe.plans.registry import Registry

query = Registry()

TOKENS_SQL = f"select trigger_id, recording_id, start_us, min_probability, list_filter(string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda t: t <> '') as ts from ({TRIGGERS_SQL}) where text is not null"


@query(f"select trigger_id, array_to_string(ts, ' ') as words, len(ts)::int as n from ({TOKENS_SQL})")
def normalize_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """What was said, in plain words."""
    rows = triggers(spark, folder).where("text is not null").select("trigger_id", tokens(F.col("text")).alias("ts"))
    return rows.select("trigger_id", F.array_join("ts", " ").alias("words"), F.size("ts").alias("n"))


WORDS_SQL = f"""
select recording_id, trigger_id, i, ts[i] as word, start_us + (i - 1) * 200000 as s, start_us + (i - 1) * 200000 + 150000 as e, min_probability as p
from (select *, unnest(range(1, len(ts) + 1)) as i from ({TOKENS_SQL}))"""


@query(f"""
with w as ({WORDS_SQL}), n as (select *, lead(word) over o as w2, lead(s) over o as s2, lead(e) over o as e2, lead(p) over o as p2 from w window o as (partition by recording_id order by s, trigger_id, i))
select recording_id, s as start_us, e2 as end_us, least(p, p2) as min_probability from n where word = 'split' and w2 = 'here' and s2 - e <= 300000 and least(p, p2) >= 0.5""")
def phrase_match(spark: SparkSession, folder: str) -> DataFrame:
    """Where two words are said one after the other."""
    rows = triggers(spark, folder).where("text is not null").select("recording_id", "trigger_id", "start_us", "min_probability", F.posexplode(tokens(F.col("text"))).alias("i", "word"))
    words = rows.select("recording_id", "trigger_id", "i", "word", (F.col("start_us") + F.col("i") * 200_000).alias("s"), (F.col("start_us") + F.col("i") * 200_000 + 150_000).alias("e"), F.col("min_probability").alias("p"))
    return sequence.phrase_matches(words, by=["recording_id"], order=["s", "trigger_id", "i"], token="word", start="s", end="e", probability="p", phrase=["split", "here"], min_probability=0.5, max_gap=300_000)


@query(f"""
with t as (select *, max(end_us) over (partition by recording_id order by start_us, trigger_id rows between unbounded preceding and 1 preceding) as reach from ({TRIGGERS_SQL})),
g as (select *, sum(case when start_us - reach < 1500000 then 0 else 1 end) over (partition by recording_id order by start_us, trigger_id rows unbounded preceding) as g from t)
select recording_id, arg_min(trigger_id, (start_us, trigger_id)) as first_event, count(*) as n, min(start_us) as start_us, max(end_us) as end_us from g group by recording_id, g""")
def burst_collapse(spark: SparkSession, folder: str) -> DataFrame:
    """Triggers that follow each other within 1.5 s, as one."""
    return sequence.burst_collapse(triggers(spark, folder), by=["recording_id"], start="start_us", end="end_us", event_id="trigger_id", gap=1_500_000)


@query(f"""
with recursive t as (select recording_id, trigger_id, start_us, end_us, row_number() over (partition by recording_id order by start_us, trigger_id) as n from ({TRIGGERS_SQL})),
k as (select recording_id, n, trigger_id, start_us, end_us, end_us as kept, true as ok from t where n = 1
      union all select t.recording_id, t.n, t.trigger_id, t.start_us, t.end_us, case when t.start_us - k.kept >= 4000000 then t.end_us else k.kept end, t.start_us - k.kept >= 4000000 from k join t on t.recording_id = k.recording_id and t.n = k.n + 1)
select recording_id, trigger_id, start_us, end_us from k where ok""")
def greedy_min_gap(spark: SparkSession, folder: str) -> DataFrame:
    """Triggers at least 4 s after the last one kept."""
    return keep_spaced(triggers(spark, folder), by=["recording_id"], start="start_us", end="end_us", event_id="trigger_id", span=4_000_000)


SPLIT_SQL = f"select * from ({TRIGGERS_SQL}) where role = 'split'"


@query(f"""
with w as (select recording_id, lag(end_us) over o as pe, start_us as s, end_us as e, lead(start_us) over o as ns from ({SPLIT_SQL}) window o as (partition by recording_id order by start_us, trigger_id))
select recording_id, e as start_us, ns as end_us from w union all select recording_id, null, s from w where pe is null""")
def delimiter_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Stretches between split commands, before the first and after the last."""
    return sequence.delimiter_windows(triggers(spark, folder).where("role = 'split'"), by=["recording_id"], start="start_us", end="end_us", event_id="trigger_id", head=True, tail=True)


PAIRED_SQL = f"""
select recording_id, pe as start_us, start_us as end_us from (
  select recording_id, role, start_us, lag(role) over o as pr, lag(end_us) over o as pe from ({TRIGGERS_SQL}) where role in ('start', 'stop')
  window o as (partition by recording_id order by start_us, case role when 'start' then 0 else 1 end, trigger_id)) where role = 'stop' and pr = 'start'"""


@query(PAIRED_SQL)
def paired_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Stretches from a start command to the stop that follows it."""
    return sequence.paired_windows(triggers(spark, folder), by=["recording_id"], role="role", start="start_us", end="end_us", event_id="trigger_id")


@query(f"""
with h as (select recording_id, frame, host_us from ({HOST_SQL})), f as (select recording_id, host_us, min(frame) as frame from h group by all),
k2 as (select recording_id, host_us, min(struct_pack(kf := x2.kf, kt := x2.kt)) as x from (select recording_id, host_us, struct_pack(kf := kf, kt := kt) as x2 from (
  select h.recording_id, h.host_us, n.frame as kf, n.host_us as kt from h asof left join (select * from h where frame % 12 = 0) n on h.recording_id = n.recording_id and h.frame <= n.frame)) group by 1, 2),
w as (select recording_id, start_us - 500000 as f, end_us + 500000 as t from ({PAIRED_SQL}) where recording_id in (select recording_id from h)),
s as (select w.*, k2.x.kf as start_frame, k2.x.kt as start_time_us from w asof left join k2 on w.recording_id = k2.recording_id and w.f <= k2.host_us),
e as (select s.*, f2.frame as end_frame, f2.host_us as end_time_us from s asof left join f f2 on s.recording_id = f2.recording_id and s.t >= f2.host_us),
r as (select *, row_number() over (partition by recording_id order by start_time_us, end_time_us, start_frame, end_frame) - 1 as chunk_index from e where end_frame >= start_frame and end_time_us - start_time_us >= 200000)
select recording_id, chunk_index, 'chunk_' || lpad(chunk_index::varchar, 3, '0') as name, start_frame, end_frame, start_time_us, end_time_us from r""")
def split_plan(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks that the start and stop commands of each recording cut it into."""
    frames = host_frames(spark, folder).select("recording_id", "frame", "host_us", (F.col("frame") % 12 == 0).alias("is_key"))
    windows = sequence.paired_windows(triggers(spark, folder), by=["recording_id"], role="role", start="start_us", end="end_us", event_id="trigger_id")
    return resolve_chunks(windows, frames, by=["recording_id"], start="start_us", end="end_us", frame="frame", time="host_us", keyframe="is_key", pad_us=500_000, min_duration_us=200_000)
