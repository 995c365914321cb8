"""Queries p2, p3, p5 and p6 over the standard tables."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillframe.operators.grid import regular_grid, seconds_to_us
from rillframe.operators.intervals import merge_intervals
from rillframe.operators.spikes import SpikeModel, flag_implausible
from rillframe.operators.units import LENGTH_NAMES, LENGTHS, SQUARE_NAMES, convert, parse_quantity, stated_in_text, unit_by_size, unit_of_name
from rillframe.plans.registry import Registry
from rillframe.sources.tables import table

query = Registry()

GRID_US = 100_000
GRID_CARRY_US = 500_000
MAX_G = 16.0
MAX_RAD_S = math.radians(2000.0)
FRAME_CLOCK = SpikeModel(clock=True, longest_spike=None, shortest_run=2)


P3_SQL = """
with v as (select recording_id, 'windows' as layer, coalesce(start_us, r.start_time_us) as s, coalesce(end_us, r.end_time_us) as e from windows left join recordings r using (recording_id)
 union all select recording_id, 'chunks', start_time_us, end_time_us from chunks),
x as (select *, max(e) over (partition by recording_id, layer order by s, e rows between unbounded preceding and 1 preceding) as pe from v where e >= s),
y as (select *, sum(case when pe is null or s > pe then 1 else 0 end) over (partition by recording_id, layer order by s, e rows unbounded preceding) as g from x),
p as (select recording_id, layer, g, min(s) as s, max(e) as e from y group by all)
select recording_id, layer, 'period' as kind, s as start_us, e as end_us from p
union all select * from (select recording_id, layer, 'gap', e, lead(s) over (partition by recording_id, layer order by s) as n from p) where n is not null"""

P6_GRID_SQL = """
with r as (select distinct stream_id, sample, host_time_s, gx, ax from imu_sample where host_time_s is not null),
s as (select stream_id, floor(floor(host_time_s * 1e6) / 100000)::bigint as slot, gx, ax, ax is not null and not isnan(ax) and gx is not null and not isnan(gx) as ok from r),
a as (select stream_id, slot, count(case when ok then 1 end) as n, avg(case when ok then gx end) as gx, avg(case when ok then ax end) as ax from s group by 1, 2),
g as (select stream_id, unnest(range(min(slot), max(slot) + 1)) as slot from s group by 1),
j as (select g.stream_id, g.slot, coalesce(n, 0) as n, max(case when n > 0 then g.slot end) over (partition by g.stream_id order by g.slot rows unbounded preceding) as last from g left join a on a.stream_id = g.stream_id and a.slot = g.slot)
select j.stream_id, j.slot, case when j.n > 0 then 'observed' when j.slot - last <= 5 then 'filled' else 'missing' end as status, j.n, round(b.gx, 9) as gx, round(b.ax, 9) as ax
from j left join a b on b.stream_id = j.stream_id and b.slot = j.last and j.slot - j.last <= 5"""

P6_SQL = """
with r as (select stream_id, floor(floor(host_time_s * 1e6) / 100000)::bigint as slot, ax is not null and not isnan(ax) and gx is not null and not isnan(gx) as ok from imu_sample where host_time_s is not null),
g as (select stream_id, unnest(range(min(slot), max(slot) + 1)) as slot from r group by 1)
select stream_id, slot from g where not exists (select 1 from r where r.stream_id = g.stream_id and r.slot = g.slot and ok)"""


def _p5_values(field: str, bound: str) -> str:
    """The rule for values by medians of five on either side, without a model."""
    return f"""
select 'imu_sample' as table_name, source_id, seq, '{field}' as field from (
 with v as (select distinct stream_id as source_id, sample as seq, {field} as v from imu_sample where {field} is not null and not isnan({field})),
 m as (select *, median(v) over (w rows between 5 preceding and 1 preceding) as b, median(v) over (w rows between 1 following and 5 following) as a, lag(v) over (w) as p from v window w as (partition by source_id order by seq)),
 z as (select *, median(abs(v - (b + a) / 2)) over (partition by source_id) / 0.6745 as scale, case when b is null then abs(v - a) when a is null then abs(v - b) when sign(v - b) = sign(v - a) then least(abs(v - b), abs(v - a)) else 0 end as d,
  sum(case when v = p then 0 else 1 end) over (partition by source_id order by seq) as same from m),
 s as (select *, abs(v) <= {bound} and d > 10 * scale as far, row_number() over (partition by source_id order by seq) as n from z),
 t as (select *, count(*) over (partition by source_id, same) as run, sum(case when far then 0 else 1 end) over (partition by source_id order by seq) as calm from s),
 u as (select *, sum(case when far then 1 else 0 end) over (partition by source_id, calm) as far_run from t)
 select source_id, seq from u where abs(v) > {bound} or (far and far_run <= 2) or (v = p and run >= 10))"""


P5_SQL = f"""
{_p5_values("ax", "16")} union all {_p5_values("gz", "radians(2000)")} union all
select 'sync_log', source_id, seq, 't_left_us' from (
 with v as (select distinct recording_id as source_id, frame as seq, t_left_us as t from sync_log where t_left_us is not null),
 d as (select *, lag(t) over (w) as p, seq - lag(seq) over (w) as df from v window w as (partition by source_id order by seq)),
 r as (select *, t / median(case when df = 1 and t > p then t - p end) over (partition by source_id) - seq as r from d),
 m as (select *, median(r) over (w rows between 5 preceding and 1 preceding) as b, median(r) over (w rows between 1 following and 5 following) as a from r window w as (partition by source_id order by seq))
 select source_id, seq from m where t = p or case when b is null then r - a when a is null then abs(r - b) else least(abs(r - b), abs(r - a)) end > 2)"""


def bounded_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Windows with open bounds replaced by the start and end of their recording."""
    rec = table(spark, folder, "recordings").groupBy("recording_id").agg(F.min("start_time_us").alias("rec_start"), F.max("end_time_us").alias("rec_end"))
    win = table(spark, folder, "windows").select("recording_id", "start_us", "end_us").join(rec, "recording_id", "left")
    return win.select("recording_id", F.lit("windows").alias("layer"), F.coalesce("start_us", "rec_start").alias("start_us"), F.coalesce("end_us", "rec_end").alias("end_us"))


@query(P3_SQL)
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Merged periods of windows and chunks per recording, and the gaps between them."""
    chunks = table(spark, folder, "chunks").select("recording_id", F.lit("chunks").alias("layer"), F.col("start_time_us").alias("start_us"), F.col("end_time_us").alias("end_us"))
    rows = bounded_windows(spark, folder).unionByName(chunks)
    out = merge_intervals(rows, entity=["recording_id", "layer"], start="start_us", end="end_us")
    return out.select("recording_id", "layer", "kind", F.col("start").alias("start_us"), F.col("end").alias("end_us"))


@query(P6_GRID_SQL)
def p6_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Every stream's gx and ax per 100 ms of host time; repeated deliveries count once."""
    rows = table(spark, folder, "imu_sample").select("stream_id", "sample", "host_time_s", "gx", "ax").dropDuplicates(["stream_id", "sample"])
    grid = regular_grid(rows, entity=["stream_id"], time_us=seconds_to_us(F.col("host_time_s")), values=["gx", "ax"], width_us=GRID_US, max_gap_us=GRID_CARRY_US)
    return grid.withColumns({"gx": F.round("gx", 9), "ax": F.round("ax", 9)})


@query(P6_SQL)
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Slots without a complete reading, filled or not."""
    rows = table(spark, folder, "imu_sample").select("stream_id", "host_time_s", "gx", "ax")
    grid = regular_grid(rows, entity=["stream_id"], time_us=seconds_to_us(F.col("host_time_s")), values=["gx", "ax"], width_us=GRID_US, max_gap_us=GRID_CARRY_US)
    return grid.where(F.col("status") != "observed").select("stream_id", "slot")


@query(P5_SQL)
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Implausible ax and gz readings per stream, and frame times per recording."""
    imu = flag_implausible(table(spark, folder, "imu_sample"), source="stream_id", seq="sample", bounds={"ax": MAX_G, "gz": MAX_RAD_S})
    frames = flag_implausible(table(spark, folder, "sync_log"), source="recording_id", seq="frame", bounds={"t_left_us": float("inf")}, model=FRAME_CLOCK)
    rows = imu.withColumn("table_name", F.lit("imu_sample")).unionByName(frames.withColumn("table_name", F.lit("sync_log")))
    return rows.select("table_name", F.col("source").alias("source_id"), "seq", "field")


# True sizes in millimetres, and what a note speaks of.
SQUARE_MM = (20.0, 60.0)
BASELINE_MM = (50.0, 90.0)
BY_SIZE = ("m", "mm", "cm", "um", "in")
ABOUT_T = r"(?<!\p{L})t(?!\p{L})|translation|extrinsics|offset between eyes,"
ABOUT_SQUARE = r"square size|squares|feldgröße"


def _named(units: Mapping[str, Sequence[str]]) -> str:
    """Rows of unit and name for SQL."""
    return ", ".join(f"('{u}', '{n}')" for u, names in units.items() for n in names)


_NAMES = "|".join(sorted((n for names in {**LENGTH_NAMES, **SQUARE_NAMES}.values() for n in names), key=lambda n: -len(n)))
_LENGTHS = "|".join(sorted((n for names in LENGTH_NAMES.values() for n in names), key=lambda n: -len(n)))
_BY_SIZE = "case when {x} * 1000 between {a} and {b} then 'm' when {x} between {a} and {b} then 'mm' when {x} * 10 between {a} and {b} then 'cm' when {x} / 1000 between {a} and {b} then 'um' when {x} * 25.4 between {a} and {b} then 'in' end"
_IN_MM = "case {u} when 'm' then 1000 when 'mm' then 1 when 'cm' then 10 when 'um' then 0.001 when 'in' then 25.4 end"

_P2 = f"""
with names(unit, name) as (values {_named({**LENGTH_NAMES, **SQUARE_NAMES})}),
c as (select distinct on (calib_id) calib_id, convention, t, baseline, case when json_valid(notes) then notes::json end as j from calibrations),
f as (select *, json_extract_string(j, '$.board.square_mm') as sq, coalesce(json_extract_string(j, '$.note'), '') as note from c),
v as (select *, case when regexp_matches(sq, '^\\s*(\\d+\\s+)?\\d+\\s*/') then coalesce(try_cast(regexp_extract(sq, '^\\s*(\\d+)\\s+\\d', 1) as double), 0) + try_cast(regexp_extract(sq, '(\\d+)\\s*/', 1) as double) / try_cast(regexp_extract(sq, '/\\s*(\\d+)', 1) as double)
  else try_cast(replace(regexp_extract(sq, '^\\s*([0-9.,]+)', 1), ',', '.') as double) end as x,
  lower(trim(regexp_extract(sq, '[0-9.,/]\\s*([^0-9.,/\\s].*)$', 1))) as own,
  lower(json_extract_string(j, '$.board.unit')) as board, lower(regexp_extract(note, '(?i)(?:square size|squares|feldgröße)[^.;,\\d]*?[^\\p{{L}}]({_LENGTHS})\\s*(?:$|[,.;])', 1)) as told,
  lower(regexp_extract(convention, '\\(t in (.*)\\)', 1)) as conv, lower(coalesce(json_extract_string(j, '$.translation_units'), json_extract_string(j, '$.t_unit'))) as key,
  lower(regexp_extract(note, '(?i)(?:(?:^|[^\\p{{L}}])t[^\\p{{L}}]|translation|extrinsics|offset between eyes,)(?:[^.;,\\d]*?[^\\p{{L}}])??({_NAMES})\\s*(?:$|[,.;])', 1)) as said,
  coalesce(baseline, sqrt(list_sum([e * e for e in t if e is not null]))) as len from f),
s as (select *, case when x is not null then coalesce((select any_value(unit) from names where name = own and unit <> 'square'), (select any_value(unit) from names where name = board and unit <> 'square'), (select any_value(unit) from names where name = told and unit <> 'square'), {_BY_SIZE.format(x="x", a=SQUARE_MM[0], b=SQUARE_MM[1])}) end as su from v),
w as (select *, x * {_IN_MM.format(u="su")} as mm from s),
u as (select *, case when len(t) > 0 then coalesce((select any_value(unit) from names where name = conv), (select any_value(unit) from names where name = key), (select any_value(unit) from names where name = said), {_BY_SIZE.format(x="len", a=BASELINE_MM[0], b=BASELINE_MM[1])}, case when len * mm between {BASELINE_MM[0]} and {BASELINE_MM[1]} then 'square' end) end as tu from w)
"""

P2_SQL = f"""{_P2}
select calib_id, 't' as field, tu as unit from u where tu <> 'm' union all select calib_id, 'square_mm', su from u where su <> 'mm'"""

P2_UNITS_SQL = f"""{_P2}
select calib_id, 'square_mm' as field, 0 as place, su as unit, round(mm, 9) as value from u where x is not null
union all select calib_id, 't', e.place, tu, round(e.v * case tu when 'square' then mm * 0.001 when 'm' then 1 when 'mm' then 0.001 when 'cm' then 0.01 when 'um' then 0.000001 when 'in' then 0.0254 end, 9)
from (select *, unnest(list_transform(list_zip(t, range(len(t))), lambda z: {{'v': z[1], 'place': z[2]::int}})) as e from u)"""


def calibrations_in_common_units(spark: SparkSession, folder: str) -> DataFrame:
    """Every calibration's t in metres and square size in millimetres, the units they came in, and whether these are the common ones.

    Repeated rows of a calibration count once. Where no unit is stated and none fits the size, unit and
    result are null. Broken JSON states nothing beyond what can be read of it.
    """
    rows = table(spark, folder, "calibrations").select("calib_id", "convention", "t", "baseline", "notes").dropDuplicates(["calib_id"])
    field = lambda path: F.get_json_object("notes", path)
    text = F.coalesce(field("$.note"), F.lit(""))
    number, own_unit = parse_quantity(field("$.board.square_mm"), LENGTH_NAMES)
    rows = rows.withColumns({"square": number, "__own": own_unit})
    stated = F.coalesce("__own", unit_of_name(field("$.board.unit"), LENGTH_NAMES), stated_in_text(text, ABOUT_SQUARE, LENGTH_NAMES))
    rows = rows.withColumn("square_unit", F.when(F.col("square").isNotNull(), F.coalesce(stated, unit_by_size(F.col("square"), *SQUARE_MM, "mm", BY_SIZE, LENGTHS)))).drop("__own")
    rows = convert(rows, value="square", unit="square_unit", target="mm", out="square_mm", edges=LENGTHS, same="square_common")

    any_unit = {**LENGTH_NAMES, **SQUARE_NAMES}
    length = F.coalesce("baseline", F.sqrt(F.aggregate(F.filter("t", lambda v: v.isNotNull()), F.lit(0.0), lambda acc, v: acc + v * v)))
    convention = unit_of_name(F.regexp_extract("convention", r"\(t in (.*)\)", 1), any_unit)
    stated_t = F.coalesce(convention, unit_of_name(field("$.translation_units"), any_unit), unit_of_name(field("$.t_unit"), any_unit), stated_in_text(text, ABOUT_T, any_unit))
    # A board's square is a unit of its own record: an edge to millimetres with the record's factor.
    board = {"square": ("mm", F.col("square_mm"))}
    rows = rows.withColumns({"length": length, "__square": F.lit("square")})
    rows = convert(rows, value="length", unit="__square", target="mm", out="__in_squares", edges=LENGTHS, own=board)
    by_size = F.coalesce(unit_by_size(F.col("length"), *BASELINE_MM, "mm", BY_SIZE, LENGTHS), F.when(F.col("__in_squares").between(*BASELINE_MM), F.lit("square")))
    rows = rows.withColumn("t_unit", F.when(F.col("t").isNotNull() & (F.size("t") > 0), F.coalesce(stated_t, by_size)))
    rows = convert(rows, value="t", unit="t_unit", target="m", out="t_m", edges=LENGTHS, own=board, same="t_common")
    return rows.select("calib_id", "t", "t_unit", "t_m", "t_common", "square", "square_unit", "square_mm", "square_common")


@query(P2_UNITS_SQL)
def p2_units(spark: SparkSession, folder: str) -> DataFrame:
    """The converted values, each place of t and the square size, with the unit they came in."""
    rows = calibrations_in_common_units(spark, folder)
    square = rows.where("square is not null").select("calib_id", F.lit("square_mm").alias("field"), F.lit(0).alias("place"), F.col("square_unit").alias("unit"), F.round("square_mm", 9).alias("value"))
    each = rows.select("calib_id", "t_unit", "t_m", F.posexplode("t").alias("place", "stored"))
    t = each.select("calib_id", F.lit("t").alias("field"), "place", F.col("t_unit").alias("unit"), F.round(F.get("t_m", F.col("place")), 9).alias("value"))
    return square.unionByName(t)


@query(P2_SQL)
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The fields that their conversion to the common unit changes, or which can't be converted, and the unit they are in."""
    rows = calibrations_in_common_units(spark, folder)
    each = F.array(*(F.struct(F.lit(name).alias("field"), F.when(~F.coalesce(common, F.lit(False)), F.col(unit)).alias("unit")) for name, unit, common in (("t", "t_unit", F.col("t_common")), ("square_mm", "square_unit", F.col("square_common")))))
    rows = rows.select("calib_id", F.explode(F.filter(each, lambda x: x["unit"].isNotNull())).alias("x"))
    return rows.select("calib_id", "x.field", "x.unit")
