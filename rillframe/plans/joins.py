"""Queries that join on time, ranges and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillframe.operators import asof as A
from rillframe.operators.folds import match_pairs
from rillframe.operators.graphs import best_steps, between_nodes, first_by_priority
from rillframe.operators.spatial import block_pairs, radius_pairs, vote_density
from rillframe.plans.clock import HOST_SQL, host_frames
from rillframe.plans.registry import Registry
from rillframe.sources.tables import table

query = Registry()

TRIGGERS_SQL = "select distinct trigger_id, recording_id, phrase, role, text, start_us, end_us, min_probability from triggers"
IMU_SQL = "select distinct recording_id, sample, host_time_us, ax_g, ay_g, az_g, gx_rad_s, gy_rad_s, gz_rad_s from imu_log where host_time_us is not null"


def triggers(spark: SparkSession, folder: str) -> DataFrame:
    """Triggers, once each."""
    cols = ["trigger_id", "recording_id", "phrase", "role", "text", "start_us", "end_us", "min_probability"]
    return table(spark, folder, "triggers").select(*cols).dropDuplicates(["trigger_id"])


def imu(spark: SparkSession, folder: str) -> DataFrame:
    """Logged readings with a time, once each."""
    cols = ["recording_id", "sample", "host_time_us", "ax_g", "ay_g", "az_g", "gx_rad_s", "gy_rad_s", "gz_rad_s"]
    return table(spark, folder, "imu_log").select(*cols).where("host_time_us is not null").dropDuplicates(["recording_id", "sample"])


def _asof(spark: SparkSession, folder: str, direction: str) -> DataFrame:
    left = triggers(spark, folder).select("recording_id", "trigger_id", "start_us")
    rows = A.asof(left, host_frames(spark, folder), by=["recording_id"], left_time="start_us", right_time="host_us", take=["frame"], direction=direction)
    return rows.select("trigger_id", F.col("match.frame").alias("frame"))


FIRST_SQL = f"(select recording_id, host_us, min(frame) as frame from ({HOST_SQL}) group by all)"


@query(f"select trigger_id, h.frame from ({TRIGGERS_SQL}) t asof left join {FIRST_SQL} h on t.recording_id = h.recording_id and t.start_us >= h.host_us")
def asof_backward(spark: SparkSession, folder: str) -> DataFrame:
    """The last frame at or before each trigger."""
    return _asof(spark, folder, "backward")


@query(f"select trigger_id, h.frame from ({TRIGGERS_SQL}) t asof left join {FIRST_SQL} h on t.recording_id = h.recording_id and t.start_us <= h.host_us")
def asof_forward(spark: SparkSession, folder: str) -> DataFrame:
    """The first frame at or after each trigger."""
    return _asof(spark, folder, "forward")


NEAREST_SQL = f"""
with t as ({TRIGGERS_SQL}), h as (select * from {FIRST_SQL}),
b as (select trigger_id, h.frame, start_us - h.host_us as d from t asof left join h on t.recording_id = h.recording_id and t.start_us >= h.host_us),
f as (select trigger_id, h.frame, h.host_us - start_us as d from t asof left join h on t.recording_id = h.recording_id and t.start_us <= h.host_us)
select trigger_id, case when b.d is null or f.d < b.d then f.frame else b.frame end as frame from b join f using (trigger_id)"""


@query(NEAREST_SQL)
def asof_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The frame nearest to each trigger, the earlier of two equally near."""
    return _asof(spark, folder, "nearest")


@query(f"""
with t as ({TRIGGERS_SQL}), h as (select * from {FIRST_SQL}), l as (select recording_id, arg_max(frame, host_us) as frame from h group by 1)
select trigger_id, coalesce(f.frame, l.frame) as frame from (select trigger_id, t.recording_id, h.frame from t asof left join h on t.recording_id = h.recording_id and t.start_us <= h.host_us) f left join l using (recording_id)""")
def at_or_next_else_last(spark: SparkSession, folder: str) -> DataFrame:
    """The frame at a trigger's time, else the next, else the last."""
    left = triggers(spark, folder).select("recording_id", "trigger_id", "start_us")
    rows = A.at_or_after_else_last(left, host_frames(spark, folder), by=["recording_id"], left_time="start_us", right_time="host_us", take=["frame"])
    return rows.select("trigger_id", F.col("match.frame").alias("frame"))


IMU_ONE = f"(select recording_id, host_time_us, min(struct_pack(g := gx_rad_s)).g as g from ({IMU_SQL}) where gx_rad_s is not null group by all)"


@query(f"""
with t as (select recording_id, frame, host_us from ({HOST_SQL})), i as (select * from {IMU_ONE}),
b as (select t.*, i.host_time_us as bt, i.g as bg from t asof left join i on t.recording_id = i.recording_id and t.host_us >= i.host_time_us),
f as (select b.*, i.host_time_us as ft, i.g as fg from b asof left join i on b.recording_id = i.recording_id and b.host_us <= i.host_time_us)
select recording_id, frame, round(case when ft is null then bg when bt is null then fg when ft > bt then bg + (host_us - bt)::double / (ft - bt) * (fg - bg) else bg end, 6) as gx from f""")
def interp_join(spark: SparkSession, folder: str) -> DataFrame:
    """Angular rate at each frame, between the readings around it."""
    gyro = imu(spark, folder).where("gx_rad_s is not null").select("recording_id", "host_time_us", F.col("gx_rad_s").alias("gx"))
    left = host_frames(spark, folder).select("recording_id", "frame", "host_us")
    rows = A.interpolate(left, gyro, by=["recording_id"], left_time="host_us", right_time="host_time_us", values=["gx"])
    return rows.select("recording_id", "frame", F.round("gx", 6).alias("gx"))


@query(f"""
with t as (select recording_id, frame, host_us from ({HOST_SQL}) where host_us is not null)
select t.recording_id, t.frame, count(ax_g) as n, round(avg(ax_g), 6) as ax from t left join (select * from ({IMU_SQL}) where ax_g is not null) i
on i.recording_id = t.recording_id and i.host_time_us between t.host_us - 20000 and t.host_us + 20000 group by all""")
def interval_mean(spark: SparkSession, folder: str) -> DataFrame:
    """Mean acceleration within 20 ms of each frame."""
    left = host_frames(spark, folder).select("recording_id", "frame", "host_us")
    right = imu(spark, folder).select("recording_id", "host_time_us", "ax_g")
    rows = A.interval_window(left, right, by=["recording_id"], left_time="host_us", right_time="host_time_us", half=20_000, aggs={"n": F.count("ax_g"), "ax": F.avg("ax_g")})
    return rows.select("recording_id", "frame", "n", F.round("ax", 6).alias("ax"))


@query(f"""
with c as (select distinct chunk_id, recording_id, start_time_us, end_time_us from chunks where end_time_us >= start_time_us)
select chunk_id, count(*) as n, min(host_time_us) as first_us, max(host_time_us) as last_us from ({IMU_SQL}) i join c using (recording_id) where host_time_us between start_time_us and end_time_us group by chunk_id""")
def range_slice(spark: SparkSession, folder: str) -> DataFrame:
    """How many readings each chunk holds, the first and the last."""
    c = table(spark, folder, "chunks").select("chunk_id", "recording_id", "start_time_us", "end_time_us").dropDuplicates(["chunk_id"])
    rows = A.range_join(imu(spark, folder).select("recording_id", "host_time_us"), c, by=["recording_id"], time="host_time_us", start="start_time_us", end="end_time_us", take=["chunk_id"])
    return rows.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.min("host_time_us").alias("first_us"), F.max("host_time_us").alias("last_us"))


@query("""
with recursive log as (select distinct recording_id, frame, t_left_us, t_right_us from sync_log),
l as (select recording_id, t_left_us as t, row_number() over (partition by recording_id order by t_left_us) as k from log where t_left_us is not null),
r as (select recording_id, t_right_us as t, row_number() over (partition by recording_id order by t_right_us) as k from log where t_right_us is not null),
m as (select distinct recording_id, 1::bigint as i, 1::bigint as j, null::bigint as a, null::bigint as b from l union all
 select m.recording_id, i + case when l.t - r.t <= 12500 then 1 else 0 end, j + case when r.t - l.t <= 12500 then 1 else 0 end,
  case when abs(l.t - r.t) <= 12500 then l.t end, case when abs(l.t - r.t) <= 12500 then r.t end from m join l on l.recording_id = m.recording_id and l.k = i join r on r.recording_id = m.recording_id and r.k = j)
select recording_id, a as left_time, b as right_time from m where a is not null""")
def greedy_match(spark: SparkSession, folder: str) -> DataFrame:
    """Left and right frame times paired one to one within half a period."""
    log = table(spark, folder, "sync_log").select("recording_id", "frame", "t_left_us", "t_right_us").dropDuplicates(["recording_id", "frame"])
    left, right = (log.select("recording_id", F.col(c).alias("t")) for c in ("t_left_us", "t_right_us"))
    return match_pairs(left, right, by=["recording_id"], time="t", window=12_500)


@query("select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_acctbal < 0)")
def semi_join(spark: SparkSession, folder: str) -> DataFrame:
    """Orders of customers in debt."""
    poor = table(spark, folder, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, folder, "orders").select("o_orderkey", "o_custkey").join(poor, "o_custkey", "left_semi")


@query("select recording_id from recordings where recording_id not in (select recording_id from sync_log)")
def anti_missing(spark: SparkSession, folder: str) -> DataFrame:
    """Recordings without a frame log."""
    return table(spark, folder, "recordings").select("recording_id").join(table(spark, folder, "sync_log").select("recording_id"), "recording_id", "left_anti")


@query("select c_custkey as key from customer except select o_custkey from orders")
def except_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Customers without orders."""
    return table(spark, folder, "customer").select(F.col("c_custkey").alias("key")).subtract(table(spark, folder, "orders").select("o_custkey"))


@query("select recording_id from imu_log intersect select recording_id from sync_log")
def intersect_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Recordings with both frames and readings."""
    return table(spark, folder, "imu_log").select("recording_id").intersect(table(spark, folder, "sync_log").select("recording_id"))


@query("""
select recording_id, 'window' as kind, window_id as id, label, null::varchar as name from (select distinct window_id, recording_id, label from windows)
union all select recording_id, 'chunk', chunk_id, null, name from (select distinct chunk_id, recording_id, name from chunks)""")
def union_roles(spark: SparkSession, folder: str) -> DataFrame:
    """Windows and chunks in one table, each with its own columns."""
    w = table(spark, folder, "windows").select("recording_id", F.lit("window").alias("kind"), F.col("window_id").alias("id"), "label").dropDuplicates(["id"])
    c = table(spark, folder, "chunks").select("recording_id", F.lit("chunk").alias("kind"), F.col("chunk_id").alias("id"), "name").dropDuplicates(["id"])
    return w.unionByName(c, allowMissingColumns=True)


@query("""
with c as (select distinct calib_id, serial, serial_left, serial_right, rms_px, saved_at from calibrations),
one as (select serial, arg_max(rms_px, (saved_at, calib_id)) as rms_px from c where serial is not null and rms_px is not null group by serial)
select c.calib_id, round(l.rms_px, 6) as left_px, round(r.rms_px, 6) as right_px from c left join one l on l.serial = c.serial_left left join one r on r.serial = c.serial_right where c.serial_left is not null""")
def calibration_bundle(spark: SparkSession, folder: str) -> DataFrame:
    """Each pair with the latest single calibration of its two cameras."""
    c = table(spark, folder, "calibrations").select("calib_id", "serial", "serial_left", "serial_right", "rms_px", "saved_at").dropDuplicates(["calib_id"])
    one = c.where("serial is not null and rms_px is not null").groupBy("serial").agg(F.max_by("rms_px", F.struct("saved_at", "calib_id")).alias("px"))
    pairs = c.where("serial_left is not null").select("calib_id", "serial_left", "serial_right")
    for side in ("left", "right"):
        pairs = pairs.join(one.select(F.col("serial").alias(f"serial_{side}"), F.round("px", 6).alias(f"{side}_px")), f"serial_{side}", "left")
    return pairs.select("calib_id", "left_px", "right_px")


@query("""
with q as (select vec_id, embedding from embeddings where vec_id % 100 = 0)
select q.vec_id as query, p.vec_id as point, round(d, 5) as distance from (
  select q.vec_id as qi, p.vec_id as pi, sqrt(list_sum(list_transform(list_zip(q.embedding, p.embedding), lambda x: (x[1]::double - x[2]::double) * (x[1]::double - x[2]::double)))) as d from q, embeddings p where q.vec_id <> p.vec_id) x
join q on q.vec_id = qi join embeddings p on p.vec_id = pi where d <= 1.3""")
def proximity_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors near to those whose id is divisible by 100."""
    e = table(spark, folder, "embeddings")
    out = block_pairs(e, e.where("vec_id % 100 = 0"), point_id="vec_id", query_id="vec_id", vector="embedding", radius=1.3)
    return out.withColumn("distance", F.round("distance", 5))


VOTES_SQL = """
with c as (select l_returnflag, l_partkey as a, l_suppkey as b, count(*) as n from lineitem group by all)
select x.l_returnflag, x.a, x.b, sum(y.n)::bigint as n_votes, min(y.a) as min_a, max(y.a) as max_a, min(y.b) as min_b, max(y.b) as max_b
from c x join c y on x.l_returnflag = y.l_returnflag and y.a between x.a - 3 and x.a + 3 and y.b between x.b - 3 and x.b + 3 group by x.l_returnflag, x.a, x.b having sum(y.n) >= 8"""


@query(VOTES_SQL)
def vote_density_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of part and supplier with many line items around."""
    li = table(spark, folder, "lineitem").select("l_returnflag", F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    return vote_density(li, by=["l_returnflag"], a="a", b="b", radius=3, least=8)


@query(f"""
with recursive c as ({VOTES_SQL}),
r as (select distinct l_returnflag, 0 as place, null::bigint as a, null::bigint as b, []::struct(a bigint, b bigint)[] as kept from c union all
 select l_returnflag, place + 1, a, b, list_append(kept, {{'a': a, 'b': b}}) from (
  select r.l_returnflag, r.place, r.kept, c.a, c.b, row_number() over (partition by r.l_returnflag order by c.n_votes desc, c.a, c.b) as k from r join c on c.l_returnflag = r.l_returnflag and r.place < 20
  where len(list_filter(r.kept, lambda x: abs(x.a - c.a) <= 10 or abs(x.b - c.b) <= 10)) = 0) where k = 1)
select l_returnflag, place, a, b from r where place > 0""")
def nms_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty strongest cells, none near another."""
    from rillframe.operators.folds import suppress_peaks

    cells = vote_density_cells(spark, folder)
    return suppress_peaks(cells, by=["l_returnflag"], a="a", b="b", rank=[-F.col("n_votes"), F.col("a"), F.col("b")], radius=10, most=20)


@query("""
select l_orderkey, l_linenumber, l_extendedprice from (select l_orderkey, l_linenumber, l_extendedprice, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber) as n from lineitem) where n = 1""")
def argmax_group(spark: SparkSession, folder: str) -> DataFrame:
    """The dearest line of each order, the first of equal ones."""
    from rillframe.operators.stats import argmax_rows

    li = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return argmax_rows(li, by=["l_orderkey"], measure=F.col("l_extendedprice"), position=["l_linenumber"])


@query("""
with l as (select l_partkey, l_returnflag, max(l_extendedprice) as p from lineitem group by all)
select a.l_partkey, a.p as left_price, b.p as right_price from l a join l b on a.l_partkey = b.l_partkey and a.l_returnflag = 'A' and b.l_returnflag = 'R'""")
def eye_self_join(spark: SparkSession, folder: str) -> DataFrame:
    """Two sides of the same key, side by side."""
    best = table(spark, folder, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.max("l_extendedprice").alias("p"))
    left = best.where("l_returnflag = 'A'").select("l_partkey", F.col("p").alias("left_price"))
    right = best.where("l_returnflag = 'R'").select("l_partkey", F.col("p").alias("right_price"))
    return left.join(right, "l_partkey")


EDGES_SQL = """
with f as (select distinct l_orderkey as k, l_linenumber as f from lineitem),
w as (select k, f, row_number() over w - 1 as i, count(*) over (partition by k) as n, lead(f) over w as nf from f window w as (partition by k order by f)),
m as (select *, n // 2 as mid, max(case when i = n // 2 then f end) over (partition by k) as mf from w)
select k as l_orderkey, f as a, nf as b, 'adjacent' as edge from m where nf is not null
union all select k, least(f, mf), greatest(f, mf), 'anchor' from m where abs(i - mid) > 1"""


@query(EDGES_SQL)
def window_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges between neighbouring lines of an order and from its middle line."""
    from rillframe.operators.sequence import track_edges

    return track_edges(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber"), by=["l_orderkey"], frame="l_linenumber")


@query("""
with p as (select label, vec_id, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z from embeddings)
select label, a.vec_id as a, b.vec_id as b, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)), 6) as distance
from p a join p b using (label) where a.vec_id < b.vec_id and sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) <= 0.1 and b.vec_id - a.vec_id >= 20""")
def near_centers(spark: SparkSession, folder: str) -> DataFrame:
    """Points of a label near each other in space but not in number."""
    e = F.col("embedding").cast("array<double>")
    p = table(spark, folder, "embeddings").select("label", "vec_id", *(e.getItem(k).alias(c) for k, c in enumerate("xyz")))
    near = radius_pairs(p, by=["label"], point_id="vec_id", coords=["x", "y", "z"], radius=0.1).where(F.col("b") - F.col("a") >= 20)
    return near.withColumn("distance", F.round("distance", 6))


@query("""
with e as (select l_suppkey % 5 as g, l_orderkey as a, l_orderkey + 1 as b, l_extendedprice as q, l_linenumber as pos from lineitem),
n as (select distinct o_orderkey as k from orders where o_orderstatus = 'O'), k as (select * from e where a in (select k from n) and b in (select k from n))
select g, a, b, q, pos from (select *, row_number() over (partition by g, a order by q desc, pos) as r from k) where r = 1""")
def best_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Between consecutive open orders the dearest line of each group of suppliers."""
    li = table(spark, folder, "lineitem")
    edges = li.select((F.col("l_suppkey") % 5).alias("g"), F.col("l_orderkey").alias("a"), (F.col("l_orderkey") + 1).alias("b"), F.col("l_extendedprice").alias("q"), F.col("l_linenumber").alias("pos"))
    nodes = table(spark, folder, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("k"))
    return best_steps(between_nodes(edges, nodes, by=[], a="a", b="b", node="k"), by=["g"], a="a", b="b", quality="q", position="pos")


@query("""
with w as (select distinct recording_id, start_us from windows where start_us is not null), c as (select distinct recording_id, start_time_us from chunks where start_time_us is not null),
u as (select recording_id, start_us as t, 'window' as origin, 0 as p from w union all select recording_id, start_time_us, 'chunk', 1 from c)
select recording_id, t, arg_min(origin, p) as origin from u group by recording_id, t""")
def priority_union(spark: SparkSession, folder: str) -> DataFrame:
    """Times at which something starts, once each; a window's start goes before a chunk's."""
    w = table(spark, folder, "windows").select("recording_id", F.col("start_us").alias("t"), F.lit("window").alias("origin")).where("t is not null")
    c = table(spark, folder, "chunks").select("recording_id", F.col("start_time_us").alias("t"), F.lit("chunk").alias("origin")).where("t is not null")
    return first_by_priority([w, c], ["recording_id", "t"])
