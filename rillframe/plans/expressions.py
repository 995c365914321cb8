"""Queries of rotations, cameras, pixels, arrays and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillframe.functions import camera, pixels, scalars
from rillframe.functions import geometry as G
from rillframe.plans.registry import Registry
from rillframe.sources.tables import table

query = Registry()

# Unit quaternions and vectors of the first seven numbers of each embedding.
UNIT_SQL = """
select vec_id, e[1]/n as w, e[2]/n as x, e[3]/n as y, e[4]/n as z, e[5] as vx, e[6] as vy, e[7] as vz from (
  select vec_id, e, sqrt(e[1]*e[1] + e[2]*e[2] + e[3]*e[3] + e[4]*e[4]) as n from (select vec_id, embedding::double[] as e from embeddings))"""
ROTATE = """vx + w * 2 * (y * vz - z * vy) + (y * 2 * (x * vy - y * vx) - z * 2 * (z * vx - x * vz)) as rx,
 vy + w * 2 * (z * vx - x * vz) + (z * 2 * (y * vz - z * vy) - x * 2 * (x * vy - y * vx)) as ry,
 vz + w * 2 * (x * vy - y * vx) + (x * 2 * (z * vx - x * vz) - y * 2 * (y * vz - z * vy)) as rz"""


def _poses(spark: SparkSession, folder: str) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    q = G.quat_normalize(G.quat(*(e.getItem(k) for k in range(4))))
    return table(spark, folder, "embeddings").select("vec_id", q.alias("q"), G.vec(*(e.getItem(k) for k in range(4, 7))).alias("v"))


def _xyz(v: Column, names: str = "xyz", digits: int = 6) -> list[Column]:
    return [F.round(v[c], digits).alias(n) for c, n in zip("xyz", names)]


@query(f"select vec_id, round(rx, 6) as x, round(ry, 6) as y, round(rz, 6) as z from (select vec_id, {ROTATE} from ({UNIT_SQL}))")
def quat_rotate(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors turned by quaternions."""
    return _poses(spark, folder).select("vec_id", G.quat_rotate(F.col("q"), F.col("v")).alias("r")).select("vec_id", *_xyz(F.col("r")))


@query(f"""
with u as ({UNIT_SQL}), p as (select a.vec_id, a.w, a.x, a.y, a.z, b.w as w2, b.x as x2, b.y as y2, b.z as z2, a.w*b.w + a.x*b.x + a.y*b.y + a.z*b.z as raw from u a join u b on b.vec_id = a.vec_id + 1),
t as (select *, case when raw < 0 then -1.0 else 1.0 end as s, acos(least(abs(raw), 1.0)) as th from p),
k as (select *, case when abs(raw) > 0.9995 then 0.7 else sin(0.7 * th) / sin(th) end as ka, s * case when abs(raw) > 0.9995 then 0.3 else sin(0.3 * th) / sin(th) end as kb from t),
m as (select vec_id, 2 * th as angle, ka*w + kb*w2 as mw, ka*x + kb*x2 as mx, ka*y + kb*y2 as my, ka*z + kb*z2 as mz from k),
n as (select *, sqrt(mw*mw + mx*mx + my*my + mz*mz) as l from m)
select vec_id, round(mw / l, 6) as w, round(mx / l, 6) as x, round(my / l, 6) as y, round(mz / l, 6) as z, round(angle, 6) as angle from n""")
def slerp(spark: SparkSession, folder: str) -> DataFrame:
    """Three tenths of the way between each rotation and the next, and the angle between them."""
    p = _poses(spark, folder).select("vec_id", "q")
    rows = p.join(p.select((F.col("vec_id") - 1).alias("vec_id"), F.col("q").alias("q2")), "vec_id")
    rows = rows.select("vec_id", G.slerp(F.col("q"), F.col("q2"), F.lit(0.3)).alias("m"), G.geodesic_angle(F.col("q"), F.col("q2")).alias("angle"))
    return rows.select("vec_id", *(F.round(F.col("m")[c], 6).alias(c) for c in "wxyz"), F.round("angle", 6).alias("angle"))


@query(f"""
with c as (select vec_id, w, -x as x, -y as y, -z as z, vx, vy, vz from ({UNIT_SQL}))
select vec_id, round(w, 6) as w, round(x, 6) as qx, round(y, 6) as qy, round(z, 6) as qz, round(-rx, 6) as x, round(-ry, 6) as y, round(-rz, 6) as z from (select *, {ROTATE} from c)""")
def pose_inverse(spark: SparkSession, folder: str) -> DataFrame:
    """Inverse poses."""
    rows = _poses(spark, folder).select("vec_id", G.pose_inverse(G.pose(F.col("q"), F.col("v"))).alias("p"))
    return rows.select("vec_id", *(F.round(F.col("p.q")[c], 6).alias(n) for c, n in zip("wxyz", ("w", "qx", "qy", "qz"))), *_xyz(F.col("p.t")))


@query(f"""
with u as ({UNIT_SQL})
select vec_id, round(1 - 2 * (y*y + z*z), 6) as m00, round(2 * (x*y - w*z), 6) as m01, round(2 * (x*z + w*y), 6) as m02, round(2 * (y*z + w*x), 6) as m21, round(case when w < 0 then -w else w end, 6) as w from u""")
def quat_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Rotation matrices, and the quaternion found again from them."""
    rows = _poses(spark, folder).select("vec_id", G.quat_to_matrix(F.col("q")).alias("m"))
    rows = rows.select("vec_id", "m", G.matrix_to_quat(F.col("m")).alias("q"))
    return rows.select("vec_id", *(F.round(F.col("m")[k], 6).alias(n) for k, n in ((0, "m00"), (1, "m01"), (2, "m02"), (7, "m21"))), F.round("q.w", 6).alias("w"))


K = (0.1, -0.01, 0.001, -0.0001)


@query(f"""
with p as (select vec_id, vx * 4 as x, vy * 4 as y, 1.0 as z from ({UNIT_SQL})), r as (select *, sqrt(x*x + y*y) as r from p), t as (select *, atan2(r, z) as t from r),
d as (select *, t * (1 + t*t * ({K[0]} + t*t * ({K[1]} + t*t * ({K[2]} + t*t * {K[3]})))) as d from t)
select vec_id, round(300 * (case when r > 1e-12 then d / r else 0 end) * x + 320, 4) as u, round(300 * (case when r > 1e-12 then d / r else 0 end) * y + 240, 4) as v, round(x / sqrt(x*x + y*y + z*z), 6) as gx, round(y / sqrt(x*x + y*y + z*z), 6) as gy, round(z / sqrt(x*x + y*y + z*z), 6) as gz from d""")
def fisheye_project(spark: SparkSession, folder: str) -> DataFrame:
    """Points to fisheye pixels and back to rays."""
    p = _poses(spark, folder).select("vec_id", G.vec(F.col("v.x") * 4, F.col("v.y") * 4, F.lit(1.0)).alias("p"))
    k, (fx, fy, cx, cy) = [F.lit(c) for c in K], [F.lit(c) for c in (300.0, 300.0, 320.0, 240.0)]
    rows = p.select("vec_id", camera.fisheye_project(F.col("p"), fx, fy, cx, cy, k).alias("px"))
    rows = rows.select("vec_id", "px", camera.fisheye_unproject(F.col("px.u"), F.col("px.v"), fx, fy, cx, cy, k).alias("g"))
    return rows.select("vec_id", F.round("px.u", 4).alias("u"), F.round("px.v", 4).alias("v"), *_xyz(F.col("g"), ("gx", "gy", "gz")))


@query("""
with b as (select o_orderkey, (o_orderkey >> 16) & 255 as b0, (o_orderkey >> 8) & 255 as b1, o_orderkey & 255 as b2 from orders)
select o_orderkey, ((b0 << 4) | (b1 & 15))::int as first, ((b2 << 4) | (b1 >> 4))::int as second from b""")
def bayer12_unpack(spark: SparkSession, folder: str) -> DataFrame:
    """Two 12-bit samples of every three bytes."""
    data = F.unhex(F.lpad(F.hex(F.col("o_orderkey").bitwiseAND(0xFFFFFF)), 6, "0"))
    rows = table(spark, folder, "orders").select("o_orderkey", pixels.unpack12(data).alias("s"))
    return rows.select("o_orderkey", F.col("s")[0].alias("first"), F.col("s")[1].alias("second"))


@query("""
with s as (select distinct ((l_orderkey * 37 + l_linenumber * 911) % 4096)::int as s from lineitem), x as (select s, least(greatest(s / 4095.0::double, 0.0), 1.0) as x from s)
select s, floor(pow(x, 1 / 2.2) * 255 + 0.5)::int as gamma, floor(ln(1 + 100 * x) / ln(101) * 255 + 0.5)::int as log, floor(x * 2 / (x + 1) * 255 + 0.5)::int as reinhard,
 floor((case when x < 0.018 then 4.5 * x else 1.099 * pow(x, 0.45) - 0.099 end) * 255 + 0.5)::int as bt709, least((s * 1843) >> 10, 4095)::int as balanced from x""")
def tone_curves(spark: SparkSession, folder: str) -> DataFrame:
    """Samples under the four tone curves, and white-balanced."""
    rows = table(spark, folder, "lineitem").select(((F.col("l_orderkey") * 37 + F.col("l_linenumber") * 911) % 4096).cast("int").alias("s")).distinct()
    s = F.col("s")
    return rows.select("s", *(pixels.tonemap(s, n).alias(n) for n in ("gamma", "log", "reinhard", "bt709")), pixels.white_balance(s, F.lit(1.8)).alias("balanced"))


@query("select vec_id, round(embedding[3]::double, 6) as a, round(embedding[1]::double, 6) as b, round(embedding[64]::double, 6) as c, embedding[65] is null as d from embeddings")
def array_remap(spark: SparkSession, folder: str) -> DataFrame:
    """Elements in another order."""
    rows = table(spark, folder, "embeddings").select("vec_id", scalars.remap(F.col("embedding").cast("array<double>"), [2, 0, 63, 64]).alias("r"))
    return rows.select("vec_id", *(F.round(F.col("r")[k], 6).alias(n) for k, n in enumerate("abc")), F.col("r")[3].isNull().alias("d"))


@query("""select event_id, try_cast(json_extract_string(props, '$.k') as int) as k, sha256('{"id":' || event_id || ',"k":' || json_extract_string(props, '$.k') || '}') as hash from events where json_extract_string(props, '$.k') is not null""")
def json_extract(spark: SparkSession, folder: str) -> DataFrame:
    """A number out of JSON, and the hash of what was read."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    rows = table(spark, folder, "events").select("event_id", k.alias("k")).where("k is not null")
    return rows.withColumn("hash", scalars.canonical_hash(F.struct(F.col("event_id").alias("id"), F.col("k"))))


@query("""
with p as (select p_partkey, p_size, (p_partkey * 7) % 1200 as off from part)
select p_partkey, (least(greatest(round_even(off / 16.0, 0) * 16, 0), 1936 - s) // 16 * 16)::int as off, s::int as len, (320.5 - off)::double as cx from (select *, least(greatest(round_even(p_size * 40 / 16.0, 0) * 16, 16), 1936) as s from p)""")
def roi_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Regions snapped to the sensor's grid, and the principal point inside them."""
    off = (F.col("p_partkey") * 7) % 1200
    rows = table(spark, folder, "part").select("p_partkey", camera.snap_roi(off, F.col("p_size") * 40, F.lit(1936)).alias("r"), camera.shift_to_roi(F.lit(320.5), F.lit(240.0), off, F.lit(0)).alias("c"))
    return rows.select("p_partkey", F.col("r.offset").alias("off"), F.col("r.length").alias("len"), F.col("c.cx").alias("cx"))


@query("""
with c as (select distinct calib_id, serial, serial_left, file_name from calibrations)
select calib_id, case when file_name ilike '%calib%' then 2 end as rank, starts_with(file_name, 'stereo') as pair from c""")
def selector_rank(spark: SparkSession, folder: str) -> DataFrame:
    """How a file answers to a choice."""
    c = table(spark, folder, "calibrations").select("calib_id", "file_name").dropDuplicates(["calib_id"])
    return c.select("calib_id", scalars.selector(F.lit(" Calib "), F.col("calib_id"), F.col("file_name")).alias("rank"), F.startswith("file_name", F.lit("stereo")).alias("pair"))
