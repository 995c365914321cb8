"""Queries of statistics and quality."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillframe.functions import scalars
from rillframe.operators import stats
from rillframe.operators.blocks import FRAMES, with_neighbours
from rillframe.plans.clock import FRAMES_SQL, frames
from rillframe.plans.joins import IMU_SQL, imu
from rillframe.plans.registry import Registry
from rillframe.sources.tables import table

query = Registry()


@query(f"""
with x as (select recording_id, abs(gx_rad_s) as x from ({IMU_SQL}) where abs(gx_rad_s) > 1e-6 and not isnan(gx_rad_s) and not isinf(gx_rad_s)),
m as (select recording_id, median(x) as med from x group by 1), d as (select recording_id, any_value(med) as med, median(abs(x - med)) as mad from x join m using (recording_id) group by 1)
select recording_id, round(med, 6) as median, round(mad, 6) as mad, round(1 / (1 + 10 * mad / med), 6) as quality from d""")
def median_mad(spark: SparkSession, folder: str) -> DataFrame:
    """Middle and spread of the angular rate of each recording."""
    rows = imu(spark, folder).select("recording_id", F.abs("gx_rad_s").alias("x"))
    out = stats.median_mad(rows, by=["recording_id"], value="x")
    return out.select("recording_id", *(F.round(c, 6).alias(c) for c in ("median", "mad", "quality")))


@query(f"""
select recording_id, round(avg(s), 4) as mean, round(quantile_cont(s, 0.05), 4) as p5, round(quantile_cont(s, 0.5), 4) as p50, round(quantile_cont(s, 0.9), 4) as p90, round(quantile_cont(s, 0.99), 4) as p99, round(stddev_pop(s), 4) as std, (max(s) - min(s))::bigint as span
from (select recording_id, abs(skew_us) as s from ({FRAMES_SQL}) where skew_us is not null) group by 1""")
def percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Distribution of the skew of each recording's frames."""
    rows = frames(spark, folder).where("skew_us is not null").select("recording_id", F.abs("skew_us").alias("s"))
    p = F.percentile("s", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    out = rows.groupBy("recording_id").agg(F.avg("s").alias("mean"), p.alias("p"), F.stddev_pop("s").alias("std"), (F.max("s") - F.min("s")).alias("span"))
    return out.select("recording_id", F.round("mean", 4).alias("mean"), *(F.round(F.col("p")[i], 4).alias(n) for i, n in enumerate(("p5", "p50", "p90", "p99"))), F.round("std", 4).alias("std"), "span")


@query("""
select l_orderkey, s[least(n * 0.5, n - 1)::bigint + 1] as median, s[least(floor(n * 0.95), n - 1)::bigint + 1] as p95 from (
  select l_orderkey, list_sort(list(l_extendedprice)) as s, count(*) as n, floor(count(*) * 0.5) as h from lineitem group by 1)""".replace("s[least(n * 0.5, n - 1)::bigint + 1]", "s[least(h, n - 1)::bigint + 1]"))
def nearest_rank(spark: SparkSession, folder: str) -> DataFrame:
    """Upper median and 95th percentile of each order's lines by rank."""
    return stats.nearest_rank(table(spark, folder, "lineitem"), by=["l_orderkey"], value="l_extendedprice", fractions={"median": 0.5, "p95": 0.95}, width=10_000.0)


@query(f"select recording_id, round(atan2(avg(sin(a)), avg(cos(a))) * (25000.0 / (2 * pi())), 3) as phase from (select recording_id, skew_us * (2 * pi() / 25000.0) as a from ({FRAMES_SQL}) where skew_us is not null) group by 1")
def circular_mean(spark: SparkSession, folder: str) -> DataFrame:
    """Mean phase between the eyes, as part of a period of 25 ms."""
    rows = frames(spark, folder).where("skew_us is not null")
    return rows.groupBy("recording_id").agg(F.round(stats.circular_mean(F.col("skew_us").cast("double"), 25_000.0), 3).alias("phase"))


@query("""
with w as (select l_returnflag, l_extendedprice as v, 1 - 0.7 * abs((l_linenumber - 1) - 3.0) / 3.0 as k from lineitem)
select l_returnflag, round(sum(v * k) / sum(k), 4) as mean from w group by 1""")
def weighted_mean(spark: SparkSession, folder: str) -> DataFrame:
    """Mean price, lines in the middle of an order counting most."""
    k = stats.center_weight(F.col("l_linenumber") - 1, F.lit(7))
    return table(spark, folder, "lineitem").groupBy("l_returnflag").agg(F.round(stats.weighted_mean(F.col("l_extendedprice"), k), 4).alias("mean"))


@query("select label, (i - 1)::int as dim, round(avg(embedding[i]::double), 6) as mean from (select label, embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings) group by all")
def vector_mean(spark: SparkSession, folder: str) -> DataFrame:
    """Mean vector of each label."""
    e = table(spark, folder, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("embedding"))
    return stats.vector_mean(e, by=["label"], vector="embedding").withColumn("mean", F.round("mean", 6))


@query("""
select l_returnflag, round(greatest(r, g, b) / r, 6) as gain_r, round(greatest(r, g, b) / g, 6) as gain_g, round(greatest(r, g, b) / b, 6) as gain_b, round(c, 6) as clipped from (
  select l_returnflag, avg(l_quantity * 90) as r, avg(l_discount * 40000) as g, avg(l_tax * 50000) as b, avg((greatest(l_quantity * 90, l_discount * 40000, l_tax * 50000) >= 4080)::int) as c from lineitem group by 1)""")
def wb_gains(spark: SparkSession, folder: str) -> DataFrame:
    """Gains that level three channels, and the share of samples cut."""
    gains = stats.balance_gains(F.col("l_quantity") * 90, F.col("l_discount") * 40000, F.col("l_tax") * 50000)
    return table(spark, folder, "lineitem").groupBy("l_returnflag").agg(*(F.round(c, 6).alias(n) for n, c in gains.items()))


@query(f"""
select recording_id, frame // 100 as batch, count(*) as n, sum(fresh)::bigint as fresh, min(t_left_us) as first_us, max(t_left_us) as last_us from ({FRAMES_SQL}) group by all""")
def batch_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Every hundred frames: how many were logged, how many fresh."""
    rows = frames(spark, folder).withColumn("batch", F.floor(F.col("frame") / 100))
    return rows.groupBy("recording_id", "batch").agg(F.count(F.lit(1)).alias("n"), F.sum("fresh").alias("fresh"), F.min("t_left_us").alias("first_us"), F.max("t_left_us").alias("last_us"))


@query("""
with c as (select distinct calib_id, rms_px, num_views, baseline, serial_left from calibrations)
select case when rms_px is null then 'rms_missing' when not (rms_px < 1.0) then 'rms' when not (coalesce(num_views, 0) >= 30) then 'views' when not (serial_left is null or baseline is not null) then 'baseline' end as reason, count(*) as n from c group by 1""")
def quality_funnel(spark: SparkSession, folder: str) -> DataFrame:
    """Calibrations by the first test they fail."""
    c = table(spark, folder, "calibrations").select("calib_id", "rms_px", "num_views", "baseline", "serial_left").dropDuplicates(["calib_id"])
    reason = scalars.first_failure({"rms_missing": F.col("rms_px").isNotNull(), "rms": F.col("rms_px") < 1.0, "views": F.col("num_views") >= 30, "baseline": F.col("serial_left").isNull() | F.col("baseline").isNotNull()})
    return c.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""
with c as (select o_orderkey as k, o_orderstatus as s, o_orderpriority as p from orders),
d as (select a.k, a.s as s1, a.p as p1, b.s as s2, b.p as p2 from c a join c b on b.k = a.k + 1),
e as (select k, unnest([struct_pack(f := 'priority', l := p1, r := p2), struct_pack(f := 'status', l := s1, r := s2)]) as x from d)
select k as o_orderkey, x.f as field, x.l as old, x.r as new from e where x.l is distinct from x.r""")
def config_diff(spark: SparkSession, folder: str) -> DataFrame:
    """What differs between an order and the next one."""
    o = table(spark, folder, "orders").select("o_orderkey", F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority").alias("m"))
    rows = o.join(o.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("m").alias("m2")), "o_orderkey")
    rows = rows.select("o_orderkey", F.explode(scalars.map_difference(F.col("m"), F.col("m2"))).alias("field", "v"))
    return rows.select("o_orderkey", "field", F.col("v.left").alias("old"), F.col("v.right").alias("new"))


@query(f"""
with g as (select recording_id, sample, sqrt(ax_g * ax_g + ay_g * ay_g + az_g * az_g) as n from ({IMU_SQL}) where ax_g is not null and ay_g is not null and az_g is not null)
select recording_id, sample, round(exp(-0.5 * ((n - 1) / 0.05) * ((n - 1) / 0.05)), 6) as confidence, round(greatest(0.0, 1 - abs(n - 1) / 0.15), 6) as taper from g""")
def gravity_confidence(spark: SparkSession, folder: str) -> DataFrame:
    """How far each reading speaks for a rig at rest."""
    n = F.sqrt(F.col("ax_g") * F.col("ax_g") + F.col("ay_g") * F.col("ay_g") + F.col("az_g") * F.col("az_g"))
    rows = imu(spark, folder).where("ax_g is not null and ay_g is not null and az_g is not null").select("recording_id", "sample", n.alias("n"))
    return rows.select("recording_id", "sample", F.round(scalars.gravity_confidence(F.col("n"), 0.05), 6).alias("confidence"), F.round(scalars.linear_taper(F.col("n") - 1, 0.15), 6).alias("taper"))


@query("""
with r as (select l_orderkey, l_linenumber, (l_extendedprice - 35000) / 10000 as r from lineitem)
select l_orderkey, l_linenumber, round(case when abs(r) <= 1.0 then 1.0 else 1.0 / abs(r) end, 6) as huber, round(1 / (1 + (r / 2.0) * (r / 2.0)), 6) as cauchy from r""")
def robust_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Weights of residuals."""
    r = (F.col("l_extendedprice") - 35000) / 10000
    li = table(spark, folder, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.round(scalars.huber_weight(r, 1.0), 6).alias("huber"), F.round(scalars.cauchy_weight(r, 2.0), 6).alias("cauchy"))


@query(f"""
with m as (select recording_id, avg(ax_g) as x, avg(ay_g) as y, avg(az_g) as z from ({IMU_SQL}) where not isnan(ax_g) and not isnan(ay_g) and not isnan(az_g) group by 1)
select recording_id, round(x / sqrt(x*x + y*y + z*z), 6) as x, round(y / sqrt(x*x + y*y + z*z), 6) as y, round(z / sqrt(x*x + y*y + z*z), 6) as z, round(sqrt(x*x + y*y + z*z), 6) as length from m""")
def mean_gravity(spark: SparkSession, folder: str) -> DataFrame:
    """Mean direction of acceleration and its length."""
    rows = imu(spark, folder).where("ax_g is not null and ay_g is not null and az_g is not null and not isnan(ax_g) and not isnan(ay_g) and not isnan(az_g)")
    direction, length = stats.mean_direction(F.col("ax_g"), F.col("ay_g"), F.col("az_g"))
    out = rows.groupBy("recording_id").agg(direction.alias("d"), length.alias("length"))
    return out.select("recording_id", *(F.round(F.col("d")[c], 6).alias(c) for c in "xyz"), F.round("length", 6).alias("length"))


@query("""
with s as (select event_type, value from events)
select event_type, count(value) as n, round(min(value), 4) as min, round(max(value), 4) as max, round(avg(value), 4) as mean, round(median(value), 4) as median, round(stddev_pop(value), 4) as std, round(sum(value), 2) as total, round(sum(value) / (select sum(value) from s), 6) as share from s group by 1""")
def timing_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, range, mean, median and share of each kind of event."""
    out = stats.timing_summary(table(spark, folder, "events"), stage="event_type", ms="value")
    return out.select("event_type", "n", *(F.round(c, 4).alias(c) for c in ("min", "max", "mean", "median", "std")), F.round("total", 2).alias("total"), F.round("share", 6).alias("share"))


@query("""
with q as (select l_returnflag, quantile_cont(l_quantity, 0.7) as q from lineitem group by 1)
select l_returnflag, round(avg((l_discount > 0.05)::int), 6) as fraction from lineitem join q using (l_returnflag) where l_quantity >= q group by 1""")
def gated_fraction(spark: SparkSession, folder: str) -> DataFrame:
    """Share of discounted lines among the larger ones."""
    out = stats.share_above_quantile(table(spark, folder, "lineitem").select("l_returnflag", "l_quantity", "l_discount"), by=["l_returnflag"], confidence="l_quantity", quantile=0.7, agree=F.col("l_discount") > 0.05)
    return out.withColumn("fraction", F.round("fraction", 6))


@query("select recording_id, count(*) as n, count(distinct frame) as frames from sync_log group by 1 having count(*) > count(distinct frame)")
def duplicate_check(spark: SparkSession, folder: str) -> DataFrame:
    """Recordings whose log repeats frames."""
    rows = table(spark, folder, "sync_log").groupBy("recording_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("frame").alias("frames"))
    return rows.where("n > frames")


@query(f"""
select recording_id, round(quantile_cont(j, 0.5), 4) as p50, round(quantile_cont(j, 0.95), 4) as p95 from (
  select recording_id, abs(skew_us - lag(skew_us) over (partition by recording_id order by frame)) as j from ({FRAMES_SQL})) where j is not null group by 1""")
def jitter(spark: SparkSession, folder: str) -> DataFrame:
    """How far the skew jumps from frame to frame."""
    rows = with_neighbours(frames(spark, folder).select("recording_id", "frame", "skew_us"), by=["recording_id"], order=["frame"], take=["skew_us"], block=FRAMES, following=None)
    rows = rows.select("recording_id", F.abs(F.col("skew_us") - F.col("__prev.skew_us")).alias("j")).where("j is not null")
    out = rows.groupBy("recording_id").agg(F.percentile("j", F.array(F.lit(0.5), F.lit(0.95))).alias("p"))
    return out.select("recording_id", F.round(F.col("p")[0], 4).alias("p50"), F.round(F.col("p")[1], 4).alias("p95"))


