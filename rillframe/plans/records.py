"""Queries of readers and writers: tables are written as the files of recordings and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillframe.plans.clock import FRAMES_SQL
from rillframe.plans.joins import IMU_SQL, TRIGGERS_SQL, triggers
from rillframe.plans.registry import Registry
from rillframe.session import ensure_checkpoint_dir
from rillframe.sinks import bundle
from rillframe.sources import recordings
from rillframe.sources.tables import table

query = Registry()


def _shared(spark: SparkSession, name: str) -> str:
    """A new place in the folder that all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _named(df: DataFrame) -> DataFrame:
    """Folders are named by their column; the recording's name is what stands behind it."""
    return df.withColumn("recording_id", F.regexp_replace("recording_id", "^[a-z]+=", ""))


def _log(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "sync_log").select("recording_id", "frame", "t_left_us", "t_right_us", "skew_us", "fresh").dropDuplicates(["recording_id", "frame"])


@query(FRAMES_SQL)
def scan_frame_log(spark: SparkSession, folder: str) -> DataFrame:
    """Frame logs as CSV files, one folder a recording; blank times are left out."""
    path = _shared(spark, "frame-log")
    _log(spark, folder).withColumnRenamed("recording_id", "rec").repartition("rec").write.partitionBy("rec").option("header", True).csv(path)
    return _named(recordings.read_frame_log(spark, f"{path}/*/*.csv"))


@query(f"select recording_id, frame, t_left_us from ({FRAMES_SQL}) join recordings using (recording_id) where frame < frame_count")
def scan_frame_log_of_video(spark: SparkSession, folder: str) -> DataFrame:
    """Frame logs up to the length of the video."""
    path = _shared(spark, "frame-log")
    _log(spark, folder).withColumn("rec", F.col("recording_id")).repartition("rec").drop("recording_id").write.partitionBy("rec").option("header", True).csv(path)
    counts = table(spark, folder, "recordings").select(F.concat(F.lit("rec="), "recording_id").alias("recording_id"), "frame_count").where("frame_count is not null")
    return _named(recordings.read_frame_log(spark, f"{path}/*/*.csv", counts)).select("recording_id", "frame", "t_left_us")


@query(f"select recording_id, sample, host_time_us, ax_g, gz_rad_s from ({IMU_SQL})")
def scan_imu_log(spark: SparkSession, folder: str) -> DataFrame:
    """Inertial logs as CSV files, one folder a recording."""
    path = _shared(spark, "imu-log")
    names = [c.split()[0] for c in recordings.IMU_LOG.split(", ")]
    rows = table(spark, folder, "imu_log").where("host_time_us is not null").select("recording_id", *names).dropDuplicates(["recording_id", "sample"])
    rows.withColumnRenamed("recording_id", "rec").repartition("rec").write.partitionBy("rec").option("header", True).csv(path)
    return _named(recordings.read_imu_log(spark, f"{path}/*/*.csv")).select("recording_id", "sample", "host_time_us", "ax_g", "gz_rad_s")


@query("select recording_id, fps, sensor_native_hz, decimation_stride, cam_reset_perf_counter_us, coalesce(serial_left, 'none') as serial, case when has_imu_log then 'imu.csv' else 'imu_log.csv' end as imu_file, has_imu_log as aligned from recordings")
def scan_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """Manifests as JSON files, with the file of the inertial log and whether audio is on the host clock."""
    path = _shared(spark, "manifests")
    rec = table(spark, folder, "recordings")
    on = F.col("has_imu_log")
    audio = F.struct(F.lit(True).alias("enabled"), F.lit("a.mka").alias("file"), F.lit("x").alias("backend"), F.when(on, "Host PERF_COUNTER").otherwise("none").alias("clock_alignment"))
    files = F.when(on, F.create_map(F.lit("imu"), F.lit("imu.csv"))).otherwise(F.create_map(F.lit("audio"), F.lit("a.mka")))
    side = F.struct(F.coalesce("serial_left", F.lit("none")).alias("serial"))
    rows = rec.select(F.col("recording_id").alias("rec"), F.to_json(F.struct(F.lit("recording/1").alias("format"), "fps", "sensor_native_hz", "decimation_stride", "cam_reset_perf_counter_us", files.alias("files"), side.alias("left"), audio.alias("audio"))).alias("value"))
    rows.repartition("rec").write.partitionBy("rec").text(path)
    got = _named(recordings.read_json_object(spark, f"{path}/*/*.txt", recordings.MANIFEST, ["recording/1"]))
    aligned = recordings.clock_aligned(F.col("audio"), F.lit("a.mka"), "perf_counter")
    return got.select("recording_id", "fps", "sensor_native_hz", "decimation_stride", "cam_reset_perf_counter_us", F.col("left.serial").alias("serial"), recordings.file_of("imu", "imu_log.csv").alias("imu_file"), aligned.alias("aligned"))


# A segment per trigger, a word every 200 ms.
_WORDS = f"""
select recording_id, trigger_id, text, start_us, min_probability, ws[i] as word, i, start_us + (i - 1) * 200000 as s
from (select *, unnest(range(1, len(ws) + 1)) as i from (select *, string_split(text, ' ') as ws from ({TRIGGERS_SQL}) where text is not null))"""


def _transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """Transcripts as JSON files, read back."""
    path = _shared(spark, "transcripts")
    rows = triggers(spark, folder).where("text is not null")
    at = lambda i: F.col("start_us") + i * 200_000
    words = F.transform(F.split("text", " "), lambda w, i: F.struct(w.alias("word"), (at(i) / 1e6).alias("start"), ((at(i) + 150_000) / 1e6).alias("end"), F.col("min_probability").alias("probability"), at(i).alias("start_us"), (at(i) + 150_000).alias("end_us")))
    seg = F.struct(F.col("start_us"), F.col("trigger_id"), F.struct((F.col("start_us") / 1e6).alias("start"), (F.col("end_us") / 1e6).alias("end"), "text", words.alias("words")).alias("seg"))
    each = rows.groupBy(F.col("recording_id").alias("rec")).agg(F.transform(F.sort_array(F.collect_list(seg)), lambda s: s["seg"]).alias("segments"))
    each.select("rec", F.to_json(F.struct(F.lit("voice/1").alias("format"), "segments")).alias("value")).repartition("rec").write.partitionBy("rec").text(path)
    return _named(recordings.read_json_object(spark, f"{path}/*/*.txt", recordings.TRANSCRIPT, ["voice/1"]))


@query(f"""
with w as (select *, trim(regexp_replace(lower(word), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) as normalized from ({_WORDS}))
select recording_id, row_number() over (partition by recording_id order by s, start_us, trigger_id, i) - 1 as n, word as text, normalized, s as start_us, s + 150000 as end_us, coalesce(min_probability, 1.0) as probability from w where normalized <> ''""")
def transcript_words(spark: SparkSession, folder: str) -> DataFrame:
    """Words of the transcripts with a clock, in plain form, numbered through a recording."""
    return recordings.words_for_split(_transcripts(spark, folder)).drop("no_speech_prob")


@query(f"""
with w as (select *, dense_rank() over (partition by recording_id order by start_us, trigger_id) - 1 as segment_index from ({_WORDS}))
select recording_id, row_number() over (partition by recording_id order by segment_index, i) - 1 as id, segment_index, word as text, s as start_us, s + 150000 as end_us from w""")
def voice_words(spark: SparkSession, folder: str) -> DataFrame:
    """Words of the transcripts as they are exported."""
    return recordings.voice_tables(_transcripts(spark, folder))[1].drop("probability")


@query(f"select recording_id, row_number() over (partition by recording_id order by start_us, trigger_id) - 1 as segment_index, trim(text) as text, start_us, end_us from ({TRIGGERS_SQL}) where text is not null")
def voice_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Segments of the transcripts as they are exported."""
    return recordings.voice_tables(_transcripts(spark, folder))[0]


@query(f"select trigger_id, recording_id, phrase, start_us, end_us from ({TRIGGERS_SQL})")
def scan_json_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Triggers as JSON lines with a meta line in each file."""
    path = _shared(spark, "lines")
    rows = triggers(spark, folder).select("trigger_id", F.col("recording_id").alias("of"), "phrase", "start_us", "end_us")
    lines = rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).unionByName(spark.createDataFrame([('{"meta": true}',), ("",)], "value string"))
    bundle.publish(lines, path, fmt="text")
    got, _ = recordings.read_lines_with_meta(spark, path, "trigger_id long, of string, phrase string, start_us long, end_us long", "trigger_id")
    return got.select("trigger_id", F.col("of").alias("recording_id"), "phrase", "start_us", "end_us")


@query("select l_orderkey * 10 + l_linenumber as frame_a, l_partkey + 100000000 as frame_b, case when l_tax > 0.04 then l_discount else l_quantity end as score, case when l_suppkey % 2 = 0 then 'spatial' else 'temporal' end as pair_type from lineitem")
def scan_loop_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Loop candidates as JSON lines, in both spellings, with and without a score."""
    path = _shared(spark, "loops")
    a, b = F.col("l_orderkey") * 10 + F.col("l_linenumber"), F.col("l_partkey") + 100_000_000
    new = F.col("l_linenumber") % 2 == 0
    fields = {"frame_a": F.when(new, a), "frame_b": F.when(new, b), "frame0": F.when(~new, a), "frame1": F.when(~new, b), "score": F.when(F.col("l_tax") > 0.04, F.col("l_discount")), "n_votes": F.col("l_quantity"), "pair_type": F.when(F.col("l_suppkey") % 2 == 0, "spatial")}
    bundle.write_json_lines(table(spark, folder, "lineitem").select(*(c.alias(k) for k, c in fields.items())), path)
    return recordings.read_loop_candidates(spark, path).drop("n_votes")


@query("select recording_id, frame, coalesce(t_left_us, -1) as t_left_us, coalesce(skew_us, -1) as skew_us, coalesce(skew_us / 4.0, -1) as quarter from (select distinct recording_id, frame, t_left_us, skew_us from sync_log)")
def bundle_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """A bundle written and read: nulls as a bundle has them."""
    path = _shared(spark, "bundle")
    rows = _log(spark, folder).select("recording_id", "frame", "t_left_us", "skew_us", (F.col("skew_us") / 4.0).alias("quarter"))
    bundle.write_bundle({"frames": rows}, path, {"frames": {"skew_us": ("right less left", "us")}})
    bundle.write_bundle({"frames": rows}, path, overwrite=True)
    got = bundle.read_bundle(spark, path)["frames"]
    return got.withColumn("quarter", F.nanvl("quarter", F.lit(-1.0)))


@query("select recording_id, frame - 10 as frame, t_right_us from (select distinct recording_id, frame, t_left_us, t_right_us from sync_log) where frame between 10 and 40 and t_left_us is not null")
def csv_slice(spark: SparkSession, folder: str) -> DataFrame:
    """Frames 10 to 40 of a log, counted anew; what isn't counted is passed on as written."""
    path = _shared(spark, "slice")
    _log(spark, folder).write.option("header", True).csv(f"{path}/whole")
    bundle.rewrite_csv(spark, f"{path}/whole", f"{path}/part", F.col("frame").cast("long").between(10, 40), {"frame": F.col("frame").cast("long") - 10})
    got = spark.read.option("header", True).schema("recording_id string, frame long, t_left_us long, t_right_us long, skew_us long, fresh int").csv(f"{path}/part")
    return got.where("t_left_us is not null").select("recording_id", "frame", "t_right_us")


@query("""
with a as (select serial, arg_max(convention, calib_id) as convention, arg_max(rms_px, calib_id) as rms_px from calibrations where serial is not null and calib_id % 2 = 0 group by 1),
b as (select serial, arg_max(convention, calib_id) as convention, arg_max(rms_px, calib_id) as rms_px from calibrations where serial is not null and calib_id % 2 = 1 group by 1)
select serial, coalesce(b.convention, a.convention) as convention, coalesce(b.rms_px, a.rms_px) as rms_px from a full join b using (serial)""")
def merged_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Calibrations of two sessions, section by section: the odd ones over the even ones."""
    rows = table(spark, folder, "calibrations").where("serial is not null").select("serial", "calib_id", "convention", "rms_px")
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("calib_id"))).alias(c)
    part = lambda k: rows.where(F.col("calib_id") % 2 == k).groupBy("serial").agg(latest("convention"), latest("rms_px"))
    return bundle.merge_sections(part(0), part(1), key="serial", sections=["convention", "rms_px"])


@query("""
with s as (select serial, file_name, row_number() over (partition by serial order by saved_at desc, file_name) as n from calibrations where serial is not null)
select r.serial_left as serial, s.file_name as path from (select distinct serial_left from recordings where serial_left is not null) r left join s on s.serial = r.serial_left and s.n = 1""")
def calibration_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """The latest calibration file of every left camera."""
    files = table(spark, folder, "calibrations").where("serial is not null").select("serial", F.col("file_name").alias("path"), (-F.unix_micros(F.col("saved_at").cast("timestamp"))).alias("age"))
    files = files.withColumn("age", F.coalesce("age", F.lit(2**62)))
    wanted = table(spark, folder, "recordings").where("serial_left is not null").select(F.col("serial_left").alias("serial")).distinct()
    return recordings.first_found(wanted, files, on=["serial"], priority="age")


@query("""
with p as (select distinct on (calib_id) calib_id, serial_left, serial_right from calibrations where serial_left is not null)
select calib_id, serial_left, serial_right, false as swapped from p union all select calib_id, serial_right, serial_left, true from p""")
def pairs_in_either_order(spark: SparkSession, folder: str) -> DataFrame:
    """Calibrated pairs under both orders of their serials."""
    return recordings.either_order(table(spark, folder, "calibrations").where("serial_left is not null").select("calib_id", "serial_left", "serial_right").dropDuplicates(["calib_id"]))


# Every order's lines as a video's packets: every fourth is a key frame.
_PACKETS = "select l_orderkey::varchar as recording_id, n - 1 as frame, n * 0.5 as pts_s, l_partkey as size, n % 4 = 1 as is_key from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as n from lineitem)"


def _packets(spark: SparkSession, folder: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    rows = table(spark, folder, "lineitem").select(F.col("l_orderkey").cast("string").alias("recording_id"), n.alias("pos"), F.col("l_partkey").alias("size"))
    return recordings.video_index(rows.withColumns({"pts_s": F.col("pos") * 0.5, "flags": F.when(F.col("pos") % 4 == 1, "K__").otherwise("___")}))


@query(_PACKETS)
def packet_index(spark: SparkSession, folder: str) -> DataFrame:
    """Probed packets as frames with key frames."""
    return _packets(spark, folder)


@query(f"select recording_id, count(*) as frame_count from ({_PACKETS}) group by 1")
def equal_frame_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The length of videos whose sides are equally long."""
    rows = _packets(spark, folder)
    return recordings.equal_counts(rows, rows.withColumn("size", F.col("size") + 1))


@query(f"""
with p as ({_PACKETS}), n as (select recording_id, count(*) as n from p group by 1)
select recording_id, 0 as chunk, case when n >= 2 and recording_id::bigint % 5 = 0 then 'packets missing' when recording_id::bigint % 5 = 1 then 'packets differ' when recording_id::bigint % 5 = 2 and n >= 2 then 'does not start with a key frame' end as reason
from n where (recording_id::bigint % 5 in (0, 2) and n >= 2) or recording_id::bigint % 5 = 1""")
def wrong_cuts(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks whose cut lacks its last packet, has another packet, or doesn't begin with a key frame."""
    source = _packets(spark, folder)
    kind = F.col("recording_id").cast("long") % 5
    ends = source.groupBy("recording_id").agg(F.max("frame").alias("last"))
    first = F.when((kind == 2) & (F.col("last") >= 1), 1).otherwise(0).cast("long")
    chunks = ends.select("recording_id", F.lit(0).alias("chunk"), first.alias("start_frame"), F.col("last").alias("end_frame"))
    cut = source.join(chunks, "recording_id").where("frame >= start_frame").where(~((kind == 0) & (F.col("frame") == F.col("end_frame")) & (F.col("end_frame") > 0)))
    cut = cut.select("recording_id", "chunk", (F.col("frame") - F.col("start_frame")).alias("frame"), F.when(kind == 1, F.col("size") + 1).otherwise(F.col("size")).alias("size"), "is_key")
    return bundle.wrong_cuts(source, cut, chunks)


@query("""
with e as (select vec_id, label, embedding[1]::double as a, embedding[2]::double as b, embedding[3]::double as c, embedding[4]::double as d from embeddings)
select label::varchar as recording_id, vec_id // 4 as frame, arg_max(vec_id % 4, (abs(c) * abs(d), -(vec_id % 4))) as pos from e group by 1, 2""")
def largest_hand(spark: SparkSession, folder: str) -> DataFrame:
    """Of the boxes of a frame the largest, the first of equal ones."""
    e = lambda k: F.col("embedding")[k].cast("double")
    hand = F.struct(F.lit(True).alias("is_right"), F.array(F.lit(0.0), F.lit(0.0), F.abs(e(2)), F.abs(e(3))).alias("box"))
    rows = table(spark, folder, "embeddings").select(F.col("label").cast("string").alias("recording_id"), F.call_function("div", F.col("vec_id"), F.lit(4)).alias("frame"), (F.col("vec_id") % 4).alias("k"), hand.alias("hand"))
    seen = rows.groupBy("recording_id", "frame").agg(F.sort_array(F.collect_list(F.struct("k", "hand"))).alias("s"))
    # Boxes of the four places, of which some are empty: places are kept, so that the position is the place.
    place = lambda k: F.get(F.filter("s", lambda x: x["k"] == k), F.lit(0))["hand"]
    none = F.struct(F.lit(False).alias("is_right"), F.array(*(F.lit(0.0) for _ in range(4))).alias("box"))
    hands = seen.select("recording_id", "frame", F.array(*(F.coalesce(place(k), none) for k in range(4))).alias("hands"))
    return recordings.largest_hands(hands, right=True).select("recording_id", "frame", F.col("pos").cast("long").alias("pos"))
