"""Readers for the files of a recording: explicit schemas, rejected unknowns, typed empties."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SIDE = "struct<serial:string,calibration:string,roi:struct<x:int,y:int,width:int,height:int>>"
MANIFEST = f"format string, created string, fps double, sensor_native_hz double, decimation_stride int, cam_reset_perf_counter_us bigint, files map<string,string>, left {SIDE}, right {SIDE}, audio struct<enabled:boolean,file:string,backend:string,clock_alignment:string>, imu struct<enabled:boolean,rate_hz:double>"
FRAME_LOG = "frame bigint, t_left_us bigint, t_right_us bigint, skew_us bigint, fresh int"
IMU_LOG = "sample bigint, host_time_us bigint, ax_g double, ay_g double, az_g double, gx_rad_s double, gy_rad_s double, gz_rad_s double, mx_ut double, my_ut double, mz_ut double"
WORD = "struct<word:string,start:double,end:double,probability:double,start_us:bigint,end_us:bigint>"
TRANSCRIPT = f"format string, segments array<struct<id:int,start:double,end:double,text:string,no_speech_prob:double,words:array<{WORD}>>>"
BOX = "struct<is_right:boolean,box:array<double>,keypoints:array<array<double>>,score:double>"
HANDS = f"frame bigint, hands array<{BOX}>"
LOOPS = "frame_a bigint, frame_b bigint, frame0 bigint, frame1 bigint, score double, n_votes double, pair_type string"
PACKETS = "pts_s double, size bigint, flags string"


def _recording(path_column: Column) -> Column:
    """The name of the folder a file lies in."""
    return F.regexp_extract(path_column, r"([^/]+)/[^/]+$", 1)


def read_json_object(spark: SparkSession, path: str, schema: str, formats: Sequence[str] = ()) -> DataFrame:
    """One row per file, with ``recording_id`` of its folder; fails on broken files and on a ``format`` not in ``formats``."""
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    df = df.withColumn("recording_id", _recording(F.input_file_name()))
    if formats:
        known = F.coalesce(F.col("format").isin(*formats), F.lit(False))
        df = df.withColumn("format", F.when(known, F.col("format")).otherwise(F.raise_error(F.concat(F.lit("unknown format: "), F.coalesce("format", F.lit("none")))).cast("string")))
    return df


def file_of(key: str, default: str) -> Column:
    """The file a manifest names for a key, else the usual name."""
    return F.coalesce(F.try_element_at("files", F.lit(key)), F.lit(default))


def read_frame_log(spark: SparkSession, path: str, frame_counts: DataFrame | None = None) -> DataFrame:
    """Frames with a left time; with ``frame_counts`` (recording_id, frame_count) none beyond the video."""
    df = spark.read.schema(FRAME_LOG).option("header", True).option("nullValue", "").csv(path)
    df = df.withColumn("recording_id", _recording(F.input_file_name())).where("t_left_us is not null")
    if frame_counts is not None:
        df = df.join(frame_counts.select("recording_id", "frame_count"), "recording_id").where("frame < frame_count").drop("frame_count")
    return df


def read_imu_log(spark: SparkSession, path: str) -> DataFrame:
    """Inertial readings."""
    return spark.read.schema(IMU_LOG).option("header", True).option("nullValue", "").csv(path).withColumn("recording_id", _recording(F.input_file_name()))


def words_for_split(transcripts: DataFrame) -> DataFrame:
    """Words with a clock, normalised, in order: recording_id, ``n``, text, ``normalized``, start_us, end_us, probability, no_speech_prob."""
    from rillframe.functions.scalars import normalize_text

    seg = transcripts.select("recording_id", F.posexplode("segments").alias("s", "seg"))
    word = seg.select("recording_id", "s", F.coalesce("seg.no_speech_prob", F.lit(0.0)).alias("no_speech_prob"), F.posexplode("seg.words").alias("w", "word"))
    rows = word.select("recording_id", "s", "w", F.col("word.word").alias("text"), normalize_text(F.col("word.word")).alias("normalized"), F.col("word.start_us").alias("start_us"), F.col("word.end_us").alias("end_us"), F.coalesce("word.probability", F.lit(1.0)).alias("probability"), "no_speech_prob")
    rows = rows.where("start_us is not null and end_us is not null and normalized <> ''")
    order = Window.partitionBy("recording_id").orderBy("start_us", "s", "w")
    return rows.withColumn("n", F.row_number().over(order) - 1).drop("s", "w")


def voice_tables(transcripts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments and words for export; words are numbered through a recording, times are microseconds, -1 if unknown."""
    from rillframe.functions.scalars import us_half_even

    seg = transcripts.select("recording_id", F.posexplode("segments").alias("segment_index", "seg"))
    us = lambda c: F.coalesce(us_half_even(F.col(c)), F.lit(-1).cast("long"))
    segments = seg.select("recording_id", "segment_index", F.trim("seg.text").alias("text"), us("seg.start").alias("start_us"), us("seg.end").alias("end_us"))
    words = seg.select("recording_id", "segment_index", F.posexplode("seg.words").alias("pos", "w"))
    order = Window.partitionBy("recording_id").orderBy("segment_index", "pos")
    words = words.select("recording_id", (F.row_number().over(order) - 1).cast("long").alias("id"), "segment_index", F.col("w.word").alias("text"), F.coalesce("w.start_us", us("w.start")).alias("start_us"), F.coalesce("w.end_us", us("w.end")).alias("end_us"), F.coalesce("w.probability", F.lit(float("nan"))).alias("probability"))
    bad = F.raise_error("a word ends before it starts").cast("bigint")
    return segments, words.withColumn("end_us", F.when(F.col("end_us") < F.col("start_us"), bad).otherwise(F.col("end_us")))


def normalize_segments(segments: Column, pts_us: Column, aligned: Column) -> Column:
    """Raw segments with text stripped, times in microseconds after the first sample's, clock times only where aligned; words without times are dropped."""
    from rillframe.functions.scalars import us_half_up

    def clock(c: Column) -> Column:
        return F.when(aligned, us_half_up(c) + pts_us)

    def word(w: Column) -> Column:
        return F.struct(F.trim(w["word"]).alias("word"), us_half_up(w["start"]).alias("start_us"), us_half_up(w["end"]).alias("end_us"), clock(w["start"]).alias("perf_start_us"), clock(w["end"]).alias("perf_end_us"), w["probability"].alias("probability"))

    timed = lambda w: w["start"].isNotNull() & w["end"].isNotNull()
    return F.transform(segments, lambda s: F.struct(s["id"].alias("id"), F.trim(s["text"]).alias("text"), us_half_up(s["start"]).alias("start_us"), us_half_up(s["end"]).alias("end_us"), clock(s["start"]).alias("perf_start_us"), clock(s["end"]).alias("perf_end_us"), F.transform(F.filter(s["words"], timed), word).alias("words")))


def clock_aligned(audio: Column, audio_file: Column, marker: str) -> Column:
    """Whether a manifest says that audio times are on the host clock: on, the right file, the marker in its alignment."""
    return F.coalesce(audio["enabled"] & (audio["file"] == audio_file) & audio["backend"].isNotNull() & F.contains(F.lower(audio["clock_alignment"]), F.lit(marker.lower())), F.lit(False))


def read_lines_with_meta(spark: SparkSession, path: str, schema: str, key: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines and the meta lines among them; fails if a key comes twice in a recording."""
    raw = spark.read.text(path).select(_recording(F.input_file_name()).alias("recording_id"), "value").where("trim(value) <> ''")
    is_meta = F.coalesce(F.get_json_object("value", "$.meta") == "true", F.lit(False))
    meta = raw.where(is_meta)
    rows = raw.where(~is_meta).select("recording_id", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("recording_id", "r.*")
    n = F.count(F.lit(1)).over(Window.partitionBy("recording_id", key))
    twice = F.raise_error(F.concat(F.lit("repeated row: "), F.col(key).cast("string"))).cast(dict(rows.dtypes)[key])
    return rows.withColumn("__n", n).withColumn(key, F.when(F.col("__n") > 1, twice).otherwise(F.col(key))).drop("__n"), meta


def largest_hands(observations: DataFrame, *, right: bool, by_width: bool = False, first: int | None = None, last: int | None = None) -> DataFrame:
    """Per frame the largest box (by area, or by width) of one side, the first of equal ones."""
    from rillframe.operators.stats import argmax_rows

    rows = observations.select("recording_id", "frame", F.posexplode("hands").alias("pos", "hand")).where(F.col("hand.is_right") == right)
    if first is not None:
        rows = rows.where(F.col("frame") >= first)
    if last is not None:
        rows = rows.where(F.col("frame") <= last)
    box = F.col("hand.box")
    width, height = box[2] - box[0], box[3] - box[1]
    return argmax_rows(rows, by=["recording_id", "frame"], measure=width if by_width else width * height, position=["pos"])


def read_loop_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Loop candidates; either spelling of the frames, votes as score where none is given. A broken line fails the scan."""
    raw = spark.read.text(path).where("trim(value) <> ''").select(F.from_json("value", LOOPS, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    return raw.select(F.coalesce("frame_a", "frame0").alias("frame_a"), F.coalesce("frame_b", "frame1").alias("frame_b"), F.coalesce("score", "n_votes").alias("score"), "n_votes", F.coalesce("pair_type", F.lit("temporal")).alias("pair_type"))


def first_found(wanted: DataFrame, files: DataFrame, *, on: Sequence[str], priority: str) -> DataFrame:
    """Each wanted entry with the file of the least priority, null where there is none."""
    best = files.groupBy(*on).agg(F.min_by("path", F.struct(priority, "path")).alias("path"))
    return wanted.join(best, list(on), "left")


def exactly_one(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """``df``, failing if a key has more than one row."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*on))
    rows = df.withColumn("__n", n)
    return rows.where(F.when(F.col("__n") > 1, F.raise_error("more than one match").cast("boolean")).otherwise(True)).drop("__n")


def either_order(pairs: DataFrame) -> DataFrame:
    """Camera pairs under both orders of their serials, with ``swapped``."""
    same = pairs.withColumn("swapped", F.lit(False))
    other = pairs.select(*(F.col({"serial_left": "serial_right", "serial_right": "serial_left"}.get(c, c)).alias(c) for c in pairs.columns), F.lit(True).alias("swapped"))
    return same.unionByName(other)


def head_pose(rows: DataFrame, *, v1: str, v2: str, allow_identity: bool) -> DataFrame:
    """The head pose matrix of each row: identity for the first format, the given 16 numbers for the second; else as allowed."""
    unit = F.array(*(F.lit(1.0 if k % 5 == 0 else 0.0) for k in range(16)))
    none = unit if allow_identity else F.raise_error("no head pose").cast("array<double>")
    given = F.when(F.size("matrix") == 16, F.col("matrix")).otherwise(F.raise_error("a head pose needs 16 numbers").cast("array<double>"))
    return rows.withColumn("matrix", F.when(F.col("format") == v1, unit).when(F.col("format") == v2, given).otherwise(none))


def video_index(packets: DataFrame) -> DataFrame:
    """Packets of probed videos (recording_id, pos, pts_s, size, flags) as frames with ``is_key``; fails without pts or key frame, or if pts don't grow."""
    w = Window.partitionBy("recording_id").orderBy("pos")
    rows = packets.withColumns({"frame": (F.row_number().over(w) - 1).cast("long"), "is_key": F.contains("flags", F.lit("K")), "__p": F.lag("pts_s").over(w)})
    any_key = F.max(F.col("is_key").cast("int")).over(Window.partitionBy("recording_id"))
    bad = F.when(F.col("pts_s").isNull(), "a packet has no time").when(F.col("pts_s") <= F.col("__p"), "times don't grow").when(F.col("__k") == 0, "no key frame")
    rows = rows.withColumn("__k", any_key)
    return rows.where(F.when(bad.isNotNull(), F.raise_error(bad).cast("boolean")).otherwise(True)).select("recording_id", "frame", "pts_s", "size", "is_key")


def equal_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """``recording_id`` and ``frame_count`` of videos whose sides have equally many frames, more than none; fails on others."""
    a = left.groupBy("recording_id").agg(F.count(F.lit(1)).alias("frame_count"))
    b = right.groupBy("recording_id").agg(F.count(F.lit(1)).alias("__other"))
    both = a.join(b, "recording_id", "full")
    ok = F.coalesce(F.col("frame_count") == F.col("__other"), F.lit(False))
    return both.where(F.when(~ok, F.raise_error("the sides differ in length").cast("boolean")).otherwise(True)).drop("__other")
