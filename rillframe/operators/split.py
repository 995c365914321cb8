"""From spoken commands to chunks of a recording."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillframe.operators.asof import asof, neighbours
from rillframe.operators.blocks import FRAMES, TIME_US, with_number


def resolve_chunks(windows: DataFrame, frames: DataFrame, *, by: Sequence[str], start: str, end: str, frame: str, time: str, keyframe: str, pad_us: int = 0, min_duration_us: int = 0, prefix: str = "chunk_") -> DataFrame:
    """Windows of time as chunks of frames: entity, ``chunk_index``, ``name``, ``start_frame``, ``end_frame``, ``start_time_us``, ``end_time_us``.

    A window is padded on both sides; it starts with the first key frame not before the first frame of
    the padded window and ends with the last frame not after its end. An open start is the first frame,
    an open end the last one. Windows that end before they start, or are shorter than the least
    duration, are dropped; equal ones count once; the others are numbered in order of their start.
    """
    keys = list(by)
    ends = frames.groupBy(*keys).agg(F.min(F.struct(F.col(time).alias("t"), F.col(frame).alias("f"))).alias("__first"), F.max(F.struct(F.col(time).alias("t"), F.col(frame).alias("f"))).alias("__last"))
    rows = windows.select(*keys, (F.col(start) - pad_us).alias("__from"), (F.col(end) + pad_us).alias("__to")).join(ends, keys)
    # Both ends of a window are looked up in one go, then its start among the key frames.
    asked = rows.withColumn("__q", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("__from").alias("t")), F.struct(F.lit(1).alias("end"), F.col("__to").alias("t"))))).withColumn("__t", F.col("__q.t"))
    found = neighbours(asked, frames, by=keys, left_time="__t", right_time=time, take=[frame])
    at_end = lambda k, c: F.max(F.when(F.col("__q.end") == k, F.col(c)))
    rows = found.groupBy(*keys, "__from", "__to", "__first", "__last").agg(at_end(0, f"next.{frame}").alias("__af"), at_end(1, "prev").alias("__e"))
    rows = asof(rows, frames.where(F.col(keyframe)), by=keys, left_time="__af", right_time=frame, take=[time], direction="forward", out="__s", block=FRAMES)
    opened = F.col("__from").isNull()
    rows = rows.select(
        *keys,
        F.when(opened, F.col("__first.f")).otherwise(F.col("__s.at")).alias("start_frame"),
        F.when(opened, F.col("__first.t")).otherwise(F.col(f"__s.{time}")).alias("start_time_us"),
        F.when(F.col("__to").isNull(), F.col("__last.f")).otherwise(F.col(f"__e.{frame}")).alias("end_frame"),
        F.when(F.col("__to").isNull(), F.col("__last.t")).otherwise(F.col("__e.at")).alias("end_time_us"),
    )
    rows = rows.where((F.col("end_frame") >= F.col("start_frame")) & (F.col("end_time_us") - F.col("start_time_us") >= min_duration_us))
    rows = with_number(rows, by=keys, order=["start_time_us", "end_time_us", "start_frame", "end_frame"], block=TIME_US, out="chunk_index")
    return rows.select(*keys, "chunk_index", F.concat(F.lit(prefix), F.lpad(F.col("chunk_index").cast("string"), 3, "0")).alias("name"), "start_frame", "end_frame", "start_time_us", "end_time_us")
