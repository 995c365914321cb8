"""Queries p1, p4, p7, p8 and p9 over the standard tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillframe.llm.leaks import find_leaks
from rillframe.llm.mixing import Mix, mix_sources, token_count
from rillframe.llm.nearest import nearest_in_time
from rillframe.llm.phrases import with_command
from rillframe.llm.runs import collapse_runs
from rillframe.llm.segmentation import sentence_units
from rillframe.sources.tables import table

NEAREST_US = 10_000
RUN_GAP_US = 1_000_000


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each frame's nearest reading of its own recording's IMU, wherever that is kept."""
    rec = table(spark, folder, "recordings").select("recording_id", "cam_reset_perf_counter_us", "imu_stream_id")
    frames = table(spark, folder, "sync_log").select("recording_id", "frame", "t_left_us").dropna(subset=["frame", "t_left_us"])
    frames = frames.join(rec, "recording_id").withColumn("host_us", F.try_add("cam_reset_perf_counter_us", "t_left_us"))
    kept = F.array(F.struct(F.lit("imu_log").alias("imu_table"), F.col("recording_id").alias("source")), F.struct(F.lit("imu_sample").alias("imu_table"), F.col("imu_stream_id").alias("source")))
    frames = frames.select("recording_id", "frame", "host_us", F.inline(F.filter(kept, lambda k: k["source"].isNotNull())))
    log = table(spark, folder, "imu_log").select(F.lit("imu_log").alias("imu_table"), F.col("recording_id").alias("source"), "sample", F.col("host_time_us").alias("host_us"))
    sample = table(spark, folder, "imu_sample").select(F.lit("imu_sample").alias("imu_table"), F.col("stream_id").alias("source"), "sample", F.floor(F.when(~F.isnan("host_time_s"), F.col("host_time_s")) * 1e6).alias("host_us"))
    found = nearest_in_time(
        frames,
        log.unionByName(sample),
        left_entity=["imu_table", "source"],
        right_entity=["imu_table", "source"],
        left_time="host_us",
        right_time="host_us",
        left_key=["recording_id", "frame"],
        right_key=["imu_table", "sample"],
        tolerance=NEAREST_US,
    )
    return found.select("recording_id", "frame", "imu_table", "sample")


def p4_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Consecutive triggers of a recording that mean the same command, as one; others as they are."""
    rows = table(spark, folder, "triggers").select("recording_id", "trigger_id", "phrase", "start_us", "end_us").where(F.col("phrase").isNotNull())
    rows = with_command(rows, table(spark, folder, "commands"), phrase="phrase", into="command_id")
    # A phrase that means no known command is like nothing but itself.
    rows = rows.withColumn("meaning", F.coalesce(F.col("command_id").cast("string"), F.concat(F.lit("?"), F.col("phrase"))))
    return collapse_runs(rows, entity=["recording_id"], start="start_us", end="end_us", event_id="trigger_id", label="meaning", max_gap=RUN_GAP_US)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of at least two triggers of one command."""
    runs = p4_runs(spark, folder).where((F.col("n") >= 2) & ~F.startswith("label", F.lit("?")))
    return runs.select("recording_id", F.col("first_event").alias("first_trigger_id"), F.col("n").alias("n_triggers"), F.col("duration").alias("duration_us"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """The sentence units of every document."""
    units = sentence_units(table(spark, folder, "documents"), doc_id="doc_id", text="text", lang="lang", unit=False)
    return units.select("doc_id", F.col("start").alias("start_char"), F.col("end").alias("end_char"))


def p7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold evaluation items, with alignment score and longest exact run."""
    docs, items = table(spark, folder, "documents"), table(spark, folder, "eval_items")
    return find_leaks(docs, items, doc_id="doc_id", doc_text="text", item_id="item_id", item_text="text")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and the evaluation items they hold."""
    return p7_leaks(spark, folder).select("doc_id", "item_id")


def _mix(spark: SparkSession, folder: str, size: Column | None = None) -> Mix:
    docs = table(spark, folder, "documents")
    size = token_count(F.col("text")) if size is None else size
    return mix_sources(docs, table(spark, folder, "mix_targets"), doc_id="doc_id", source="source", size=size)


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """What each source gives to the largest mix that meets all targets, in tokens."""
    return _mix(spark, folder).report


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of that mix and how often each is used."""
    return _mix(spark, folder).selection


def p8_letters(spark: SparkSession, folder: str) -> DataFrame:
    """The same mix with sizes in characters, which SQL can count: documents and how often each is used."""
    return _mix(spark, folder, F.col("n_chars")).selection


def p8_letter_shares(spark: SparkSession, folder: str) -> DataFrame:
    """What each source gives to the mix by characters."""
    return _mix(spark, folder, F.col("n_chars")).report
