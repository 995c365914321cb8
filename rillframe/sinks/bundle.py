"""Training bundles, slices, manifests and checks of what was written."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BUNDLE_VERSION = 2


def described(df: DataFrame, notes: Mapping[str, tuple[str, str]]) -> DataFrame:
    """``df`` with description and unit in the metadata of the columns named."""
    return df.select(*(F.col(c).alias(c, metadata={"description": notes[c][0], "units": notes[c][1]}) if c in notes else F.col(c) for c in df.columns))


def filled_for_export(df: DataFrame) -> DataFrame:
    """Nulls as the bundle has them: NaN for numbers with a fraction, -1 for whole ones, false for flags."""
    put = {"double": F.lit(float("nan")), "float": F.lit(float("nan")).cast("float"), "bigint": F.lit(-1).cast("long"), "int": F.lit(-1), "boolean": F.lit(False)}
    return df.select(*(F.coalesce(F.col(c), put[t]).alias(c) if t in put else F.col(c) for c, t in df.dtypes))


def publish(df: DataFrame, path: str, *, overwrite: bool = False, partition_by: Sequence[str] = (), fmt: str = "parquet", options: Mapping[str, str] | None = None) -> None:
    """Writes beside ``path`` and renames when all is there; nothing half written is ever seen. Fails if ``path`` exists, unless told to overwrite.

    What is overwritten is moved aside first and deleted last, and put back if the new can't take its place.
    """
    spark = df.sparkSession
    fs, target, hadoop = _filesystem(spark, path)
    if fs.exists(target) and not overwrite:
        raise FileExistsError(path)
    name = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    temp, aside = hadoop.fs.Path(f"{name}.part"), hadoop.fs.Path(f"{name}.old")
    try:
        df.write.format(fmt).options(**(options or {})).partitionBy(*partition_by).save(f"{name}.part")
        moved = fs.exists(target)
        if moved and not fs.rename(target, aside):
            raise OSError(f"can't move {path} aside")
        if not fs.rename(temp, target):
            if moved:
                fs.rename(aside, target)
            raise OSError(f"can't rename to {path}")
        if moved:
            fs.delete(aside, True)
    finally:
        if fs.exists(temp):
            fs.delete(temp, True)


def _filesystem(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop
    target = hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target, hadoop


def write_bundle(tables: Mapping[str, DataFrame], path: str, notes: Mapping[str, Mapping[str, tuple[str, str]]] | None = None, *, overwrite: bool = False) -> None:
    """Each table under ``path``, then the bundle's own row with version and names, which readers look for."""
    for name, df in tables.items():
        publish(described(filled_for_export(df), (notes or {}).get(name, {})), f"{path}/{name}", overwrite=overwrite)
    spark = next(iter(tables.values())).sparkSession
    about = spark.createDataFrame([(BUNDLE_VERSION, sorted(tables))], "version int, tables array<string>")
    publish(about.withColumn("created", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")), f"{path}/bundle", overwrite=overwrite)


def read_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a bundle; ValueError if its version isn't known."""
    about = spark.read.parquet(f"{path}/bundle").first()
    if about["version"] != BUNDLE_VERSION:
        raise ValueError(f"bundle version {about['version']}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in about["tables"]}


def rewrite_csv(spark: SparkSession, source: str, target: str, keep: Column, replace: Mapping[str, Column] | None = None, *, overwrite: bool = False) -> None:
    """Rows of a CSV for which ``keep`` holds, with header; values are passed on as they are written, but for those replaced."""
    df = spark.read.option("header", True).option("inferSchema", False).option("nullValue", "\u0000").csv(source).where(keep)
    out = df.withColumns({k: v.cast("string") for k, v in (replace or {}).items()}) if replace else df
    publish(out.select(*df.columns), target, overwrite=overwrite, fmt="csv", options={"header": "true", "emptyValue": "", "quoteAll": "false"})


def append_rows(stream: DataFrame, path: str, checkpoint: str, *, fmt: str = "csv", seconds: float | None = None) -> StreamingQuery:
    """Appends a stream's rows to files under ``path`` as they come, each once, also over crashes: ``checkpoint`` remembers what is written.

    Files become visible whole. Without ``seconds`` between writes all that is there is written and the query ends.
    """
    writer = stream.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()


def write_json_lines(df: DataFrame, path: str, *, overwrite: bool = False) -> None:
    """One JSON object a line."""
    publish(df.select(F.to_json(F.struct(*df.columns)).alias("value")), path, overwrite=overwrite, fmt="text")


def chunk_manifest(manifest: Mapping, present: Sequence[str], source: Mapping) -> str:
    """A manifest for a chunk: streams that aren't there are dropped from its files and turned off, ``source`` says where it is from."""
    out = json.loads(json.dumps(manifest))
    out["files"] = {k: v for k, v in (out.get("files") or {}).items() if k in present}
    for stream in ("audio", "imu"):
        if stream in out and stream not in present and isinstance(out[stream], dict):
            out[stream]["enabled"] = False
    return json.dumps({**out, "source": dict(source)}, ensure_ascii=False, sort_keys=True)


def merge_sections(old: DataFrame, new: DataFrame, *, key: str, sections: Sequence[str]) -> DataFrame:
    """Calibrations with the sections that the new rows have, else those of the old ones."""
    a = old.select(key, *(F.col(s).alias(f"__{s}") for s in sections))
    both = a.join(new.select(key, *sections), key, "full")
    return both.select(key, *(F.coalesce(s, f"__{s}").alias(s) for s in sections))


def wrong_cuts(source: DataFrame, cut: DataFrame, chunks: DataFrame) -> DataFrame:
    """Cuts that aren't their source's packets byte for byte: recording_id, chunk, ``reason``.

    ``chunks`` has recording_id, chunk, start_frame and end_frame, which belongs to it. ``source`` has recording_id,
    frame, size, is_key; ``cut`` has recording_id, chunk and one row per packet: frame (from 0), size, is_key. Cuts of
    chunks that aren't listed are wrong, as are packets missing at either end.
    """
    keys = ["recording_id", "chunk"]
    frames = chunks.select(*keys, "start_frame", F.explode(F.sequence("start_frame", "end_frame")).alias("__f"))
    due = frames.join(source.select("recording_id", F.col("frame").alias("__f"), F.col("size").alias("__size")), ["recording_id", "__f"], "left")
    due = due.select(*keys, (F.col("__f") - F.col("start_frame")).alias("frame"), "__size", F.lit(True).alias("__due"))
    both = due.join(cut.select(*keys, "frame", "size", "is_key", F.lit(True).alias("__cut")), [*keys, "frame"], "full")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    bad = both.groupBy(*keys).agg(
        count(F.col("__cut").isNull()).alias("missing"), count(F.col("__due").isNull()).alias("extra"),
        count(F.col("__cut").isNotNull() & F.col("__due").isNotNull() & ~F.col("size").eqNullSafe(F.col("__size"))).alias("other"), F.min_by("is_key", "frame").alias("key"),
    )
    reason = F.when(F.col("missing") > 0, "packets missing").when(F.col("extra") > 0, "packets too many").when(F.col("other") > 0, "packets differ")
    reason = reason.when(~F.coalesce("key", F.lit(False)), "does not start with a key frame")
    return bad.select(*keys, reason.alias("reason")).where("reason is not null")


def run_summary(stages: Mapping[str, float], spark: SparkSession) -> DataFrame:
    """Stage times as a table with their share."""
    total = sum(stages.values()) or 1.0
    return spark.createDataFrame([(k, float(v), float(v) / total) for k, v in stages.items()], "stage string, seconds double, share double")
