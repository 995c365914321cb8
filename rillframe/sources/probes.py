"""What probing tools print about audio and devices, as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillframe.functions.scalars import us_half_even, us_half_up


def audio_spans(packets: DataFrame) -> DataFrame:
    """First and last packet time of each recording's audio: ``first_us``, ``last_us``. Lines that aren't numbers are skipped; none at all is an error."""
    t = us_half_even(F.rtrim(F.trim("line"), F.lit(",")).try_cast("double"))
    out = packets.select("recording_id", "n", t.alias("t")).groupBy("recording_id").agg(F.min_by("t", F.when(F.col("t").isNotNull(), F.col("n"))).alias("first_us"), F.max_by("t", F.when(F.col("t").isNotNull(), F.col("n"))).alias("last_us"))
    missing = F.raise_error("no audio packets").cast("bigint")
    return out.withColumn("first_us", F.coalesce("first_us", missing))


def audio_probe(df: DataFrame) -> DataFrame:
    """Start and length of probed audio: ``start_pts_us`` and ``duration_s``.

    The start is that of the first packet, else of the stream; none is an error. The length is the
    stream's, else the file's; where a container counts from the host clock, the start is taken off it.
    """
    number = lambda c: F.nullif(F.col(c), F.lit("N/A")).try_cast("decimal(28,9)")
    start = us_half_up(F.coalesce(number("packet_pts"), number("stream_start")))
    reported = us_half_up(F.coalesce(number("stream_duration"), number("format_duration")))
    rows = df.withColumns({"__s": start, "__d": reported})
    length = F.when((F.col("__s") > 0) & (F.col("__d") >= F.col("__s")), F.col("__d") - F.col("__s")).otherwise(F.col("__d"))
    missing = F.raise_error("the audio has no start").cast("bigint")
    return rows.withColumns({"start_pts_us": F.coalesce("__s", missing), "duration_s": length / 1e6}).drop("__s", "__d")


def listed_devices(lines: DataFrame, *, by: Sequence[str], order: str, line: str, section: str) -> DataFrame:
    """Numbered entries after the line that opens a section: keys, ``index``, ``name``."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.max(F.contains(F.col(line), F.lit(section)).cast("int")).over(w), F.lit(0)) == 1
    entry = r"\[(\d+)\]\s+(.+)$"
    rows = lines.withColumn("__in", inside).where(F.col("__in") & F.col(line).rlike(entry))
    return rows.select(*by, F.regexp_extract(line, entry, 1).cast("int").alias("index"), F.regexp_extract(line, entry, 2).alias("name"))
