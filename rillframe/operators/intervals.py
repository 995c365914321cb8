"""Merging of overlapping intervals into periods, and the gaps between them.

Intervals are closed and carry integer bounds (microseconds): two that overlap, nest or share an
end point belong to one period.

The work is split by time cell, so that an entity holding a large part of all rows is spread over
many tasks. Within a cell ``session_window`` with a row-specific gap merges natively; what crosses
cell borders is settled from one summary row per cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL_US = 600_000_000
LIMIT = 1 << 57


def _duration(us: Column) -> Column:
    """A calendar interval of that many microseconds."""
    seconds = (us.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(20,0)")).cast("decimal(18,6)")
    return F.make_interval(secs=seconds)


def merge_intervals(df: DataFrame, *, entity: Sequence[str], start: str, end: str, cell_us: int = CELL_US) -> DataFrame:
    """Periods and gaps per entity: entity columns, ``kind`` ('period' or 'gap'), ``start``, ``end``.

    * Rows with a null bound, or whose end lies before their start, are void.
    * Rows with a null entity column belong to nobody and are left out; repeated rows and ties change
      nothing.
    * A point (end equal to start) is an interval; an empty table gives no rows.
    * Bounds beyond +-2^57 are void. Further columns of ``df`` are ignored.
    """
    if cell_us <= 0:
        raise ValueError("cell_us must be positive")
    keys = [f"__e{i}" for i in range(len(entity))]
    rows = df.select(*(F.col(c).alias(k) for c, k in zip(entity, keys)), F.col(start).cast("long").alias("__s"), F.col(end).cast("long").alias("__t"))
    rows = rows.dropna(subset=keys).where(F.col("__t") >= F.col("__s")).where(F.col("__s").between(-LIMIT, LIMIT) & F.col("__t").between(-LIMIT, LIMIT))
    rows = rows.withColumn("__cell", F.floor(F.col("__s") / F.lit(cell_us)))
    # Times are doubled and one is added to the length: intervals that share a point then overlap, points
    # have a length, and bounds one microsecond apart stay apart, however the window treats equal ends.
    session = F.session_window(F.timestamp_micros(F.col("__s") * 2), _duration((F.col("__t") - F.col("__s")) * 2 + 1))
    merged = rows.groupBy(*keys, "__cell", session).agg(F.min("__s").alias("__s"), F.max("__t").alias("__t")).select(*keys, "__cell", "__s", "__t")

    by_cell = Window.partitionBy(*keys, "__cell").orderBy("__s")
    over_cells = Window.partitionBy(*keys).orderBy("__cell")
    before = over_cells.rowsBetween(Window.unboundedPreceding, -1)
    carry = merged.groupBy(*keys, "__cell").agg(F.max("__t").alias("__cell_end")).select(*keys, "__cell", F.max("__cell_end").over(before).alias("__carry"))
    # A merged session opens a period unless an earlier one of its entity reaches it.
    reached = merged.join(carry, [*keys, "__cell"]).withColumn("__prev", F.greatest(F.lag("__t").over(by_cell), F.col("__carry")))
    heads = reached.where(F.col("__carry").isNull() | (F.col("__s") > F.col("__carry")))

    firsts = heads.groupBy(*keys, "__cell").agg(F.min(F.struct("__s", "__prev")).alias("__first"))
    ahead = firsts.select(*keys, "__cell", F.lead("__first").over(over_cells).alias("__after"))
    ends = merged.groupBy(*keys).agg(F.max("__t").alias("__last"))
    ahead = ahead.join(ends, list(keys))
    periods = heads.join(ahead, [*keys, "__cell"]).withColumn("__next", F.coalesce(F.lead(F.struct("__s", "__prev")).over(by_cell), F.col("__after")))
    period = F.struct(F.lit("period").alias("kind"), F.col("__s").alias("start"), F.coalesce(F.col("__next.__prev"), F.col("__last")).alias("end"))
    gap = F.struct(F.lit("gap").alias("kind"), F.col("__next.__prev").alias("start"), F.col("__next.__s").alias("end"))
    out = periods.select(*keys, F.explode(F.filter(F.array(period, gap), lambda x: x["start"].isNotNull())).alias("__p"))
    return out.select(*(F.col(k).alias(c) for c, k in zip(entity, keys)), F.col("__p.kind").alias("kind"), F.col("__p.start").alias("start"), F.col("__p.end").alias("end"))
