"""Joins on time: as-of, interpolation, interval windows and ranges.

No entity is handled in one piece. Rows lie by entity and time block; what a block lacks of its
neighbours comes from one summary row per block, or, for windows of known width, from a halo.
Times are whole numbers. Rows with a null entity or time match nothing; of right rows with equal entity
and time the smallest (by the order of the columns taken along) counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 600_000_000


def _floor_div(t: Column, width: int) -> Column:
    w = F.lit(width).cast("long")
    return F.call_function("div", t - F.pmod(t, w), w)


def neighbours(left: DataFrame, right: DataFrame, *, by: Sequence[str], left_time: str, right_time: str, take: Sequence[str], block: int = BLOCK) -> DataFrame:
    """All of ``left`` with ``prev`` and ``next``: structs of ``at`` (the right time) and ``take``.

    ``prev`` is the last right row not after the left one, ``next`` the first not before it; either is
    null where there is none.
    """
    keys = [f"__e{i}" for i in range(len(by))]
    payload = F.struct(*(F.col(c) for c in left.columns)).alias("__l")
    lrows = left.select(*(F.col(c).alias(k) for c, k in zip(by, keys)), F.col(left_time).cast("long").alias("__t"), payload)
    rrows = right.select(*(F.col(c).alias(k) for c, k in zip(by, keys)), F.col(right_time).cast("long").alias("__t"), F.struct(F.col(right_time).cast("long").alias("at"), *(F.col(c) for c in take)).alias("__r")).dropna(subset=[*keys, "__t"])
    lrows = lrows.withColumn("__b", _floor_div(F.col("__t"), block))
    rrows = rrows.withColumn("__b", _floor_div(F.col("__t"), block))
    slim = rrows.repartition(*keys, "__b").groupBy(*keys, "__b", "__t").agg(F.min("__r").alias("__r"))

    both = lrows.select(*keys, "__b", "__t", "__l").unionByName(slim, allowMissingColumns=True)
    # What follows is looked for in falling order: a frame that grows is read once, one that shrinks again and again.
    back, ahead = (Window.partitionBy(*keys, "__b").orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.asc("__t"), F.desc("__t")))
    both = both.withColumns({"__p": F.last("__r", ignorenulls=True).over(back), "__n": F.last("__r", ignorenulls=True).over(ahead)}).where("__l is not null")

    ends = slim.groupBy(*keys, "__b").agg(F.max("__r").alias("__hi"), F.min("__r").alias("__lo"))
    blocks = lrows.select(*keys, "__b").dropna().distinct()
    summary = blocks.join(ends, [*keys, "__b"], "full")
    before, after = (Window.partitionBy(*keys).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("__b"), F.desc("__b")))
    carried = summary.select(*keys, "__b", F.last("__hi", ignorenulls=True).over(before).alias("__cp"), F.last("__lo", ignorenulls=True).over(after).alias("__cn"))
    out = both.join(carried, [*keys, "__b"], "left")
    known = F.col("__t").isNotNull()
    return out.select("__l.*", F.when(known, F.coalesce("__p", "__cp")).alias("prev"), F.when(known, F.coalesce("__n", "__cn")).alias("next"))


def asof(left: DataFrame, right: DataFrame, *, by: Sequence[str], left_time: str, right_time: str, take: Sequence[str], direction: str = "backward", tolerance: int | None = None, out: str = "match", block: int = BLOCK) -> DataFrame:
    """All of ``left`` with the struct ``out`` of the right row: 'backward', 'forward' or 'nearest'.

    Equally near rows go to the earlier one. Beyond ``tolerance`` there is no match.
    """
    rows = neighbours(left, right, by=by, left_time=left_time, right_time=right_time, take=take, block=block)
    t = F.col(left_time).cast("long")
    before, after = t - F.col("prev.at"), F.col("next.at") - t
    if direction == "backward":
        best = F.col("prev")
    elif direction == "forward":
        best = F.col("next")
    elif direction == "nearest":
        best = F.when(F.col("prev").isNull() | (after < before), F.col("next")).otherwise(F.col("prev"))
    else:
        raise ValueError(f"no direction {direction}")
    rows = rows.withColumn(out, best)
    if tolerance is not None:
        rows = rows.withColumn(out, F.when(F.abs(F.col(f"{out}.at") - t) <= tolerance, F.col(out)))
    return rows.drop("prev", "next")


def at_or_after_else_last(left: DataFrame, right: DataFrame, *, by: Sequence[str], left_time: str, right_time: str, take: Sequence[str], out: str = "match") -> DataFrame:
    """The right row at the time, else the next one, else the last one."""
    rows = neighbours(left, right, by=by, left_time=left_time, right_time=right_time, take=take)
    return rows.withColumn(out, F.coalesce("next", "prev")).drop("prev", "next")


def interpolate(left: DataFrame, right: DataFrame, *, by: Sequence[str], left_time: str, right_time: str, values: Sequence[str]) -> DataFrame:
    """All of ``left`` with ``values`` on the straight line between the right rows around; held beyond the ends."""
    rows = neighbours(left, right, by=by, left_time=left_time, right_time=right_time, take=values)
    span = F.col("next.at") - F.col("prev.at")
    alpha = F.when(span > 0, (F.col(left_time) - F.col("prev.at")) / span).otherwise(F.lit(0.0))
    cols = {v: F.coalesce(F.col(f"prev.{v}") + alpha * (F.col(f"next.{v}") - F.col(f"prev.{v}")), F.when(F.col("next").isNull(), F.col(f"prev.{v}")).when(F.col("prev").isNull(), F.col(f"next.{v}"))) for v in values}
    return rows.withColumns(cols).drop("prev", "next")


def interval_window(left: DataFrame, right: DataFrame, *, by: Sequence[str], left_time: str, right_time: str, half: int, aggs: dict[str, Column]) -> DataFrame:
    """All of ``left`` with ``aggs`` over the right rows at most ``half`` away, both ends included.

    ``aggs`` are aggregate expressions of right columns; without a right row they are what they are of none.
    """
    if half < 0:
        raise ValueError("half must not be negative")
    width = max(BLOCK, 4 * half)
    keys = [f"__e{i}" for i in range(len(by))]
    cols = [c for c in right.columns if c not in by]
    rrows = right.select(*(F.col(c).alias(k) for c, k in zip(by, keys)), F.col(right_time).cast("long").alias("__t"), *cols, F.lit(True).alias("__right"), F.lit(None).cast("long").alias("__own")).dropna(subset=[*keys, "__t"])
    rrows = rrows.withColumn("__b", F.explode(F.sequence(_floor_div(F.col("__t") - half, width), _floor_div(F.col("__t") + half, width))))
    payload = F.struct(*(F.col(c) for c in left.columns)).alias("__l")
    lrows = left.select(*(F.col(c).alias(k) for c, k in zip(by, keys)), F.col(left_time).cast("long").alias("__t"), payload, F.lit(False).alias("__right"), _floor_div(F.col(left_time).cast("long"), width).alias("__b"))
    both = lrows.unionByName(rrows, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "__b").orderBy("__t").rangeBetween(-half, half)
    out = both.withColumns({name: agg.over(w) for name, agg in aggs.items()}).where(~F.col("__right"))
    return out.select("__l.*", *aggs)


def range_join(points: DataFrame, intervals: DataFrame, *, by: Sequence[str], time: str, start: str, end: str, take: Sequence[str], width: int = 60_000_000) -> DataFrame:
    """Points paired with every interval of their entity that holds them, both ends included; ``take`` from the interval.

    Intervals are listed by the time cells they touch and joined on entity and cell, so no entity's
    points meet all of its intervals. Open or reversed intervals hold nothing.
    """
    clash = [c for c in take if c in points.columns]
    if clash:
        raise ValueError(f"both sides have {clash}")
    cells = intervals.select(*by, F.col(start).cast("long").alias("__s"), F.col(end).cast("long").alias("__t"), *take).where("__t >= __s")
    cells = cells.withColumn("__c", F.explode(F.sequence(_floor_div(F.col("__s"), width), _floor_div(F.col("__t"), width))))
    rows = points.withColumn("__c", _floor_div(F.col(time).cast("long"), width)).join(cells, [*by, "__c"])
    return rows.where(F.col(time).between(F.col("__s"), F.col("__t"))).drop("__c", "__s", "__t")


def strict_lookup(left: DataFrame, right: DataFrame, on: Sequence[str], preview: int = 10) -> DataFrame:
    """An inner join that fails, naming some keys, if any key of ``left`` is missing in ``right``."""
    missing = [tuple(r) for r in left.select(*on).join(right.select(*on), list(on), "left_anti").distinct().limit(preview).collect()]
    if missing:
        raise LookupError(f"missing keys: {missing}")
    return left.join(right, list(on))
