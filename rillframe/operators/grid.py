"""Irregular readings onto a regular time grid.

Slots are ``floor(time / width)``. Every slot between an entity's first and last reading comes out
once, with the mean of its complete readings, or the value carried forward, or marked missing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_SLOTS = 4096
LIMIT_US = 1 << 61


def finite(c: Column) -> Column:
    """True where a number is neither null, NaN nor infinite."""
    x = c.cast("double")
    return c.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def usable(c: Column) -> Column:
    """True where a value is neither null nor NaN."""
    return c.isNotNull() & ~F.isnan(c.cast("double"))


def seconds_to_us(c: Column) -> Column:
    """Whole microseconds of a time in seconds, rounded down; null where it isn't finite or beyond the range of such numbers."""
    us = F.floor(c * F.lit(1e6))
    return F.when(finite(c) & (F.abs(c) < F.lit(9.2e12)), us)


def regular_grid(df: DataFrame, *, entity: Sequence[str], time_us: Column, values: Sequence[str], width_us: int, max_gap_us: int, block_slots: int = BLOCK_SLOTS) -> DataFrame:
    """Columns: entity, ``slot``, ``status`` ('observed', 'filled' or 'missing'), ``n``, then ``values``.

    * A reading counts as complete if each of ``values`` is neither null nor NaN; the slot's value is
      their mean.
    * A slot without complete reading takes the last observed slot's values if that lies at most
      ``max_gap_us`` back, counted in slots; otherwise it is 'missing' with null values.
    * Readings without a time are ignored; those with a time but incomplete still extend the range.
    * Repeated rows change no slot's status, but weigh twice in a mean unless removed before.
    * Readings with a null entity column belong to no series and are left out; an empty table gives no
      rows; further columns are ignored.
    """
    if width_us <= 0 or block_slots <= 0:
        raise ValueError("width_us and block_slots must be positive")
    keys, cols = [f"__e{i}" for i in range(len(entity))], [f"__v{i}" for i in range(len(values))]
    rows = df.select(*(F.col(c).alias(k) for c, k in zip(entity, keys)), time_us.cast("long").alias("__t"), *(F.col(c).cast("double").alias(v) for c, v in zip(values, cols)))
    rows = rows.dropna(subset=keys).where(F.col("__t").between(-LIMIT_US, LIMIT_US)).withColumn("__slot", F.floor(F.col("__t") / F.lit(width_us))).withColumn("__block", F.floor(F.col("__slot") / F.lit(block_slots)))
    complete = F.lit(True)
    for v in cols:
        complete = complete & usable(F.col(v))
    # Partial sums are made before the shuffle, by slot; the slots of one entity then lie in many tasks.
    slots = rows.groupBy(*keys, "__block", "__slot").agg(F.count(F.when(complete, 1)).alias("__n"), *(F.avg(F.when(complete, F.col(v))).alias(v) for v in cols))

    span = slots.groupBy(*keys).agg(F.min("__slot").alias("__lo"), F.max("__slot").alias("__hi"))
    blocks = span.withColumn("__block", F.explode(F.sequence(F.floor(F.col("__lo") / F.lit(block_slots)), F.floor(F.col("__hi") / F.lit(block_slots)))))
    first = F.greatest(F.col("__lo"), F.col("__block") * block_slots)
    last = F.least(F.col("__hi"), F.col("__block") * block_slots + (block_slots - 1))
    # Only block numbers are listed per entity; the slots of a block are listed where the block ends up.
    grid = blocks.repartition(*keys, "__block").select(*keys, "__block", F.explode(F.sequence(first, last)).alias("__slot"))
    joined = grid.join(slots, [*keys, "__block", "__slot"], "left")

    observed = F.col("__n") > 0
    seen = F.when(observed, F.struct("__slot", *cols))
    in_block = Window.partitionBy(*keys, "__block").orderBy("__slot").rowsBetween(Window.unboundedPreceding, 0)
    tails = slots.where(observed).groupBy(*keys, "__block").agg(F.max(F.struct("__slot", *cols)).alias("__tail"))
    tails = blocks.select(*keys, "__block").join(tails, [*keys, "__block"], "left")
    over_blocks = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carry = tails.select(*keys, "__block", F.last("__tail", ignorenulls=True).over(over_blocks).alias("__carry"))
    full = joined.join(carry, [*keys, "__block"], "left")
    full = full.withColumn("__last", F.coalesce(F.last(seen, ignorenulls=True).over(in_block), F.col("__carry")))

    near = (F.col("__slot") - F.col("__last.__slot")) <= F.lit(max_gap_us // width_us)
    status = F.when(observed, "observed").when(near, "filled").otherwise("missing")
    return full.select(
        *(F.col(k).alias(c) for c, k in zip(entity, keys)),
        F.col("__slot").alias("slot"),
        status.alias("status"),
        F.coalesce(F.col("__n"), F.lit(0)).alias("n"),
        *(F.when(status != "missing", F.col(f"__last.{v}")).alias(c) for c, v in zip(values, cols)),
    )
