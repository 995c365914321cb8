"""Runs of identical or near-identical consecutive events.

An event differs from its predecessor, or starts too long after the run so far ends: both are flagged
by comparison with what precedes, flags delimit runs, and runs are aggregated.

What precedes is found inside time blocks, so that an entity with a third of all rows is not sorted
in one task. Per block one summary row (last label, end of the trailing run of equal labels, last
flagged event) is carried to the following blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_US = 600_000_000


def collapse_runs(df: DataFrame, *, entity: Sequence[str], start: str, end: str, event_id: str, label: str, max_gap: int, block: int = BLOCK_US) -> DataFrame:
    """Columns: entity, ``first_event``, ``label``, ``n``, ``start``, ``end``, ``duration``; one row per run.

    Events of an entity are ordered by ``start``, then ``event_id``. An event continues the run before
    it if it has the same label and starts less than ``max_gap`` after the latest end in that run.

    * Rows with a null entity, start or id are left out. A null end, or one before the start, counts as
      the start. Null labels equal each other only.
    * Repeated rows (same entity, start and id) count once: the latest end and the smallest label hold.
    * Empty tables give no rows; further columns are ignored.
    """
    keys = [f"__e{i}" for i in range(len(entity))]
    rows = df.select(*(F.col(c).alias(k) for c, k in zip(entity, keys)), F.col(start).cast("long").alias("__s"), F.col(end).cast("long").alias("__t"), F.col(event_id).alias("__id"), F.col(label).alias("__x"))
    rows = rows.dropna(subset=[*keys, "__s", "__id"]).withColumn("__t", F.greatest("__s", "__t")).withColumn("__b", F.floor(F.col("__s") / F.lit(block)))
    # Rows lie by entity and block from here on; what is grouped or sorted within a block moves nothing.
    rows = rows.repartition(*keys, "__b").groupBy(*keys, "__b", "__s", "__id").agg(F.max("__t").alias("__t"), F.min("__x").alias("__x"))

    order = ["__s", "__id"]
    inside = Window.partitionBy(*keys, "__b").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"__n": F.row_number().over(inside), "__px": F.lag(F.struct("__x")).over(inside)})
    change = (F.col("__n") > 1) & ~F.col("__x").eqNullSafe(F.col("__px.__x"))
    rows = rows.withColumn("__stretch", F.sum(change.cast("int")).over(upto))
    same = Window.partitionBy(*keys, "__b", "__stretch").orderBy(*order)
    rows = rows.withColumn("__reach", F.max("__t").over(same.rowsBetween(Window.unboundedPreceding, -1)))

    # Per block: its first and last label, whether it holds one label only, and how far its last stretch reaches.
    tail = F.max(F.struct("__stretch", "__t")).alias("__tail")
    summary = rows.groupBy(*keys, "__b").agg(F.min(F.struct("__n", "__x")).alias("__head"), F.max(F.struct("__n", "__x")).alias("__foot"), tail)
    over = Window.partitionBy(*keys).orderBy("__b")
    prev = F.lag("__foot").over(over)
    joins = (F.col("__tail.__stretch") == 0) & prev.isNotNull() & F.col("__head.__x").eqNullSafe(prev["__x"])
    summary = summary.withColumn("__chain", F.sum((~F.coalesce(joins, F.lit(False))).cast("int")).over(over))
    chain = Window.partitionBy(*keys, "__chain").orderBy("__b")
    summary = summary.withColumn("__trail", F.max("__tail.__t").over(chain.rowsBetween(Window.unboundedPreceding, 0)))
    carried = summary.select(*keys, "__b", F.lag(F.struct(F.col("__foot.__x").alias("x"), F.col("__trail").alias("t"))).over(over).alias("__carry"))

    rows = rows.join(carried, [*keys, "__b"])
    continues = (F.col("__stretch") == 0) & F.col("__carry").isNotNull() & F.col("__x").eqNullSafe(F.col("__carry.x"))
    reach = F.when(continues, F.greatest("__reach", "__carry.t")).otherwise(F.col("__reach"))
    rows = rows.withColumn("__new", reach.isNull() | (F.col("__s") - reach >= F.lit(max_gap)))
    rows = rows.withColumn("__run", F.last(F.when(F.col("__new"), F.struct("__s", "__id")), ignorenulls=True).over(upto))
    latest = rows.groupBy(*keys, "__b").agg(F.max(F.when(F.col("__new"), F.struct("__s", "__id"))).alias("__latest"))
    latest = latest.select(*keys, "__b", F.last("__latest", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("__open"))
    rows = rows.join(latest, [*keys, "__b"]).withColumn("__run", F.coalesce("__run", "__open"))

    runs = rows.groupBy(*keys, "__run").agg(F.count(F.lit(1)).alias("n"), F.max("__t").alias("end"), F.min("__x").alias("label"))
    return runs.select(*(F.col(k).alias(c) for c, k in zip(entity, keys)), F.col("__run.__id").alias("first_event"), "label", "n", F.col("__run.__s").alias("start"), "end", (F.col("end") - F.col("__run.__s")).alias("duration"))
