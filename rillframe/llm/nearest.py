"""Nearest record in time of the same entity, within a tolerance.

Time is cut into buckets one tolerance wide. A left record meets the right records of its entity in
its own bucket and the adjacent ones that its tolerance reaches; of those close enough the nearest is
kept. Buckets keep even an entity with a third of all rows in small pieces, and as only the smaller
side is repeated, every right record is shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Times beyond this can't be bucketed without overflow and are left out.
LIMIT = 1 << 61


def nearest_in_time(
    left: DataFrame,
    right: DataFrame,
    *,
    left_entity: Sequence[str],
    right_entity: Sequence[str],
    left_time: str,
    right_time: str,
    left_key: Sequence[str],
    right_key: Sequence[str],
    tolerance: int,
) -> DataFrame:
    """Columns: ``left_key``, then ``right_key`` (with the suffix ``_right`` where a name is taken), ``delta``.

    ``delta`` is right time less left time, in the unit of the times, which are whole numbers.

    * One row per left key with a right record at most ``tolerance`` away; others don't come out.
    * Ties go to the earlier right record, then to the smallest right key.
    * Null entities or times match nothing. Repeated rows on either side change nothing: of left rows
      that share a key, the nearest of all their matches comes out.
    * Empty tables give no rows; further columns are ignored, whatever their names.
    """
    if tolerance < 0:
        raise ValueError("tolerance must not be negative")
    if len(left_entity) != len(right_entity) or not left_entity:
        raise ValueError("both sides need the same number of entity columns")
    width = max(int(tolerance), 1)
    on = [f"__e{i}" for i in range(len(left_entity))]
    lk, rk = [f"__l{i}" for i in range(len(left_key))], [f"__r{i}" for i in range(len(right_key))]
    lrows = left.select(*(F.col(c).alias(a) for c, a in zip(left_entity, on)), F.col(left_time).cast("long").alias("__t"), *(F.col(c).alias(a) for c, a in zip(left_key, lk)))
    rrows = right.select(*(F.col(c).alias(a) for c, a in zip(right_entity, on)), F.col(right_time).cast("long").alias("__u"), *(F.col(c).alias(a) for c, a in zip(right_key, rk)))
    lrows = lrows.dropna(subset=on).where(F.col("__t").between(-LIMIT, LIMIT))
    rrows = rrows.dropna(subset=on).where(F.col("__u").between(-LIMIT, LIMIT))

    first, last = _bucket(F.col("__t") - width if tolerance else F.col("__t"), width), _bucket(F.col("__t") + width if tolerance else F.col("__t"), width)
    lrows = lrows.withColumn("__b", F.explode(F.sequence(first, last)))
    rrows = rrows.withColumn("__b", _bucket(F.col("__u"), width))
    delta = F.col("__u") - F.col("__t")
    pairs = lrows.join(rrows, [*on, "__b"]).where(F.abs(delta).between(0, tolerance))
    best = F.min(F.struct(F.abs(delta).alias("__d"), delta.alias("__delta"), *rk)).alias("__best")
    out = pairs.groupBy(*lk).agg(best)
    names = [f"{c}_right" if c in left_key else c for c in right_key]
    return out.select(*(F.col(a).alias(c) for c, a in zip(left_key, lk)), *(F.col(f"__best.{a}").alias(c) for c, a in zip(names, rk)), F.col("__best.__delta").alias("delta"))


def _bucket(t: Column, width: int) -> Column:
    """Floor division of whole numbers, exact over the whole range."""
    w = F.lit(width).cast("long")
    return F.call_function("div", t - F.pmod(t, w), w)
