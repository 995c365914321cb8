"""What lies before and after a row, without sorting an entity in one task.

Rows lie by entity and block of the leading order column. Within a block a window looks around; what
comes from other blocks is carried in one summary row per block, which are the only rows that meet per
entity. ``block`` is a width of the leading order column, which must be a number; it changes how the work is
split, never the result. Rows with a null entity or leading order value are left out. The order should
be unique within an entity: of rows that tie, any may come first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FRAMES = 16_384
TIME_US = 600_000_000


def _in_blocks(df: DataFrame, by: Sequence[str], order: Sequence[str], block: float) -> DataFrame:
    return df.dropna(subset=[*by, order[0]]).withColumn("__b", F.floor(F.col(order[0]) / F.lit(block)))


def with_neighbours(df: DataFrame, *, by: Sequence[str], order: Sequence[str], take: Sequence[str], block: float, prev: str | None = "__prev", following: str | None = "__next") -> DataFrame:
    """``df`` with structs of ``take`` of the row before and the row after; null at the ends."""
    rows = _in_blocks(df, by, order, block).withColumn("__s", F.struct(*take))
    inside = Window.partitionBy(*by, "__b").orderBy(*order)
    over = Window.partitionBy(*by).orderBy("__b")
    key = F.struct(*order)
    ends = rows.groupBy(*by, "__b").agg(F.min_by("__s", key).alias("__lo"), F.max_by("__s", key).alias("__hi"))
    carried = ends.select(*by, "__b", F.lag("__hi").over(over).alias("__cp"), F.lead("__lo").over(over).alias("__cn"))
    rows = rows.join(carried, [*by, "__b"])
    if prev:
        rows = rows.withColumn(prev, F.coalesce(F.lag("__s").over(inside), F.col("__cp")))
    if following:
        rows = rows.withColumn(following, F.coalesce(F.lead("__s").over(inside), F.col("__cn")))
    return rows.drop("__b", "__s", "__cp", "__cn")


def with_running(df: DataFrame, *, by: Sequence[str], order: Sequence[str], values: Mapping[str, tuple[str, Column]], block: float, before: bool = False) -> DataFrame:
    """``df`` with running values: each a name, a kind ('sum' or 'max') and an expression.

    Up to and with each row, or only ``before`` it. A sum of nothing is 0, a maximum of nothing null.
    """
    rows = _in_blocks(df, by, order, block).withColumns({f"__v{i}": c for i, (_, c) in enumerate(values.values())})
    inside = Window.partitionBy(*by, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    over = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    make = {"sum": F.sum, "max": F.max}
    kinds = [kind for kind, _ in values.values()]
    total = rows.groupBy(*by, "__b").agg(*(make[k](f"__v{i}").alias(f"__t{i}") for i, k in enumerate(kinds)))
    carried = total.select(*by, "__b", *(make[k](f"__t{i}").over(over).alias(f"__c{i}") for i, k in enumerate(kinds)))
    rows = rows.join(carried, [*by, "__b"])
    out = {}
    for i, (name, kind) in enumerate(zip(values, kinds)):
        here, carry = make[kind](f"__v{i}").over(inside), F.col(f"__c{i}")
        out[name] = F.coalesce(here, F.lit(0)) + F.coalesce(carry, F.lit(0)) if kind == "sum" else F.greatest(here, carry)
    helpers = [f"__{x}{i}" for x in "vc" for i in range(len(kinds))]
    return rows.withColumns(out).drop("__b", *helpers)


def with_number(df: DataFrame, *, by: Sequence[str], order: Sequence[str], block: float, out: str) -> DataFrame:
    """``df`` with the number of each row of its entity, from 0."""
    return with_running(df, by=by, order=order, values={out: ("sum", F.lit(1).cast("long"))}, block=block, before=True)
