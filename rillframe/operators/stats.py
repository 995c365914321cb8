"""Robust and weighted statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillframe.operators.blocks import FRAMES, with_neighbours, with_running


def median_positive_delta(df: DataFrame, *, by: Sequence[str], order: Sequence[str], value: str, block: float = FRAMES) -> DataFrame:
    """Median of the positive steps of each entity: entity, ``median_delta``, ``n``; null where there are none."""
    cols = dict.fromkeys([*by, *order, value])
    rows = with_neighbours(df.select(*cols), by=by, order=order, take=[value], block=block, following=None)
    step = F.col(value) - F.col(f"__prev.{value}")
    positive = F.when(step > 0, step)
    return rows.groupBy(*by).agg(F.median(positive).alias("median_delta"), F.count(positive).alias("n"))


def median_mad(df: DataFrame, *, by: Sequence[str], value: str, above: float = 1e-6) -> DataFrame:
    """Entity, ``median``, ``mad`` and ``quality`` = 1 / (1 + 10 mad / median) of finite values over ``above``."""
    x = F.col(value).cast("double")
    rows = df.select(*by, x.alias("__x")).where(~F.isnan("__x") & (F.col("__x") > above) & (F.col("__x") < float("inf")))
    mid = rows.groupBy(*by).agg(F.median("__x").alias("median"))
    spread = rows.join(mid, list(by)).groupBy(*by).agg(F.first("median").alias("median"), F.median(F.abs(F.col("__x") - F.col("median"))).alias("mad"))
    return spread.withColumn("quality", 1 / (1 + 10 * F.col("mad") / F.col("median")))


def argmax_rows(df: DataFrame, *, by: Sequence[str], measure: Column, position: Sequence[str]) -> DataFrame:
    """The row of each entity with the greatest measure, the first of equal ones; aggregated before any shuffle."""
    row = F.struct(*df.columns)
    best = F.min_by(row, F.struct((-measure).alias("m"), *position)).alias("__r")
    return df.where(measure.isNotNull()).groupBy(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)]).agg(best).select("__r.*")


def nearest_rank(df: DataFrame, *, by: Sequence[str], value: str, fractions: Mapping[str, float], width: float) -> DataFrame:
    """Per entity the value at place floor(n * fraction), from 0, of its sorted values, cut at the last one.

    Equal values are counted before anything is sorted, and values are put in order by blocks of ``width``.
    """
    counts = df.select(*by, F.col(value).alias("__x")).dropna().groupBy(*by, "__x").agg(F.count(F.lit(1)).alias("__n"))
    total = counts.groupBy(*by).agg(F.sum("__n").alias("__all"))
    rows = with_running(counts, by=by, order=["__x"], values={"__cum": ("sum", F.col("__n"))}, block=width).join(total, list(by))
    place = lambda f: F.least(F.floor(F.col("__all") * F.lit(f)), F.col("__all") - 1)
    return rows.groupBy(*by).agg(*(F.min(F.when(F.col("__cum") > place(f), F.col("__x"))).alias(name) for name, f in fractions.items()))


def circular_mean(value: Column, period: float) -> Column:
    """Aggregate: mean of a quantity that repeats with ``period``, from -period/2 to period/2."""
    angle = value * (2 * 3.141592653589793 / period)
    return F.atan2(F.avg(F.sin(angle)), F.avg(F.cos(angle))) * (period / (2 * 3.141592653589793))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate: sum of weighted values by sum of weights; null if that is 0."""
    return F.try_divide(F.sum(value * weight), F.sum(F.when(value.isNotNull(), weight)))


def center_weight(i: Column, n: Column, edge: float = 0.3) -> Column:
    """Triangular weight of position ``i`` of ``n``: 1 in the middle, ``edge`` at the ends."""
    mid = (n - 1) / 2
    return 1 - (1 - edge) * F.abs(i - mid) / F.greatest(mid, F.lit(1e-9))


def mean_direction(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Aggregates: the mean vector brought to length 1 (a struct), and its length."""
    mx, my, mz = F.avg(x), F.avg(y), F.avg(z)
    n = F.sqrt(mx * mx + my * my + mz * mz)
    return F.struct(F.try_divide(mx, n).alias("x"), F.try_divide(my, n).alias("y"), F.try_divide(mz, n).alias("z")), n


def vector_mean(df: DataFrame, *, by: Sequence[str], vector: str) -> DataFrame:
    """Entity, ``dim`` and ``mean`` of each position of an array."""
    rows = df.select(*by, F.posexplode(vector).alias("dim", "__v"))
    return rows.groupBy(*by, "dim").agg(F.avg("__v").alias("mean"))


def balance_gains(r: Column, g: Column, b: Column, full: float = 4080) -> dict[str, Column]:
    """Aggregates: gains that bring the channel means to the greatest of them, and the share of cut samples."""
    means = [F.avg(c) for c in (r, g, b)]
    top = F.greatest(*means)
    cut = F.greatest(r, g, b) >= full
    return {"gain_r": top / means[0], "gain_g": top / means[1], "gain_b": top / means[2], "clipped": F.avg(cut.cast("double"))}


def share_above_quantile(df: DataFrame, *, by: Sequence[str], confidence: str, quantile: float, agree: Column) -> DataFrame:
    """Entity and ``fraction``: of the rows at or above their entity's quantile of confidence, those that agree."""
    limit = df.groupBy(*by).agg(F.percentile(confidence, F.lit(quantile)).alias("__q"))
    rows = df.join(limit, list(by)).where(F.col(confidence) >= F.col("__q"))
    return rows.groupBy(*by).agg(F.avg(agree.cast("double")).alias("fraction"))


def timing_summary(df: DataFrame, *, stage: str, ms: str) -> DataFrame:
    """Per stage count, least, greatest, mean, median, deviation, total, and share of the total of all."""
    out = df.groupBy(stage).agg(F.count(ms).alias("n"), F.min(ms).alias("min"), F.max(ms).alias("max"), F.avg(ms).alias("mean"), F.median(ms).alias("median"), F.stddev_pop(ms).alias("std"), F.sum(ms).alias("total"))
    return out.withColumn("share", F.col("total") / F.sum("total").over(Window.partitionBy(F.lit(1))))


def rms(r: Column) -> Column:
    """Aggregate: root of the mean square."""
    return F.sqrt(F.avg(r * r))
