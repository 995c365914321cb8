"""Pairs of near points, votes of near cells."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cells(coords: Sequence[Column], size: float) -> list[Column]:
    return [F.floor(c / F.lit(float(size))) for c in coords]


def radius_pairs(df: DataFrame, *, by: Sequence[str], point_id: str, coords: Sequence[str], radius: float, carry: Sequence[str] = ()) -> DataFrame:
    """Pairs of points of an entity at most ``radius`` apart: entity, ``a`` < ``b``, ``distance``, carried columns as ``x_a``, ``x_b``.

    Points are put in cells as wide as the radius and meet those of their own and the adjoining cells:
    one side is listed in all of them, so a pair comes out once. Made for up to three coordinates.
    """
    if not 1 <= len(coords) <= 3:
        raise ValueError("one to three coordinates")
    n = len(coords)
    base = df.select(*by, F.col(point_id).alias("__id"), *(F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(coords)), *(F.col(c).alias(f"__k{i}") for i, c in enumerate(carry))).dropna()
    xs = [F.col(f"__x{i}") for i in range(n)]
    cell = [f"__c{i}" for i in range(n)]
    left = base.select("*", *(c.alias(name) for c, name in zip(_cells(xs, radius), cell)))
    right = base.select(*by, F.col("__id").alias("__jd"), *(F.col(f"__x{i}").alias(f"__y{i}") for i in range(n)), *(F.col(f"__k{i}").alias(f"__m{i}") for i in range(len(carry))))
    ys = [F.col(f"__y{i}") for i in range(n)]
    for i, c in enumerate(_cells(ys, radius)):
        right = right.withColumn(cell[i], F.explode(F.array(*(c + d for d in (-1, 0, 1)))))
    near = left.join(right, [*by, *cell]).where("__id < __jd")
    square = sum(((x - y) * (x - y) for x, y in zip(xs, ys)), F.lit(0.0))
    near = near.withColumn("distance", F.sqrt(square)).where(F.col("distance") <= radius)
    return near.select(*by, F.col("__id").alias("a"), F.col("__jd").alias("b"), "distance", *(F.col(f"__k{i}").alias(f"{c}_a") for i, c in enumerate(carry)), *(F.col(f"__m{i}").alias(f"{c}_b") for i, c in enumerate(carry)))


#: So many queries are sent to all points at once.
HELD_QUERIES = 20_000


def block_pairs(df: DataFrame, queries: DataFrame, *, point_id: str, query_id: str, vector: str, radius: float) -> DataFrame:
    """Points at most ``radius`` from each of a stated set of queries, in any number of dimensions: ``query``, ``point``, ``distance``.

    Every query meets every point. The queries are the stated side: HELD_QUERIES of them at a time are sent to all
    points, which are read once for each such block. Null vectors match nothing.
    """
    q = queries.select(F.col(query_id).alias("query"), F.col(vector).alias("__q")).dropna()
    p = df.select(F.col(point_id).alias("point"), F.col(vector).alias("__p")).dropna()
    square = F.aggregate(F.zip_with("__q", "__p", lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, v: s + v)
    blocks = max(1, -(-q.count() // HELD_QUERIES))
    part = lambda k: q.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == k)
    rows = reduce(DataFrame.unionByName, [p.crossJoin(F.broadcast(part(k))) for k in range(blocks)])
    rows = rows.where(F.col("query") != F.col("point")).withColumn("distance", F.sqrt(square))
    return rows.where(F.col("distance") <= radius).select("query", "point", "distance")


def vote_density(df: DataFrame, *, by: Sequence[str], a: str, b: str, radius: int, least: int) -> DataFrame:
    """Per distinct cell (a, b) the cells within ``radius`` in both directions: entity, a, b, ``n_votes``, least and greatest a and b.

    Cells with fewer than ``least`` votes, their own included, are left out.
    """
    cells = df.select(*by, F.col(a).alias("__a"), F.col(b).alias("__b")).dropna().groupBy(*by, "__a", "__b").agg(F.count(F.lit(1)).alias("__n"))
    tile = max(int(radius), 1)
    at = lambda c: F.floor(F.col(c) / F.lit(tile))
    left = cells.select(*by, "__a", "__b", at("__a").alias("__u"), at("__b").alias("__v"))
    right = cells.select(*by, F.col("__a").alias("__x"), F.col("__b").alias("__y"), F.col("__n"), at("__a").alias("__u"), at("__b").alias("__v"))
    for c in ("__u", "__v"):
        right = right.withColumn(c, F.explode(F.array(*(F.col(c) + d for d in (-1, 0, 1)))))
    near = left.join(right, [*by, "__u", "__v"]).where((F.abs(F.col("__a") - F.col("__x")) <= radius) & (F.abs(F.col("__b") - F.col("__y")) <= radius))
    out = near.groupBy(*by, "__a", "__b").agg(F.sum("__n").alias("n_votes"), F.min("__x").alias("min_a"), F.max("__x").alias("max_a"), F.min("__y").alias("min_b"), F.max("__y").alias("max_b"))
    return out.where(F.col("n_votes") >= least).select(*by, F.col("__a").alias(a), F.col("__b").alias(b), "n_votes", "min_a", "max_a", "min_b", "max_b")


def same_view(dot: Column, degrees: float) -> Column:
    """Whether two unit directions with this inner product lie within an angle."""
    return dot >= math.cos(math.radians(degrees))
