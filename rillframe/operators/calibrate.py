"""Choosing views for a calibration, and its small solves."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillframe.functions import geometry as G
from rillframe.operators.folds import ordered_fold


def novel_views(df: DataFrame, *, by: Sequence[str], order: str, pose: str, shift: float, degrees: float) -> DataFrame:
    """Views with no kept view before within both thresholds: entity, ``order``. What is kept is bounded by the space of views."""
    cos = math.cos(math.radians(degrees) / 2)

    def step(kept: list, row: tuple) -> tuple[list, list[tuple]]:
        number, *p = row[-8:]
        q, t = p[:4], p[4:]
        for q2, t2 in kept:
            if math.dist(t, t2) < shift and abs(sum(a * b for a, b in zip(q, q2))) > cos:
                return kept, []
        kept.append((q, t))
        return kept, [(number,)]

    rows = df.select(*by, F.col(order).alias("__o"), *(F.col(pose)["q"][c].alias(f"__q{c}") for c in "wxyz"), *(F.col(pose)["t"][c].alias(f"__t{c}") for c in "xyz")).dropna()
    types = dict(rows.dtypes)
    return ordered_fold(rows, by=by, order=["__o"], start=list, step=step, schema=", ".join([*(f"{c} {types[c]}" for c in by), f"{order} {types['__o']}"]))


def steady(by: Sequence[str], order: str, pose: str, shift: float = 0.004, degrees: float = 0.7) -> Column:
    """Whether a view has hardly moved since the one before; not if there is none, or it was lost."""
    before = F.lag(pose).over(Window.partitionBy(*by).orderBy(order))
    here = F.col(pose)
    d = F.sqrt(sum(((here["t"][c] - before["t"][c]) * (here["t"][c] - before["t"][c]) for c in "xyz"), F.lit(0.0)))
    return F.coalesce((d < shift) & (F.degrees(G.geodesic_angle(here["q"], before["q"])) < degrees), F.lit(False))


def sharp_enough(sharpness: Column, corners: Column, expected: Column, least: float = 0.35) -> Column:
    """Whether a view is crisp and shows enough corners: half of those expected, six at least."""
    return (sharpness >= least) & (corners >= F.greatest(F.lit(6), F.floor(expected / 2)))


def shared_corners(left: DataFrame, right: DataFrame, *, on: Sequence[str], least: int) -> DataFrame:
    """Corners that both views of a pair see, of pairs with at least ``least`` of them."""
    both = left.join(right, [*on, "corner"])
    n = F.count(F.lit(1)).over(Window.partitionBy(*on))
    return both.withColumn("__n", n).where(F.col("__n") >= least).drop("__n")


def white_refusal(clipped: Column, level: Column) -> Column:
    """Why a white measurement isn't taken; null if it is."""
    return F.when(clipped > 0.001, "clipped").when(level < 0.15, "too dark")


def white_band(clipped: Column, level: Column) -> Column:
    """Where a measurement lies."""
    return F.when(clipped > 0.001, "clipping").when(level > 0.70, "too bright").when(level < 0.40, "too dark").otherwise("ok")


def rigid_fits(df: DataFrame, *, by: Sequence[str], a: Sequence[str], b: Sequence[str]) -> DataFrame:
    """The rotation and shift that bring points ``a`` onto points ``b``: entity, nine numbers ``rotation``, three ``shift``, ``n``.

    Sums of products are added up in the cluster; only a 3x3 decomposition per entity is left for Python.
    """
    mean = [F.avg(c).alias(f"__m{k}{i}") for k, cols in enumerate((a, b)) for i, c in enumerate(cols)]
    prod = [(F.avg(F.col(x) * F.col(y))).alias(f"__p{i}{j}") for i, x in enumerate(a) for j, y in enumerate(b)]
    sums = df.dropna(subset=[*a, *b]).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *mean, *prod)
    types = dict(sums.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = part[[*by, "n"]].copy()
            rot, shift = [], []
            for r in part.to_dict("records"):
                ma, mb = (np.array([r[f"__m{k}{i}"] for i in range(3)]) for k in (0, 1))
                h = np.array([[r[f"__p{i}{j}"] for j in range(3)] for i in range(3)]) - np.outer(ma, mb)
                u, _, vt = np.linalg.svd(h)
                d = np.diag([1.0, 1.0, np.sign(np.linalg.det(vt.T @ u.T))])
                m = vt.T @ d @ u.T
                rot.append(m.reshape(-1).tolist())
                shift.append((mb - m @ ma).tolist())
            out["rotation"], out["shift"] = rot, shift
            yield out

    schema = ", ".join([*(f"{c} {types[c]}" for c in by), "n bigint, rotation array<double>, shift array<double>"])
    return sums.mapInPandas(run, schema)


def edge_contrast(image: np.ndarray, corners: np.ndarray, reach: int = 4, least: int = 8) -> np.ndarray:
    """For each corner whose surroundings have contrast, the steepest slope there as a share of it.

    Surroundings are the ``reach`` pixels on either side, as far as the image goes; they are mirrored at their
    own edges. Corners with a contrast below ``least`` are left out.
    """
    at = np.rint(corners).astype(int)
    low, high = np.maximum(at - reach, 0), np.minimum(at + reach + 1, image.shape[::-1])
    extent = high - low
    found = [np.empty(0)]
    for width, height in np.unique(extent[(extent > 0).all(axis=1)], axis=0):
        first = low[(extent == (width, height)).all(axis=1)]
        mirror = [np.abs((n - 1) - np.abs((n - 1) - np.arange(-1, n + 1))) % n for n in (width, height)]
        tiles = image[(first[:, 1, None] + mirror[1])[:, :, None], (first[:, 0, None] + mirror[0])[:, None, :]].astype(float)
        middle = tiles[:, 1:-1, 1:-1]
        contrast = middle.max(axis=(1, 2)) - middle.min(axis=(1, 2))
        across, down = tiles[:, :, 2:] - tiles[:, :, :-2], tiles[:, 2:] - tiles[:, :-2]
        slope = np.hypot(across[:, :-2] + 2 * across[:, 1:-1] + across[:, 2:], down[:, :, :-2] + 2 * down[:, :, 1:-1] + down[:, :, 2:]).max(axis=(1, 2)) / 4
        found.append(slope[contrast >= least] / contrast[contrast >= least])
    return np.concatenate(found)


def image_sharpness(df: DataFrame, *, keys: Sequence[str], image: str, width: str, corners: str) -> DataFrame:
    """Median ``edge_contrast`` at the corners of grey images held as bytes: keys, ``sharpness``; 0 where nothing has contrast."""
    types = dict(df.dtypes)

    def of(data: bytes, columns: int, places: Sequence[Sequence[float]]) -> float:
        sharp = edge_contrast(np.frombuffer(data, np.uint8).reshape(-1, columns), np.array([list(p) for p in places], float).reshape(-1, 2))
        return float(np.median(sharp)) if len(sharp) else 0.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield part[list(keys)].assign(sharpness=[of(*row) for row in zip(part[image], part[width], part[corners])])

    return df.select(*keys, image, width, corners).mapInPandas(run, ", ".join([*(f"{c} {types[c]}" for c in keys), "sharpness double"]))


def depth_overlap(pairs: DataFrame, views: DataFrame, pixels: DataFrame, *, stride: int = 4, quantile: float = 0.5, tolerance: float = 0.1) -> DataFrame:
    """How far two views' depths confirm each other: ``a``, ``b``, ``overlap``, the lesser share of both directions.

    ``pairs`` has views a and b; ``views`` has view, pose (world to camera), fx, fy, cx, cy; ``pixels`` has view, u, v,
    depth, confidence, one row per pixel. Depths count that are positive and among the more confident ones of their
    view. Of one view every ``stride``-th pixel is taken each way, placed in the world and looked up in the other.
    A pair of which one view has nothing to take gets 0.
    """
    sure = F.col("confidence").isNotNull() & ~F.isnan("confidence") & (F.abs("confidence") < float("inf"))
    solid = (F.col("depth") > 0) & (F.col("depth") < float("inf")) & ~F.isnan("depth")
    limits = pixels.where(sure).groupBy("view").agg(F.percentile("confidence", quantile).alias("limit"))
    good = pixels.where(sure & solid).join(limits, "view").where("confidence >= limit").select("view", "u", "v", "depth").join(views.withColumn("__back", G.pose_inverse(F.col("pose"))), "view")
    taken = good.where(F.pmod(F.col("u") - stride // 2, F.lit(stride)) == 0).where(F.pmod(F.col("v") - stride // 2, F.lit(stride)) == 0)
    z = F.col("depth")
    ray = G.vec((F.col("u") - F.col("cx")) / F.col("fx") * z, (F.col("v") - F.col("cy")) / F.col("fy") * z, z)
    placed = taken.select(F.col("view").alias("__from"), G.transform_point(F.col("__back"), ray).alias("__world"))

    both = pairs.select("a", "b").distinct()
    ways = both.select("a", "b", F.explode(F.array(F.struct(F.col("a").alias("__from"), F.col("b").alias("__to")), F.struct(F.col("b").alias("__from"), F.col("a").alias("__to")))).alias("w")).select("a", "b", "w.*")
    there = views.select(F.col("view").alias("__to"), F.col("pose").alias("__pose"), *(F.col(c).alias(f"__{c}") for c in ("fx", "fy", "cx", "cy")))
    seen = ways.join(placed, "__from").join(there, "__to").withColumn("__p", G.transform_point(F.col("__pose"), F.col("__world")))
    depth = F.col("__p.z")
    ahead = depth > 0
    seen = seen.withColumns({"u": F.when(ahead, F.rint(F.col("__fx") * F.col("__p.x") / depth + F.col("__cx"))).cast("long"), "v": F.when(ahead, F.rint(F.col("__fy") * F.col("__p.y") / depth + F.col("__cy"))).cast("long")})
    target = good.select(F.col("view").alias("__to"), F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), F.col("depth").alias("__d"))
    met = seen.join(target, ["__to", "u", "v"], "left")
    near = F.abs(depth - F.col("__d")) <= F.lit(tolerance) * F.greatest(F.least(depth, F.col("__d")), F.lit(1e-6))
    share = met.groupBy("a", "b", "__from").agg(F.avg(F.coalesce(near, F.lit(False)).cast("double")).alias("__share"))
    least = share.groupBy("a", "b").agg(F.when(F.count(F.lit(1)) == F.when(F.col("a") == F.col("b"), 1).otherwise(2), F.min("__share")).alias("overlap"))
    return both.join(least, ["a", "b"], "left").select("a", "b", F.coalesce("overlap", F.lit(0.0)).alias("overlap"))
