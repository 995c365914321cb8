"""Rotations integrated, poses chained, values smoothed: folds that don't commute."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillframe.functions import geometry as G
from rillframe.kernels.exposure import Metering
from rillframe.operators.asof import interpolate
from rillframe.operators.folds import ordered_fold


def _multiply(a: Sequence[float], b: Sequence[float]) -> tuple[float, float, float, float]:
    return (
        a[0] * b[0] - a[1] * b[1] - a[2] * b[2] - a[3] * b[3],
        a[0] * b[1] + a[1] * b[0] + a[2] * b[3] - a[3] * b[2],
        a[0] * b[2] - a[1] * b[3] + a[2] * b[0] + a[3] * b[1],
        a[0] * b[3] + a[1] * b[2] - a[2] * b[1] + a[3] * b[0],
    )


def quat_product(df: DataFrame, *, by: Sequence[str], order: Sequence[str], quat: str) -> DataFrame:
    """Product of an entity's rotations in order, normalised at each step: entity, ``n``, ``w``, ``x``, ``y``, ``z``.

    A null rotation makes the whole product null.
    """

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        n, q = state
        r = row[-4:]
        if q is None or any(v is None or v != v for v in r):
            return (n + 1, None), []
        q = _multiply(q, r)
        size = math.sqrt(sum(v * v for v in q))
        return (n + 1, tuple(v / size for v in q) if size > 0 else None), []

    def finish(state: tuple) -> list[tuple]:
        n, q = state
        return [(n, *(q or (None,) * 4))]

    rows = df.select(*by, *order, *(F.col(quat)[c].alias(f"__{c}") for c in "wxyz"))
    types = dict(rows.dtypes)
    schema = ", ".join([*(f"{c} {types[c]}" for c in by), "n bigint, w double, x double, y double, z double"])
    return ordered_fold(rows, by=by, order=order, start=lambda: (0, (1.0, 0.0, 0.0, 0.0)), step=step, schema=schema, finish=finish)


def relative_rotations(frames: DataFrame, gyro: DataFrame, *, by: Sequence[str], frame: str, frame_time: str, gyro_time: str, rates: Sequence[str], longest_us: int = 200_000) -> DataFrame:
    """Rotation from each frame to the next by the trapezoid of the angular rates: entity, ``frame``, ``rotation``, ``n_steps``, ``valid``.

    The rates at the two frame times are interpolated, those of readings strictly between are taken as
    they are. Steps over more than ``longest_us`` without reading, and frames that don't advance, are
    not valid. Readings and frames of an entity are taken in one ordered pass.
    """
    at = interpolate(frames.select(*by, frame, frame_time), gyro, by=by, left_time=frame_time, right_time=gyro_time, values=rates)
    marks = at.select(*by, F.col(frame_time).cast("long").alias("__t"), F.col(frame).cast("long").alias("__f"), *rates)
    reads = gyro.select(*by, F.col(gyro_time).cast("long").alias("__t"), F.lit(None).cast("long").alias("__f"), *rates).dropna(subset=[*by, "__t", *rates])
    rows = reads.unionByName(marks).select(*by, "__t", "__f", *rates)

    def step(state: tuple | None, row: tuple) -> tuple[tuple | None, list[tuple]]:
        t, f, *w = row[-5:]
        mark = f is not None and f == f
        if any(v is None or v != v for v in w):
            return (None if mark else state), []
        out = []
        if state is not None:
            frame0, time0, rate0, q, n, good = state
            dt = (t - time0) / 1e6
            if dt > 0:
                v = [(a + b) / 2 * dt for a, b in zip(rate0, w)]
                angle = math.sqrt(sum(x * x for x in v))
                k = math.sin(angle / 2) / angle if angle > 1e-12 else 0.5
                q = _multiply(q, (math.cos(angle / 2), *(k * x for x in v)))
                n += 1
                good = good and t - time0 <= longest_us
            state = (frame0, t, w, q, n, good)
            if mark:
                out.append((frame0, *q, n, bool(good and n > 0)))
        if mark:
            state = (int(f), t, w, (1.0, 0.0, 0.0, 0.0), 0, True)
        return state, out

    types = dict(rows.dtypes)
    schema = ", ".join([*(f"{c} {types[c]}" for c in by), f"{frame} bigint, qw double, qx double, qy double, qz double, n_steps bigint, valid boolean"])
    out = ordered_fold(rows, by=by, order=["__t", "__f"], start=lambda: None, step=step, schema=schema)
    return out.select(*by, frame, G.quat(F.col("qw"), F.col("qx"), F.col("qy"), F.col("qz")).alias("rotation"), "n_steps", "valid")


def chain_poses(df: DataFrame, *, by: Sequence[str], order: str, pose: str) -> DataFrame:
    """Poses reached by applying an entity's relative poses one after the other: entity, ``order``, ``pose``."""

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        number, *p = row[-8:]
        q, t = state
        w, x, y, z = p[:4]
        ux, uy, uz = t
        tx, ty, tz = 2 * (y * uz - z * uy), 2 * (z * ux - x * uz), 2 * (x * uy - y * ux)
        moved = (ux + w * tx + y * tz - z * ty + p[4], uy + w * ty + z * tx - x * tz + p[5], uz + w * tz + x * ty - y * tx + p[6])
        q = _multiply(p[:4], q)
        return (q, moved), [(number, *q, *moved)]

    rows = df.select(*by, F.col(order).alias("__o"), *(F.col(pose)["q"][c].alias(f"__q{c}") for c in "wxyz"), *(F.col(pose)["t"][c].alias(f"__t{c}") for c in "xyz")).dropna()
    types = dict(rows.dtypes)
    names = ["w", "x", "y", "z", "tx", "ty", "tz"]
    schema = ", ".join([*(f"{c} {types[c]}" for c in by), f"{order} {types['__o']}", *(f"{n} double" for n in names)])
    out = ordered_fold(rows, by=by, order=["__o"], start=lambda: ((1.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0)), step=step, schema=schema)
    return out.select(*by, order, G.pose(G.quat(*(F.col(c) for c in names[:4])), G.vec(*(F.col(c) for c in names[4:]))).alias("pose"))


def smooth_both_ways(df: DataFrame, *, by: Sequence[str], time: str, value: str, tau: float, out: str = "smooth", block_s: float | None = None) -> DataFrame:
    """Mean of a forward and a backward exponential average with time constant ``tau`` (seconds; ``time`` in microseconds).

    The influence of a value has faded to e^-40 after 40 time constants, so entities are handled in
    blocks of time with a halo that wide and agree with one pass to double precision.
    """
    halo = int(40 * tau * 1e6)
    block = int((block_s or max(600.0, 400 * tau)) * 1e6)
    t = F.col(time).cast("long")
    rows = df.select(*by, t.alias("__t"), F.col(value).cast("double").alias("__v")).dropna()
    rows = rows.withColumn("__own", F.floor(F.col("__t") / F.lit(block)))
    rows = rows.withColumn("__b", F.explode(F.sequence(F.floor((F.col("__t") - halo) / F.lit(block)), F.floor((F.col("__t") + halo) / F.lit(block)))))
    types = dict(rows.dtypes)
    schema = ", ".join([*(f"{c} {types[c]}" for c in by), f"{time} bigint", f"{value} double", f"{out} double"])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["__t", "__v"], kind="stable")
        ts, v = part["__t"].to_numpy(np.int64), part["__v"].to_numpy(float)
        alpha = 1 - np.exp(-np.diff(ts) / 1e6 / tau)
        f, b = v.copy(), v.copy()
        for k in range(1, len(v)):
            f[k] = f[k - 1] + alpha[k - 1] * (v[k] - f[k - 1])
        for k in range(len(v) - 2, -1, -1):
            b[k] = b[k + 1] + alpha[k] * (v[k] - b[k + 1])
        here = part["__own"].to_numpy() == part["__b"].iloc[0]
        res = part[list(by)].copy()
        res[time], res[value], res[out] = ts, v, (f + b) / 2
        return res[here]

    return rows.groupBy(*by, "__b").applyInPandas(run, schema)


def exposure_steps(df: DataFrame, *, by: Sequence[str], order: Sequence[str], level: str, metering: Metering | None = None) -> DataFrame:
    """A controller that follows metered levels: entity, ``step``, ``exposure``, ``gain`` after each.

    Null and NaN levels change nothing. Each step depends on the one before, so an entity is one pass.
    """
    m = metering or Metering()

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        n, exposure, gain = state
        exposure, gain = m.follow(row[-1], exposure, gain)
        return (n + 1, exposure, gain), [(n, exposure, gain)]

    rows = df.select(*by, *order, F.col(level).cast("double").alias("__level"))
    types = dict(rows.dtypes)
    schema = ", ".join([*(f"{c} {types[c]}" for c in by), "step bigint, exposure double, gain double"])
    return ordered_fold(rows, by=by, order=order, start=lambda: (0, *m.first), step=step, schema=schema)
