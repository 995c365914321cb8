"""Camera models as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rillframe.functions.geometry import bind, vec

NEWTON_STEPS = 10


def pinhole_project(p: Column, f: Column, cx: Column, cy: Column) -> Column:
    """Pixel u, v of a point; null behind the camera."""
    ok = p["z"] > 0
    return F.when(ok, F.struct((f * p["x"] / p["z"] + cx).alias("u"), (f * p["y"] / p["z"] + cy).alias("v")))


def radial(theta: Column, k: Sequence[Column]) -> Column:
    """Distorted angle of the four-coefficient equidistant model."""
    t2 = theta * theta
    return theta * (1 + t2 * (k[0] + t2 * (k[1] + t2 * (k[2] + t2 * k[3]))))


def fisheye_project(p: Column, fx: Column, fy: Column, cx: Column, cy: Column, k: Sequence[Column]) -> Column:
    """Pixel u, v of a point under the four-coefficient equidistant model."""
    r = F.sqrt(p["x"] * p["x"] + p["y"] * p["y"])
    d = radial(F.atan2(r, p["z"]), k)
    s = F.when(r > 1e-12, d / r).otherwise(F.lit(0.0))
    return F.struct((fx * s * p["x"] + cx).alias("u"), (fy * s * p["y"] + cy).alias("v"))


def fisheye_unproject(u: Column, v: Column, fx: Column, fy: Column, cx: Column, cy: Column, k: Sequence[Column]) -> Column:
    """Unit ray of a pixel: Newton's method on the distorted angle, a fixed number of steps folded over an array."""
    x, y = (u - cx) / fx, (v - cy) / fy
    d = F.sqrt(x * x + y * y)

    def step(theta: Column, _: Column) -> Column:
        t2 = theta * theta
        slope = 1 + t2 * (3 * k[0] + t2 * (5 * k[1] + t2 * (7 * k[2] + t2 * 9 * k[3])))
        return theta - (radial(theta, k) - d) / F.when(F.abs(slope) > 1e-9, slope).otherwise(F.lit(1e-9))

    theta = F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), F.least(d, F.lit(1.5)).cast("double"), step)
    s = F.when(d > 1e-12, F.sin(theta) / d).otherwise(F.lit(1.0))
    return vec(s * x, s * y, F.cos(theta))


def triangulate(g: Column, h: Column, base: Column) -> Column:
    """Point half way between two rays at their closest: ``g`` from the origin, ``h`` from ``base``; null if parallel."""
    dot = lambda a, b: reduce(lambda s, c: s + a[c] * b[c], "yz", a["x"] * b["x"])
    a, b, c, d, e = dot(g, g), dot(g, h), dot(h, h), dot(g, base), dot(h, base)
    det = a * c - b * b
    s, t = (c * d - b * e) / det, (b * d - a * e) / det
    return F.when(F.abs(det) > 1e-8, vec(*((s * g[k] + base[k] + t * h[k]) / 2 for k in "xyz")))


def shift_to_roi(cx: Column, cy: Column, x_off: Column, y_off: Column) -> Column:
    """Principal point inside a region of interest; focal lengths and distortion stay as they are."""
    return F.struct((cx - x_off).alias("cx"), (cy - y_off).alias("cy"))


def snap_roi(offset: Column, length: Column, sensor: Column, grid: int = 16) -> Column:
    """Offset and length on the grid, clamped to the sensor."""
    size = F.least(F.greatest(F.rint(length / grid) * grid, F.lit(grid)), F.floor(sensor / grid) * grid)
    start = F.least(F.greatest(F.rint(offset / grid) * grid, F.lit(0)), sensor - size)
    return F.struct((F.floor(start / grid) * grid).cast("int").alias("offset"), size.cast("int").alias("length"))


def _unit(v: Column, least: float = 0.0) -> Column:
    """``v`` at length 1; null if it isn't longer than ``least``."""
    return bind(v, lambda b: bind(F.sqrt(b["x"] * b["x"] + b["y"] * b["y"] + b["z"] * b["z"]), lambda n: F.when(n > least, vec(b["x"] / n, b["y"] / n, b["z"] / n))))


def _across(v: Column, z: Column) -> Column:
    """What of ``v`` is at right angles to the unit vector ``z``."""
    return bind(v, lambda b: bind(b["x"] * z["x"] + b["y"] * z["y"] + b["z"] * z["z"], lambda d: vec(*(b[c] - d * z[c] for c in "xyz"))))


def aligned_axes(gaze: Column, baseline: Column) -> Column:
    """Axes ``x``, ``y``, ``z`` of a camera that looks along ``gaze`` and whose rows run along the baseline.

    Where both are parallel, rows run along the depth axis instead, as far as it is across the gaze.
    """

    def axes(z: Column, x: Column) -> Column:
        y = vec(z["y"] * x["z"] - z["z"] * x["y"], z["z"] * x["x"] - z["x"] * x["z"], z["x"] * x["y"] - z["y"] * x["x"])
        return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))

    depth = vec(F.lit(0.0), F.lit(0.0), F.lit(1.0))
    return bind(_unit(gaze), lambda z: bind(F.coalesce(_unit(_across(baseline, z), 1e-6), _unit(_across(depth, z))), lambda x: axes(z, x)))


def crop_to_fisheye(u: Column, v: Column, focal: Column, size: Column, axes: Column, fx: Column, fy: Column, cx: Column, cy: Column, k: Sequence[Column]) -> Column:
    """Pixel of the fisheye picture that a square cut-out of ``size`` pixels with these axes shows at u, v."""
    middle = (size - 1) / 2.0
    a, b = (u - middle) / focal, (v - middle) / focal
    ray = bind(axes, lambda m: vec(*(m["x"][c] * a + m["y"][c] * b + m["z"][c] for c in "xyz")))
    return bind(ray, lambda r: fisheye_project(r, fx, fy, cx, cy, k))


def box_focal(corners: Sequence[Column], gaze: Column, size: Column, scale: float = 2.2) -> Column:
    """Focal length with which a cut-out's half takes in the corners' widest ray, its angle to the gaze times half of ``scale``."""
    angle = lambda r, g: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r["x"] * g["x"] + r["y"] * g["y"] + r["z"] * g["z"])))
    widest = bind(gaze, lambda g: F.array_max(F.transform(F.array(*corners), lambda r: angle(r, g))))
    return size / 2.0 / F.tan(widest * scale / 2.0)
