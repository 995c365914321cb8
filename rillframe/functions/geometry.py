"""Rotations and rigid transforms as column expressions.

A quaternion is a struct w, x, y, z; a vector a struct x, y, z; a pose a struct q, t that maps world
points into the camera: ``p_cam = R(q) p_world + t``. Everything stays inside generated code.

An expression names its arguments several times, so results nested in each other grow fast: give them
a column of their own between steps, or ``bind`` them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

LERP_ABOVE = 0.9995


def bind(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it."""
    return F.transform(F.array(x), f)[0]


def quat(w: Column, x: Column, y: Column, z: Column) -> Column:
    """A quaternion of four numbers."""
    return F.struct(w.cast("double").alias("w"), x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))


def vec(x: Column, y: Column, z: Column) -> Column:
    """A vector of three numbers."""
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))


def pose(q: Column, t: Column) -> Column:
    """A pose of a rotation and a translation."""
    return F.struct(q.alias("q"), t.alias("t"))


def quat_norm(q: Column) -> Column:
    """Length of a quaternion."""
    return F.sqrt(q["w"] * q["w"] + q["x"] * q["x"] + q["y"] * q["y"] + q["z"] * q["z"])


def quat_normalize(q: Column) -> Column:
    """The unit quaternion; null for a zero or non-finite one."""
    n = quat_norm(q)
    ok = (n > 1e-12) & (n < 1e300)
    return F.when(ok, quat(q["w"] / n, q["x"] / n, q["y"] / n, q["z"] / n))


def quat_conjugate(q: Column) -> Column:
    """The inverse rotation of a unit quaternion."""
    return quat(q["w"], -q["x"], -q["y"], -q["z"])


def quat_multiply(a: Column, b: Column) -> Column:
    """First ``b``, then ``a``."""
    return quat(
        a["w"] * b["w"] - a["x"] * b["x"] - a["y"] * b["y"] - a["z"] * b["z"],
        a["w"] * b["x"] + a["x"] * b["w"] + a["y"] * b["z"] - a["z"] * b["y"],
        a["w"] * b["y"] - a["x"] * b["z"] + a["y"] * b["w"] + a["z"] * b["x"],
        a["w"] * b["z"] + a["x"] * b["y"] - a["y"] * b["x"] + a["z"] * b["w"],
    )


def quat_rotate(q: Column, v: Column) -> Column:
    """A vector turned by a unit quaternion."""
    tx = 2 * (q["y"] * v["z"] - q["z"] * v["y"])
    ty = 2 * (q["z"] * v["x"] - q["x"] * v["z"])
    tz = 2 * (q["x"] * v["y"] - q["y"] * v["x"])
    return vec(
        v["x"] + q["w"] * tx + (q["y"] * tz - q["z"] * ty),
        v["y"] + q["w"] * ty + (q["z"] * tx - q["x"] * tz),
        v["z"] + q["w"] * tz + (q["x"] * ty - q["y"] * tx),
    )


def quat_to_matrix(q: Column) -> Column:
    """Row-major rotation matrix of nine numbers of a unit quaternion."""
    w, x, y, z = q["w"], q["x"], q["y"], q["z"]
    one = F.lit(1.0)
    return F.array(
        one - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
        2 * (x * y + w * z), one - 2 * (x * x + z * z), 2 * (y * z - w * x),
        2 * (x * z - w * y), 2 * (y * z + w * x), one - 2 * (x * x + y * y),
    )


def matrix_to_quat(m: Column) -> Column:
    """The unit quaternion, with w >= 0, of a row-major rotation matrix; the largest component leads."""
    a, b, c, d, e, f, g, h, i = (m.getItem(k) for k in range(9))
    one = F.lit(1.0)
    sq = [one + a + e + i, one + a - e - i, one - a + e - i, one - a - e + i]
    by = [
        (sq[0], h - f, c - g, d - b),
        (h - f, sq[1], b + d, c + g),
        (c - g, b + d, sq[2], f + h),
        (d - b, c + g, f + h, sq[3]),
    ]
    most = F.greatest(*sq)
    out = quat_normalize(quat(*by[3]))
    for k in (2, 1, 0):
        out = F.when(sq[k] == most, quat_normalize(quat(*by[k]))).otherwise(out)
    s = F.when(out["w"] < 0, -1.0).otherwise(1.0)
    return quat(s * out["w"], s * out["x"], s * out["y"], s * out["z"])


def quat_from_axis_angle(v: Column) -> Column:
    """The quaternion of a rotation vector; a tiny one gives the identity to first order."""
    angle = F.sqrt(v["x"] * v["x"] + v["y"] * v["y"] + v["z"] * v["z"])
    k = F.when(angle < 1e-12, F.lit(0.5)).otherwise(F.sin(angle / 2) / angle)
    return quat(F.cos(angle / 2), k * v["x"], k * v["y"], k * v["z"])


def quat_dot(a: Column, b: Column) -> Column:
    """Inner product of two quaternions."""
    return a["w"] * b["w"] + a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def geodesic_angle(a: Column, b: Column) -> Column:
    """Angle in radians between two rotations."""
    return 2 * F.acos(F.least(F.abs(quat_dot(a, b)), F.lit(1.0)))


def slerp(a: Column, b: Column, alpha: Column) -> Column:
    """Spherical interpolation along the shorter arc; straight and normalised where the two nearly agree."""
    raw = quat_dot(a, b)
    sign = F.when(raw < 0, -1.0).otherwise(1.0)
    dot = F.least(F.abs(raw), F.lit(1.0))
    theta = F.acos(dot)
    sine = F.sin(theta)
    near = dot > LERP_ABOVE
    ka = F.when(near, 1 - alpha).otherwise(F.sin((1 - alpha) * theta) / F.when(near, F.lit(1.0)).otherwise(sine))
    kb = sign * F.when(near, alpha).otherwise(F.sin(alpha * theta) / F.when(near, F.lit(1.0)).otherwise(sine))
    return quat_normalize(quat(*(ka * a[c] + kb * b[c] for c in "wxyz")))


def lerp(a: Column, b: Column, alpha: Column) -> Column:
    """A vector on the straight line from ``a`` to ``b``."""
    return vec(*(a[c] + alpha * (b[c] - a[c]) for c in "xyz"))


def transform_point(p: Column, v: Column) -> Column:
    """A point moved by a pose."""
    r = quat_rotate(p["q"], v)
    return vec(*(r[c] + p["t"][c] for c in "xyz"))


def pose_inverse(p: Column) -> Column:
    """The inverse of a pose."""
    q = quat_conjugate(p["q"])
    r = quat_rotate(q, p["t"])
    return pose(q, vec(-r["x"], -r["y"], -r["z"]))


def pose_compose(a: Column, b: Column) -> Column:
    """First ``b``, then ``a``."""
    return pose(quat_multiply(a["q"], b["q"]), transform_point(a, b["t"]))


def pose_relative(a: Column, b: Column) -> Column:
    """The pose that leads from ``a`` to ``b``: ``b`` after the inverse of ``a``."""
    return bind(pose_inverse(a), lambda back: pose_compose(b, back))


def camera_center(p: Column) -> Column:
    """Where the camera of a world-to-camera pose stands."""
    return pose_inverse(p)["t"]


def camera_forward(p: Column) -> Column:
    """The viewing direction of a world-to-camera pose in the world."""
    return quat_rotate(quat_conjugate(p["q"]), vec(F.lit(0.0), F.lit(0.0), F.lit(1.0)))


def pose_half(p: Column) -> Column:
    """The pose half way along the screw motion to ``p``, which applied twice is ``p``."""
    unit = quat(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))

    def shifted(q: Column) -> Column:
        # (R + I) s = t
        return bind(quat_to_matrix(q), lambda m: pose(q, solve3([m.getItem(k) + F.lit(1.0 if k in (0, 4, 8) else 0.0) for k in range(9)], p["t"])))

    return bind(slerp(unit, p["q"], F.lit(0.5)), shifted)


def solve3(m: Sequence[Column], v: Column) -> Column:
    """The solution of three linear equations by cofactors; null where they are singular."""
    a, b, c, d, e, f, g, h, i = m
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    k = F.when(F.abs(det) > 1e-12, 1 / det)
    x = k * ((e * i - f * h) * v["x"] + (c * h - b * i) * v["y"] + (b * f - c * e) * v["z"])
    y = k * ((f * g - d * i) * v["x"] + (a * i - c * g) * v["y"] + (c * d - a * f) * v["z"])
    z = k * ((d * h - e * g) * v["x"] + (b * g - a * h) * v["y"] + (a * e - b * d) * v["z"])
    return vec(x, y, z)


def to_row(p: Column) -> Column:
    """A pose as an array w, x, y, z, x, y, z."""
    return F.array(*(p["q"][c] for c in "wxyz"), *(p["t"][c] for c in "xyz"))


def from_row(a: Column) -> Column:
    """A pose of an array w, x, y, z, x, y, z, its quaternion normalised; null if it is not a pose."""
    q = quat_normalize(quat(*(a.getItem(k) for k in range(4))))
    ok = (F.size(a) == 7) & q.isNotNull() & ~F.exists(a, lambda v: v.isNull() | F.isnan(v))
    return F.when(ok, pose(q, vec(*(a.getItem(k) for k in range(4, 7)))))
