"""Where a viewer's camera should stand."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rillframe.functions.geometry import vec

Z = (0.0, 0.0, 1.0)
# Where the camera stands and looks, as shares of the wearer's direction and of up, in metres; the overview's
# quantile, least reach and distance, and its direction.
EGO_BACK, EGO_AHEAD = -0.025, 1.0
FOLLOW_BACK, FOLLOW_UP = -0.75, 0.24
LOOK_AHEAD, LOOK_UP = 0.55, 0.04
OVERVIEW_QUANTILE, OVERVIEW_LEAST, OVERVIEW_FAR = 0.95, 0.75, 2.7
OVERVIEW_FROM = (1.15, -1.15, 0.85)


def _norm(v: Column) -> Column:
    n = F.greatest(F.sqrt(v["x"] * v["x"] + v["y"] * v["y"] + v["z"] * v["z"]), F.lit(1e-12))
    return vec(v["x"] / n, v["y"] / n, v["z"] / n)


def _plus(a: Column, *terms: tuple[float, Column]) -> Column:
    return vec(*(sum((k * t[c] for k, t in terms), a[c]) for c in "xyz"))


def camera_target(center: Column, forward: Column, right: Column, mode: str) -> Column:
    """``position`` and ``look_at`` behind the wearer ('follow') or in their place ('ego'); z is up.

    Looking straight up or down, the heading is that of the right hand.
    """
    up = vec(*(F.lit(v) for v in Z))
    f = _norm(forward)
    if mode == "ego":
        return F.struct(_plus(center, (EGO_BACK, f)).alias("position"), _plus(center, (EGO_AHEAD, f)).alias("look_at"))
    if mode != "follow":
        raise ValueError(f"no mode {mode}")
    flat = vec(f["x"], f["y"], F.lit(0.0))
    level = F.sqrt(flat["x"] * flat["x"] + flat["y"] * flat["y"])
    heading = _norm(F.when(level < 1e-6, vec(right["x"], right["y"], F.lit(0.0))).otherwise(flat))
    return F.struct(_plus(center, (FOLLOW_BACK, heading), (FOLLOW_UP, up)).alias("position"), _plus(center, (LOOK_AHEAD, f), (LOOK_UP, up)).alias("look_at"))


def overview_target(x: Column, y: Column, z: Column, middle: Column) -> Column:
    """Aggregate: ``position`` and ``look_at`` that frame all centres; ``middle`` is their median, found before."""
    d = F.sqrt((x - middle["x"]) * (x - middle["x"]) + (y - middle["y"]) * (y - middle["y"]) + (z - middle["z"]) * (z - middle["z"]))
    reach = F.greatest(F.percentile(d, F.lit(OVERVIEW_QUANTILE)), F.lit(OVERVIEW_LEAST)) * OVERVIEW_FAR
    n = sum(c * c for c in OVERVIEW_FROM) ** 0.5
    m = F.first(middle)
    return F.struct(vec(*(m[axis] + reach * (c / n) for axis, c in zip("xyz", OVERVIEW_FROM))).alias("position"), m.alias("look_at"))
