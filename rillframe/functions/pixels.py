"""Pixels: unpacking, white balance and tone curves."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FULL = 4095


def unpack12(data: Column) -> Column:
    """Samples of packed 12-bit data: two samples in three bytes, as an array of integers.

    The first sample has the first byte above the low half of the second byte, the other one the third
    byte above its high half. Bytes beyond the last whole group of three are ignored; null gives null.
    """
    byte = lambda k: F.conv(F.hex(F.substring(data, k, 1)), 16, 10).cast("int")
    groups = F.floor(F.length(data) / 3).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(1), F.greatest(groups, F.lit(1))),
        lambda g: F.array(
            F.shiftleft(byte((g - 1) * 3 + 1), 4).bitwiseOR(byte((g - 1) * 3 + 2).bitwiseAND(15)),
            F.shiftleft(byte((g - 1) * 3 + 3), 4).bitwiseOR(F.shiftright(byte((g - 1) * 3 + 2), 4)),
        ),
    )
    return F.when(groups > 0, F.flatten(pairs)).when(groups == 0, F.array().cast("array<int>"))


def unpack12_array(data: bytes) -> np.ndarray:
    """The same for whole images in Arrow batches."""
    b = np.frombuffer(data, dtype=np.uint8)
    b = b[: len(b) // 3 * 3].reshape(-1, 3).astype(np.uint16)
    out = np.empty((len(b), 2), dtype=np.uint16)
    out[:, 0] = (b[:, 0] << 4) | (b[:, 1] & 15)
    out[:, 1] = (b[:, 2] << 4) | (b[:, 1] >> 4)
    return out.reshape(-1)


def white_balance(sample: Column, gain: Column) -> Column:
    """A 12-bit sample times a gain held in 1/1024, cut at full scale."""
    fixed = F.rint(gain * 1024).cast("int")
    return F.least(F.shiftright(sample.cast("int") * fixed, 10), F.lit(FULL))


def curve(name: str, x: Column, param: float | None = None) -> Column:
    """Tone curve of a value from 0 to 1: 'gamma', 'log', 'reinhard' or 'bt709'."""
    if name == "gamma":
        return F.pow(x, F.lit(1.0 / (param or 2.2)))
    if name == "log":
        a = param or 100.0
        return F.log1p(a * x) / math.log1p(a)
    if name == "reinhard":
        k = param or 1.0
        return x * (1 + k) / (x + k)
    if name == "bt709":
        return F.when(x < 0.018, 4.5 * x).otherwise(1.099 * F.pow(x, F.lit(0.45)) - 0.099)
    raise ValueError(f"no curve {name}")


def tonemap(sample: Column, name: str, param: float | None = None, *, exposure: float = 1.0, black: float = 0.0, white: float = FULL, top: int = 255) -> Column:
    """A linear sample to display values: levels, exposure, cut, curve, rounding half up."""
    x = F.least(F.greatest((sample - black) / (white - black) * exposure, F.lit(0.0)), F.lit(1.0))
    return F.floor(curve(name, x, param) * top + 0.5).cast("int")


def custom_tonemap(f: Callable[[np.ndarray], np.ndarray], top: int = 255) -> Callable[[Column], Column]:
    """A column function for any vectorised curve from 0..1 to 0..1, in Arrow batches."""

    @F.pandas_udf("int")
    def apply(x: pd.Series) -> pd.Series:
        y = np.clip(np.asarray(f(np.clip(x.to_numpy(float), 0, 1))), 0, 1)
        return pd.Series(np.floor(y * top + 0.5)).astype("Int64")

    return lambda sample: apply(sample / F.lit(float(FULL)))


def depth_color(z: Column, low: Column, high: Column) -> Column:
    """Red, green and blue of a depth, near ones warm, far ones cold."""
    x = F.least(F.greatest((z - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    part = lambda v: F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) * 255 + 0.5).cast("int")
    return F.struct(part(1.5 - F.abs(4 * x - 1)).alias("r"), part(1.5 - F.abs(4 * x - 2)).alias("g"), part(1.5 - F.abs(4 * x - 3)).alias("b"))
