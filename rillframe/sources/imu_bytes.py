"""Inertial readings out of a serial byte stream.

A frame is two head bytes, its length, a function code, the payload and a checksum: the sum of all
bytes before it modulo 256. Frames with a wrong checksum are dropped.
"""

from __future__ import annotations

import math
import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillframe.operators.folds import ordered_fold

# The protocol, and what one count is worth.
HEAD1, HEAD2, MAX_LENGTH = 0x7E, 0x23, 40
RAW = 0x04
ACCEL_G = 16 / 32767.0
GYRO_RAD = (2000 / 32767.0) * (math.pi / 180.0)
MAG_UT = 800.0 / 32767.0
SCALES = (ACCEL_G,) * 3 + (GYRO_RAD,) * 3 + (MAG_UT,) * 3


def scan(held: bytes, fresh: bytes) -> tuple[bytes, list[tuple[int, bytes]]]:
    """Frames (code, payload) in the bytes so far, and what is left over for the next piece."""
    data, at, out = held + fresh, 0, []
    while True:
        at = data.find(HEAD1, at)
        if at < 0:
            return b"", out
        if len(data) - at < 3:
            return data[at:], out
        if data[at + 1] != HEAD2:
            at += 1
            continue
        size = data[at + 2]
        if size < 6 or size > MAX_LENGTH:
            at += 3 if size > MAX_LENGTH else 2
            continue
        if len(data) - at < size:
            return data[at:], out
        body = data[at : at + size]
        if sum(body[:-1]) & 0xFF == body[-1]:
            out.append((body[3], body[4:-1]))
        at += size


def parse_stream(df: DataFrame, *, device: str, order: str, data: str, time: str) -> DataFrame:
    """Readings in pieces of a device's byte stream: ``device``, ``time`` of the piece that ends them, ax to mz.

    Pieces are taken in order, a frame cut by a piece's end goes on in the next; null pieces are skipped.
    """

    def step(held: bytes, row: tuple) -> tuple[bytes, list[tuple]]:
        t, fresh = row[-2:]
        rest, frames = scan(held, bytes(fresh))
        out = []
        for code, payload in frames:
            if code == RAW and len(payload) >= 18:
                out.append((t, *(v * s for v, s in zip(struct.unpack_from("<9h", payload), SCALES))))
        return rest, out

    rows = df.select(device, order, F.col(time).alias("__t"), F.col(data).alias("__d")).where("__d is not null")
    types = dict(rows.dtypes)
    cols = ("ax", "ay", "az", "gx", "gy", "gz", "mx", "my", "mz")
    schema = ", ".join([f"{device} {types[device]}", f"{time} {types['__t']}", *(f"{c} double" for c in cols)])
    return ordered_fold(rows, by=[device], order=[order], start=bytes, step=step, schema=schema)
