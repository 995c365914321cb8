"""The regular grid against a sequential restatement."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rillframe.operators.grid import regular_grid, seconds_to_us

NAN = float("nan")
SCHEMA = "id string, t double, x double, y double, slot int, status string, n int"


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, "s", 2) for r in rows], SCHEMA)
    args = {"width_us": 100, "max_gap_us": 300} | kw
    return {(r["id"], r["slot"]): r for r in regular_grid(df, entity=["id"], time_us=seconds_to_us(F.col("t")), values=["x", "y"], **args).collect()}


def ok(v):
    return v is not None and not math.isnan(v)


def brute(rows, width=100, gap=3):
    by = {}
    for e, t, x, y in rows:
        if e is None or t is None or math.isnan(t) or math.isinf(t):
            continue
        slots = by.setdefault(e, {})
        slots.setdefault(math.floor(t * 1e6) // width, []).append((x, y))
    out = {}
    for e, slots in by.items():
        last = None
        for k in range(min(slots), max(slots) + 1):
            full = [v for v in slots.get(k, []) if ok(v[0]) and ok(v[1])]
            if full:
                last = (k, sum(v[0] for v in full) / len(full), sum(v[1] for v in full) / len(full))
                out[e, k] = ("observed", *last[1:])
            elif last and k - last[0] <= gap:
                out[e, k] = ("filled", *last[1:])
            else:
                out[e, k] = ("missing", None, None)
    return out


@pytest.mark.parametrize("block", [4, 4096])
def test_random(spark, block):
    rng = random.Random(block)
    rows = []
    for _ in range(300):
        t = rng.randrange(-2000, 9000) / 1e6
        rows.append((rng.choice("ab"), rng.choice([t, t, t, t, None, NAN, math.inf]), rng.choice([1.5, 2.5, None, NAN]), rng.choice([0.25, 4.0, None, 7.0])))
    rows += [(None, 0.1, 1.0, 1.0), ("c", 0.5, None, 1.0), ("d", 0.5, 1.0, 1.0)]
    got, want = run(spark, rows, block_slots=block), brute(rows)
    assert got.keys() == want.keys()
    for k, (status, x, y) in want.items():
        assert got[k]["status"] == status
        for a, b in ((got[k]["x"], x), (got[k]["y"], y)):
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-12)


def test_empty(spark):
    assert run(spark, []) == {}
    assert run(spark, [("a", None, 1.0, 1.0)]) == {}


def test_wide_hole_is_all_marked(spark):
    got = run(spark, [("a", 0.0, 1.0, 1.0), ("a", 2.0, 3.0, 3.0)])
    assert len(got) == 20_001
    assert sum(r["status"] == "filled" for r in got.values()) == 3
