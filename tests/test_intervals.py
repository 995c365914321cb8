"""Periods and gaps against a sequential restatement, and the edge cases."""

import random

import pytest

from rillframe.operators.intervals import merge_intervals

SCHEMA = "e string, s long, t long, __s int, kind string, start string"


def brute(rows):
    by = {}
    for e, s, t in rows:
        if e is not None and s is not None and t is not None and t >= s:
            by.setdefault(e, []).append((s, t))
    out = set()
    for e, spans in by.items():
        merged = []
        for s, t in sorted(spans):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], t)
            else:
                merged.append([s, t])
        out |= {(e, "period", s, t) for s, t in merged}
        out |= {(e, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])}
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, "k", "x") for r in rows], SCHEMA)
    return [tuple(r) for r in merge_intervals(df, entity=["e"], start="s", end="t", **kw).collect()]


@pytest.mark.parametrize("cell", [7, 50, 600_000_000])
def test_random(spark, cell):
    rng = random.Random(cell)
    rows = []
    for _ in range(400):
        s = rng.randrange(-300, 600)
        rows.append((rng.choice("abc"), s, s + rng.choice([0, 0, 1, 2, 5, 9, 120, -3])))
    rows += rows[:40] + [(None, 1, 2), ("a", None, 5), ("a", 5, None), ("d", 9, 9)]
    got = run(spark, rows, cell_us=cell)
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)


def test_touching_and_adjacent(spark):
    assert set(run(spark, [("a", 0, 10), ("a", 10, 20), ("a", 21, 22)])) == {("a", "period", 0, 20), ("a", "gap", 20, 21), ("a", "period", 21, 22)}


def test_void_and_empty(spark):
    assert run(spark, [("a", 5, 4)]) == []
    assert run(spark, []) == []
    assert run(spark, [("a", 1 << 60, (1 << 60) + 1)]) == []


def test_one_long_interval_over_many(spark):
    rows = [("a", 0, 10_000)] + [("a", k * 10, k * 10 + 3) for k in range(900)] + [("a", 20_000, 20_001)]
    assert set(run(spark, rows, cell_us=100)) == {("a", "period", 0, 10_000), ("a", "gap", 10_000, 20_000), ("a", "period", 20_000, 20_001)}


def test_bad_cell(spark):
    with pytest.raises(ValueError):
        run(spark, [], cell_us=0)
