"""Joins on time against brute force, with blocks small enough to matter."""

import random

import pytest
from pyspark.sql import functions as F

from rillframe.operators import asof as A


def tables(spark, seed):
    rng = random.Random(seed)
    row = lambda k: (rng.choice(["a", "a", "b", None]), rng.choice([rng.randrange(0, 400)] * 9 + [None]), k)
    left, right = [row(k) for k in range(80)], [row(k) for k in range(120)]
    return left, right, spark.createDataFrame(left, "e string, t long, k long"), spark.createDataFrame(right, "e string, t long, v long")


@pytest.mark.parametrize("block", [7, 100, 10**9])
@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
def test_asof(spark, block, direction):
    left, right, a, b = tables(spark, block)
    got = {r["k"]: tuple(r["match"]) if r["match"] else None for r in A.asof(a, b, by=["e"], left_time="t", right_time="t", take=["v"], direction=direction, block=block).collect()}
    assert len(got) == len(left)
    for e, t, k in left:
        near = [(u, v) for f, u, v in right if e is not None and f == e and u is not None and t is not None]
        if direction == "backward":
            best = max(((u, -v) for u, v in near if u <= t), default=None)
            best = best and (best[0], -best[1])
        elif direction == "forward":
            best = min(((u, v) for u, v in near if u >= t), default=None)
        else:
            best = min(((abs(u - t), u, v) for u, v in near), default=None)
            best = best and best[1:]
        assert got[k] == best


def test_asof_tolerance_and_empty(spark):
    _, _, a, b = tables(spark, 1)
    assert A.asof(a, b.limit(0), by=["e"], left_time="t", right_time="t", take=["v"]).where("match is not null").count() == 0
    assert A.asof(a.limit(0), b, by=["e"], left_time="t", right_time="t", take=["v"]).count() == 0
    got = A.asof(a, b, by=["e"], left_time="t", right_time="t", take=["v"], direction="nearest", tolerance=0).where("match is not null and match.at <> t").count()
    assert got == 0


def test_interpolate(spark):
    left = spark.createDataFrame([("a", 5, 0), ("a", 15, 1), ("a", 99, 2), ("b", 1, 3), ("a", 10, 4)], "e string, t long, k long")
    right = spark.createDataFrame([("a", 10, 1.0), ("a", 20, 3.0)], "e string, t long, x double")
    got = {r["k"]: r["x"] for r in A.interpolate(left, right, by=["e"], left_time="t", right_time="t", values=["x"]).collect()}
    assert got == {0: 1.0, 1: 2.0, 2: 3.0, 3: None, 4: 1.0}


@pytest.mark.parametrize("half", [0, 3, 40])
def test_interval_window(spark, half):
    left, right, a, b = tables(spark, half)
    got = {r["k"]: (r["n"], r["s"]) for r in A.interval_window(a, b, by=["e"], left_time="t", right_time="t", half=half, aggs={"n": F.count("v"), "s": F.sum("v")}).collect()}
    for e, t, k in left:
        near = [v for f, u, v in right if e is not None and f == e and u is not None and t is not None and abs(u - t) <= half]
        assert got[k] == (len(near), sum(near) if near else None)


def test_range_join(spark):
    _, right, _, b = tables(spark, 5)
    spans = [("a", 10, 50, 1), ("a", 40, 40, 2), ("b", 0, 400, 3), ("a", 9, 3, 4), (None, 0, 9, 5)]
    s = spark.createDataFrame(spans, "e string, s long, u long, id int")
    got = sorted((r["v"], r["id"]) for r in A.range_join(b, s, by=["e"], time="t", start="s", end="u", take=["id"], width=16).collect())
    assert got == sorted((v, i) for f, t, v in right for e, x, y, i in spans if e is not None and e == f and t is not None and x <= t <= y)


def test_strict_lookup(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, v string")
    assert A.strict_lookup(a, b, ["k"]).count() == 2
    with pytest.raises(LookupError, match="3"):
        A.strict_lookup(b, a, ["k"])


def test_at_or_after_else_last(spark):
    left = spark.createDataFrame([("a", 5), ("a", 15), ("a", 99)], "e string, t long")
    right = spark.createDataFrame([("a", 10, 1), ("a", 15, 2)], "e string, t long, v int")
    rows = A.at_or_after_else_last(left, right, by=["e"], left_time="t", right_time="t", take=["v"]).orderBy("t").collect()
    assert [r["match"]["v"] for r in rows] == [1, 2, 2]
