"""Nearest in time against brute force, and the edge cases."""

import random

import pytest

from rillframe.llm.nearest import nearest_in_time

LEFT, RIGHT = "e string, t long, k long, delta int, __t int", "e string, t long, k long, __best string"
ARGS = {"left_entity": ["e"], "right_entity": ["e"], "left_time": "t", "right_time": "t", "left_key": ["e", "k"], "right_key": ["k"]}


def run(spark, left, right, tolerance):
    a = spark.createDataFrame([(*r, 1, 2) for r in left], LEFT)
    b = spark.createDataFrame([(*r, "x") for r in right], RIGHT)
    out = nearest_in_time(a, b, **ARGS, tolerance=tolerance)
    assert out.columns == ["e", "k", "k_right", "delta"]
    return {tuple(r) for r in out.collect()}


def brute(left, right, tolerance):
    best = {}
    for e, t, k in left:
        for f, u, j in right:
            if e is not None and e == f and t is not None and u is not None and abs(u - t) <= tolerance:
                key = (abs(u - t), u - t, j)
                best[e, k] = min(best.get((e, k), key), key)
    return {(e, k, j, d) for (e, k), (_, d, j) in best.items()}


@pytest.mark.parametrize("tolerance", [0, 1, 7, 100])
def test_random(spark, tolerance):
    rng = random.Random(tolerance)
    row = lambda k: (rng.choice(["a", "a", "b", None]), rng.choice([rng.randrange(-500, 1500)] * 9 + [None]), k)
    left, right = [row(k) for k in range(200)], [row(k) for k in range(200)]
    left += left[:20]
    right += right[:20]
    assert run(spark, left, right, tolerance) == brute(left, right, tolerance)


def test_ties_go_to_the_earlier(spark):
    assert run(spark, [("a", 10, 1)], [("a", 5, 8), ("a", 15, 2), ("a", 5, 7)], 5) == {("a", 1, 7, -5)}


def test_bucket_borders_and_extremes(spark):
    top = (1 << 63) - 1
    left = [("a", 0, 1), ("a", 9_999, 2), ("a", -1, 3), ("a", top, 4)]
    right = [("a", 10_000, 1), ("a", -10_001, 2), ("a", top, 3)]
    assert run(spark, left, right, 10_000) == brute(left[:3], right[:2], 10_000)


def test_empty(spark):
    assert run(spark, [], [("a", 1, 1)], 5) == set()
    assert run(spark, [("a", 1, 1)], [], 5) == set()


def test_arguments(spark):
    with pytest.raises(ValueError):
        run(spark, [], [], -1)
