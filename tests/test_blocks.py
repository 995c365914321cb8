"""Neighbours and running values in blocks against a plain pass."""

import random

import pytest
from pyspark.sql import functions as F

from rillframe.operators import blocks, stats


@pytest.mark.parametrize("block", [3, 40, 10**6])
def test_random(spark, block):
    rng = random.Random(block)
    rows = [(rng.choice("aab"), k, rng.choice([None, *range(9)])) for k in rng.sample(range(-200, 400), 150)]
    df = spark.createDataFrame([*rows, (None, 1, 1), ("a", None, 1)], "e string, k long, v long")
    out = blocks.with_neighbours(df, by=["e"], order=["k"], take=["v"], block=block)
    out = blocks.with_running(out, by=["e"], order=["k"], values={"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}, block=block)
    out = blocks.with_running(out, by=["e"], order=["k"], values={"before": ("max", F.col("v"))}, block=block, before=True)
    out = blocks.with_number(out, by=["e"], order=["k"], block=block, out="n")
    got = {(r["e"], r["k"]): r for r in out.collect()}
    assert len(got) == len(rows)
    for e in "ab":
        mine = sorted(r for r in rows if r[0] == e)
        for i, (_, k, _) in enumerate(mine):
            r, upto = got[e, k], [v for _, _, v in mine[: i + 1] if v is not None]
            earlier = [v for _, _, v in mine[:i] if v is not None]
            assert (r["__prev"] and r["__prev"]["v"]) == (mine[i - 1][2] if i else None) and (r["__prev"] is None) == (i == 0)
            assert (r["__next"] and r["__next"]["v"]) == (mine[i + 1][2] if i + 1 < len(mine) else None)
            assert (r["n"], r["s"], r["m"], r["before"]) == (i, sum(upto), max(upto, default=None), max(earlier, default=None))


def test_empty(spark):
    df = spark.createDataFrame([], "e string, k long, v long")
    assert blocks.with_neighbours(df, by=["e"], order=["k"], take=["v"], block=5).count() == 0
    assert blocks.with_number(df, by=["e"], order=["k"], block=5, out="n").count() == 0


def test_nearest_rank(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.choice([1.5, 2.0, 7.25, -3.0, 40.0])) for _ in range(99)] + [("c", 5.0), ("a", None)]
    got = {r["e"]: (r["m"], r["h"]) for r in stats.nearest_rank(spark.createDataFrame(rows, "e string, v double"), by=["e"], value="v", fractions={"m": 0.5, "h": 1.0}, width=4.0).collect()}
    for e in "abc":
        v = sorted(x for f, x in rows if f == e and x is not None)
        assert got[e] == (v[len(v) // 2], v[-1])
