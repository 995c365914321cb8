"""Ordered folds against sequential restatements."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillframe.functions import geometry as G
from rillframe.kernels import rotations as R
from rillframe.kernels.exposure import Metering
from rillframe.operators import folds, kinematics, sequence, spatial, stats


def test_match_pairs(spark):
    rng = random.Random(0)
    times = lambda n: sorted(rng.sample(range(2000), n))
    left, right = {e: times(150) for e in "ab"}, {e: times(150) for e in "ab"}
    a, b = (spark.createDataFrame([(e, t) for e in "ab" for t in side[e]], "e string, t long") for side in (left, right))
    got = sorted(tuple(r) for r in folds.match_pairs(a, b, by=["e"], time="t", window=5).collect())
    want = []
    for e in "ab":
        i = j = 0
        while i < 150 and j < 150:
            x, y = left[e][i], right[e][j]
            if abs(x - y) <= 5:
                want.append((e, x, y))
                i, j = i + 1, j + 1
            elif x < y:
                i += 1
            else:
                j += 1
    assert got == sorted(want)


def test_keep_spaced_differs_from_a_lag(spark):
    rows = [("a", k, 3 * k, 3 * k + 1) for k in range(20)]
    df = spark.createDataFrame(rows, "e string, id long, s long, t long")
    got = sorted(r["id"] for r in folds.keep_spaced(df, by=["e"], start="s", end="t", event_id="id", span=4).collect())
    assert got == [0, 2, 4, 6, 8, 10, 12, 14, 16, 18]


def test_cadence(spark):
    df = spark.createDataFrame([("a", f) for f in (0, 3, 5, 9, 10, 11)] + [("b", 7)], "e string, f long")
    assert sorted(tuple(r) for r in folds.keep_cadence(df, by=["e"], frame="f", gap=5).collect()) == [("a", 0), ("a", 5), ("a", 10), ("a", 11), ("b", 7)]


@pytest.mark.parametrize("both", [False, True])
def test_suppress(spark, both):
    rng = random.Random(1)
    rows = list({(rng.randrange(60), rng.randrange(60)): rng.randrange(100) for _ in range(80)}.items())
    df = spark.createDataFrame([("x", a, b, n) for (a, b), n in rows], "e string, a long, b long, n long")
    got = [(r["a"], r["b"]) for r in folds.suppress_peaks(df, by=["e"], a="a", b="b", rank=[-F.col("n"), F.col("a"), F.col("b")], radius=6, most=7, both=both).orderBy("place").collect()]
    kept = []
    for (a, b), _ in sorted(rows, key=lambda r: (-r[1], r[0])):
        near = [(abs(a - u) <= 6, abs(b - v) <= 6) for u, v in kept]
        if len(kept) < 7 and not any(all(n) if both else any(n) for n in near):
            kept.append((a, b))
    assert got == kept


def test_fold_carries_state_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
        got = folds.ordered_fold(df, by=["k"], order=["id"], start=lambda: 0, step=lambda s, r: (s + r[1], []), finish=lambda s: [(s,)], schema="k bigint, total bigint")
        assert sorted(tuple(r) for r in got.collect()) == [(k, sum(range(k, 100, 3))) for k in range(3)]
        assert folds.ordered_fold(df.limit(0), by=["k"], order=["id"], start=lambda: 0, step=lambda s, r: (s, []), schema="k bigint, total bigint").count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rotations_and_poses(spark):
    rng = np.random.default_rng(0)
    q = R.exp(rng.normal(0, 0.5, (40, 3)))
    t = rng.normal(0, 1, (40, 3))
    rows = [("ab"[k % 2], k, *map(float, q[k]), *map(float, t[k])) for k in range(40)]
    df = spark.createDataFrame(rows, "e string, k long, w double, x double, y double, z double, tx double, ty double, tz double")
    df = df.select("e", "k", G.pose(G.quat(*(F.col(c) for c in "wxyz")), G.vec(F.col("tx"), F.col("ty"), F.col("tz"))).alias("p"))
    prod = {r["e"]: r for r in kinematics.quat_product(df.withColumn("q", F.col("p.q")), by=["e"], order=["k"], quat="q").collect()}
    chain = {(r["e"], r["k"]): r["pose"] for r in kinematics.chain_poses(df, by=["e"], order="k", pose="p").collect()}
    for e, first in (("a", 0), ("b", 1)):
        total, at_q, at_t = np.array([1.0, 0, 0, 0]), np.array([1.0, 0, 0, 0]), np.zeros(3)
        for k in range(first, 40, 2):
            total = R.multiply(total, q[k])
            at_t = R.rotate(q[k], at_t) + t[k]
            at_q = R.multiply(q[k], at_q)
            assert np.allclose([chain[e, k]["t"][c] for c in "xyz"], at_t) and np.allclose([chain[e, k]["q"][c] for c in "wxyz"], at_q)
        assert np.allclose([prod[e][c] for c in "wxyz"], total) and prod[e]["n"] == 20


def test_relative_rotation_of_a_steady_turn(spark):
    gyro = spark.createDataFrame([("a", 10_000 * k, 0.0, 0.5, 0.0) for k in range(60)], "e string, t long, x double, y double, z double")
    frames = spark.createDataFrame([("a", 0, 5_000), ("a", 1, 38_000), ("a", 2, 405_000)], "e string, f long, t long")
    rows = kinematics.relative_rotations(frames, gyro, by=["e"], frame="f", frame_time="t", gyro_time="t", rates=["x", "y", "z"]).orderBy("f").collect()
    assert [r["f"] for r in rows] == [0, 1] and all(r["valid"] for r in rows)
    for r, dt in zip(rows, (0.033, 0.367)):
        assert np.allclose([r["rotation"][c] for c in "wxyz"], R.exp(np.array([0, 0.5 * dt, 0])))


def test_smoothing_in_blocks(spark):
    rng = np.random.default_rng(2)
    t = np.cumsum(rng.integers(5_000, 60_000, 800))
    v = rng.normal(0, 1, 800)
    df = spark.createDataFrame([("a", int(a), float(b)) for a, b in zip(t, v)], "e string, t long, v double")
    got = {r["t"]: r["smooth"] for r in kinematics.smooth_both_ways(df, by=["e"], time="t", value="v", tau=0.02, block_s=2.0).collect()}
    a = 1 - np.exp(-np.diff(t) / 1e6 / 0.02)
    f, b = v.copy(), v.copy()
    for k in range(1, 800):
        f[k] = f[k - 1] + a[k - 1] * (v[k] - f[k - 1])
    for k in range(798, -1, -1):
        b[k] = b[k + 1] + a[k] * (v[k] - b[k + 1])
    assert np.allclose([got[x] for x in t], (f + b) / 2)


def test_exposure(spark):
    levels = [0.0] * 60 + [0.35, 0.36, None, float("nan"), 0.33] + [0.9] * 80 + [0.2] * 30
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate(levels)], "e string, k long, v double")
    rows = kinematics.exposure_steps(df, by=["e"], order=["k"], level="v").orderBy("step").collect()
    assert {r["exposure"] for r in rows} == {8.3333, 16.6667}
    # A black picture asks for the most light a step may add.
    assert rows[0]["exposure"] * rows[0]["gain"] == pytest.approx(8.3333 * 1.5)
    # Gain first: the longer exposure only when gain is at its end, and back with a tenth of it to spare.
    longer = [r for r in rows if r["exposure"] > 10]
    assert longer[0]["gain"] * longer[0]["exposure"] > 16 * 8.3333 and rows[59]["gain"] == 16
    assert [rows[k]["gain"] for k in range(60, 65)] == [rows[59]["gain"]] * 5
    down = next(k for k in range(65, 145) if rows[k]["exposure"] < 10)
    assert rows[down]["gain"] <= 16 * 0.9 < rows[down - 1]["gain"] * 2
    assert all(1 <= r["gain"] <= 16 for r in rows)


def test_exposures_without_flicker():
    assert Metering(flicker_hz=0).allowed == (5.0,) and Metering(flicker_hz=50).allowed == (10.0,)
    assert Metering(exposures=(1.0, 5.0)).allowed == (1.0,)


def test_radius_pairs(spark):
    rng = random.Random(3)
    pts = [(k, rng.uniform(-2, 2), rng.uniform(-2, 2), rng.uniform(-2, 2)) for k in range(120)]
    df = spark.createDataFrame([("e", *p, p[0] * 2) for p in pts] + [("e", 999, None, 0.0, 0.0, 1)], "e string, id long, x double, y double, z double, f long")
    got = {(r["a"], r["b"]) for r in spatial.radius_pairs(df, by=["e"], point_id="id", coords=["x", "y", "z"], radius=0.7, carry=["f"]).where("abs(f_a - f_b) >= 20").collect()}
    want = {(p[0], q[0]) for p in pts for q in pts if p[0] < q[0] and math.dist(p[1:], q[1:]) <= 0.7 and q[0] - p[0] >= 10}
    assert got == want


def test_phrases_and_pairs(spark):
    rows = [("a", k, w, 300 * k, 300 * k + 200, p) for k, (w, p) in enumerate([("new", 0.9), ("segment", 0.8), ("new", 0.9), ("segment", 0.2), ("new", 1.0), ("x", 1.0), ("segment", 1.0)])]
    df = spark.createDataFrame(rows, "e string, n long, w string, s long, t long, p double")
    got = sequence.phrase_matches(df, by=["e"], order=["n"], token="w", start="s", end="t", probability="p", phrase=["new", "segment"], min_probability=0.5, max_gap=150).collect()
    assert [(r["start_us"], r["end_us"], r["min_probability"]) for r in got] == [(0, 500, 0.8)]
    with pytest.raises(ValueError):
        sequence.phrase_matches(df, by=["e"], order=["n"], token="w", start="s", end="t", probability="p", phrase=["a", "b", "a"], min_probability=0, max_gap=1)
    ev = [("a", k, r, 10 * k, 10 * k + 1) for k, r in enumerate(["stop", "start", "start", "stop", "stop", "start"])]
    df = spark.createDataFrame(ev, "e string, id long, role string, s long, t long")
    got = sorted((r["start_us"], r["end_us"]) for r in sequence.paired_windows(df, by=["e"], role="role", start="s", end="t", event_id="id", extend=True).collect() if r["end_us"])
    assert got == [(21, 30)]


def test_sampling_lists(spark):
    r = spark.range(1).select(sequence.fractional_indices(F.lit(30), F.lit(2.5)).alias("f"), sequence.window_starts(F.lit(10), 4, 1).alias("w"), sequence.window_starts(F.lit(11), 4, 1).alias("v"), sequence.window_starts(F.lit(3), 4, 1).alias("u")).first()
    assert r["f"] == [0, 2, 5, 8, 10, 12, 15, 18, 20, 22, 25, 28]
    assert r["w"] == [0, 3, 6] and r["v"] == [0, 3, 6, 7] and r["u"] == [0]


def test_triples_and_gaps(spark):
    df = spark.createDataFrame([("a", f, 25_000 * f, 1.0 * f) for f in (10, 11, 13, 14, 15)], "e string, f long, t long, v double")
    assert [r["f"] for r in sequence.accel_triples(df, by=["e"], frame="f", time="t").collect()] == [14]
    got = sequence.fill_gaps(df, by=["e"], frame="f", time="t", values=["v"], longest=2).orderBy("f").collect()
    assert [(r["f"], r["t"], r["v"], r["interpolated"]) for r in got][2] == (12, 300_000, 12.0, True) and len(got) == 6


def test_medians(spark):
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate([5.0, 7.0, 6.0, 9.0])] + [("b", 0, 1.0)], "e string, k long, v double")
    got = {r["e"]: (r["median_delta"], r["n"]) for r in stats.median_positive_delta(df, by=["e"], order=["k"], value="v").collect()}
    assert got == {"a": (2.5, 2), "b": (None, 0)}
