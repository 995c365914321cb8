"""Splines, graphs and fits on cases with known answers."""

import numpy as np
import pandas as pd
import pytest

from rillframe.kernels import hand, leastsq, posegraph, spline
from rillframe.kernels import rotations as R
from rillframe.operators import solve


def test_rotations():
    rng = np.random.default_rng(0)
    v = rng.normal(0, 1, (50, 3))
    q = R.exp(v)
    assert np.allclose(R.exp(R.log(q)) * np.sign(R.exp(R.log(q))[:, :1]), q * np.sign(q[:, :1]))
    p = rng.normal(0, 1, (50, 3))
    assert np.allclose(np.einsum("nij,nj->ni", R.to_matrix(q), p), R.rotate(q, p))
    assert np.allclose(R.rotate(R.multiply(q, q[::-1]), p), R.rotate(q, R.rotate(q[::-1], p)))


@pytest.mark.parametrize("t", [[0, 1], [0.0, 0.5, 2.0], [0, 0.04, 0.11, 0.15, 0.30]])
def test_splines_are_exact_where_they_must_be(t):
    t = np.array(t, float)
    at = np.linspace(t[0], t[-1], 23)
    degree = min(len(t) - 1, 3)
    f = lambda x: np.stack([sum(x**k for k in range(degree + 1)), x * 2], axis=1)
    assert np.allclose(spline.cubic(t, f(t), at), f(at), atol=1e-10)
    turn = lambda x: R.exp(np.stack([0 * x, 0.3 * x, x * 2], axis=1))
    got = spline.rotation(t, turn(t), at)
    assert np.allclose(np.abs((got * turn(at)).sum(axis=1)), 1, atol=1e-12)


def edges(frames, unit, baseline):
    rows = []
    ids = list(range(len(frames)))
    for a in ids:
        for b in ids[a + 1 :]:
            rows.append((frames[a], frames[b], -(0.2 * (frames[b] - frames[a])) * unit))
    return rows, baseline * unit


def make_graph(baseline=0.07):
    e, rel, pred = [], [], []
    for w, (frames, unit) in enumerate([([0, 1, 2, 3], 2.0), ([2, 3, 4, 5], 0.5), ([0, 1, 4, 5], 1.25)]):
        rows, p = edges(frames, unit, baseline)
        pred.append(p)
        for a, b, x in rows:
            e.append((a, b, w))
            rel.append((1, 0, 0, 0, x, 0, 0))
    return np.array(e), np.array(rel, float), np.array(pred)


def test_pose_graph_recovers_scales():
    e, rel, pred = make_graph()
    down = np.tile([0.0, 0.0, -1.0], (6, 1))
    turns = np.stack([np.arange(5), np.arange(1, 6)], axis=1)
    g = posegraph.PoseGraph(e, rel, np.ones(len(e)), pred, 0.07, turns, np.tile([1.0, 0, 0, 0], (5, 1)), down, np.ones(6), np.arange(6) / 10)
    poses, scales, first, last = posegraph.solve(g, 6)
    assert np.allclose(np.exp(scales), [0.5, 2.0, 0.8], rtol=2e-3)
    c = posegraph.center(poses)
    assert np.allclose(c[:, 0], 0.2 * np.arange(6), atol=2e-3) and np.allclose(c[:, 1:], 0, atol=2e-3)
    assert last <= first


def test_pose_graph_with_noise_and_an_outlier():
    rng = np.random.default_rng(1)
    e, rel, pred = make_graph()
    rel[:, 4:] += rng.normal(0, 0.002, (len(rel), 3))
    rel[4, 4:] += 1.5
    g = posegraph.PoseGraph(e, rel, np.ones(len(e)), pred, 0.07)
    w = posegraph.Weights(cauchy=0.5)
    poses, scales, first, last = posegraph.solve(g, 6, w, 40)
    assert last < first
    assert np.allclose(np.diff(posegraph.center(poses)[:, 0]), 0.2, atol=0.03)


def test_missing_link():
    g = posegraph.PoseGraph(np.array([[0, 1, 0]]), np.array([[1, 0, 0, 0, 1, 0, 0.0]]), np.ones(1), np.ones(1), 1.0)
    with pytest.raises(LookupError):
        posegraph.solve(g, 3)


def test_fit():
    x, cost, _ = leastsq.fit(lambda p: np.array([10 * (p[1] - p[0] ** 2), 1 - p[0]]), np.array([-1.2, 1.0]), 200)
    assert np.allclose(x, 1, atol=1e-5) and cost < 1e-9


def offsets():
    out = np.zeros((16, 3))
    for k in range(1, 16):
        out[k] = (0.03 * ((k - 1) // 3 - 2) / 2 if (k - 1) % 3 == 0 else 0.0, 0.05 if (k - 1) % 3 == 0 else 0.03, 0.0)
    return out


def test_hand_fit(spark):
    rng = np.random.default_rng(2)
    turns = rng.normal(0, 0.15, (16, 3))
    p = hand.joints(offsets(), turns, np.array([0.03, -0.02, 0.45]))
    left = hand.project(p, 500)
    right = hand.project(p - [0.065, 0, 0], 500)
    left[7] = np.nan
    df = spark.createDataFrame([(1, [[None if np.isnan(v) else float(v) for v in q] for q in left], right.tolist())], "frame long, l array<array<double>>, r array<array<double>>")
    r = solve.fit_hands(df, keys=["frame"], left="l", right="r", offsets=offsets(), focal=500, baseline=0.065).withColumn("why", solve.fit_rejection()).first()
    assert np.allclose(r["root"], [0.03, -0.02, 0.45], atol=5e-3)
    assert r["mean_reproj_px"] < 1 and r["why"] is None


def test_full_rate(spark):
    t = np.array([0, 2, 4, 6])
    keys = pd.DataFrame({"rec": "a", "frame": t, "time_s": t / 10})
    q = R.exp(np.stack([0 * t, np.radians(10.0) * t, 0 * t], axis=1))
    c = np.stack([t * 0.1, t**2 * 0.01, 0 * t], axis=1)
    for k, n in enumerate(solve.POSE):
        keys[n] = np.concatenate([q, -R.rotate(q, c)], axis=1)[:, k]
    frames = pd.DataFrame({"rec": "a", "frame": range(7), "time_s": [k / 10 for k in range(7)]})
    out = solve.full_rate_poses(spark.createDataFrame(keys), spark.createDataFrame(frames), by=["rec"], frame="frame", time="time_s").toPandas().sort_values("frame")
    p = out[list(solve.POSE)].to_numpy()
    f = np.arange(7)
    assert np.allclose(posegraph.center(p), np.stack([f * 0.1, f**2 * 0.01, 0 * f], axis=1), atol=1e-10)


def test_graph_as_grouped_map(spark):
    e, rel, pred = make_graph()
    rows = pd.DataFrame({"rec": "a", "frame_a": e[:, 0] * 10, "frame_b": e[:, 1] * 10, "window": e[:, 2], "quality": 1.0, "predicted": pred[e[:, 2]]})
    for k, n in enumerate(solve.POSE):
        rows[n] = rel[:, k]
    out = solve.solve_pose_graphs(spark.createDataFrame(rows), by=["rec"], baseline=0.07).toPandas().sort_values("frame")
    assert list(out["frame"]) == [0, 10, 20, 30, 40, 50]
    assert np.allclose(posegraph.center(out[list(solve.POSE)].to_numpy())[:, 0], 0.2 * np.arange(6), atol=5e-3)


def test_hand_track(spark):
    rng = np.random.default_rng(3)
    base, drift = rng.normal(0, 0.15, (16, 3)), rng.normal(0, 0.01, (16, 3))
    rows, want = [], []
    for f in range(6):
        root = np.array([0.02 + 0.004 * f, -0.01, 0.45])
        p = hand.joints(offsets(), base + f * drift, root)
        want.append(root)
        l, r = (hand.project(p - d, 500) + rng.normal(0, 0.4, (16, 2)) for d in (0, [0.065, 0, 0]))
        rows.append(("a", f, f / 30, l.tolist(), r.tolist()))
    df = spark.createDataFrame(rows, "e string, f long, t double, l array<array<double>>, r array<array<double>>")
    got = solve.fit_hand_tracks(df, by=["e"], frame="f", time="t", left="l", right="r", offsets=offsets(), focal=500, baseline=0.065).toPandas().sort_values("f")
    assert np.allclose(np.stack(got["root"]), want, atol=0.01)
    assert (got["cost_after"] <= got["cost_before"]).all() and abs(got["bone_length"].iloc[0] - 1) < 0.05


def test_many_joints_agree_with_one():
    rng = np.random.default_rng(4)
    turns, root = rng.normal(0, 0.3, (4, 16, 3)), rng.normal(0, 1, (4, 3))
    many = hand.joints_of_many(offsets(), turns, root, np.ones(4))
    assert np.allclose(many, [hand.joints(offsets(), t, r) for t, r in zip(turns, root)])
