"""Choosing views, graphs, cameras and probes."""

from functools import reduce

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillframe.functions import camera, pixels, scalars, views
from rillframe.functions import geometry as G
from rillframe.kernels import rotations as R
from rillframe.operators import calibrate, graphs
from rillframe.sources import probes


def poses(spark, rows):
    df = spark.createDataFrame([(e, k, *map(float, R.exp(np.radians(np.array([0, 0, a]))[None])[0]), x, 0.0, 0.0) for e, k, a, x in rows], "e string, k long, w double, x double, y double, z double, tx double, ty double, tz double")
    return df.select("e", "k", G.pose(G.quat(*(F.col(c) for c in "wxyz")), G.vec(F.col("tx"), F.col("ty"), F.col("tz"))).alias("p"))


def test_novel_and_steady(spark):
    df = poses(spark, [("a", 0, 0, 0.0), ("a", 1, 1, 0.001), ("a", 2, 20, 0.001), ("a", 3, 20, 0.5), ("a", 4, 1, 0.01)])
    assert sorted(r["k"] for r in calibrate.novel_views(df, by=["e"], order="k", pose="p", shift=0.1, degrees=5).collect()) == [0, 2, 3]
    got = df.select("k", calibrate.steady(["e"], "k", "p", degrees=2).alias("s")).orderBy("k").collect()
    assert [r["s"] for r in got] == [False, True, False, False, False]


def test_gates(spark):
    df = spark.createDataFrame([(0.4, 10, 20, 0.0, 0.5), (0.3, 10, 20, 0.01, 0.5), (0.4, 9, 20, 0.0, 0.1), (0.4, 5, 8, 0.0, 0.8)], "s double, n int, m int, c double, l double")
    got = df.select(calibrate.sharp_enough(F.col("s"), F.col("n"), F.col("m")), calibrate.white_refusal(F.col("c"), F.col("l")), calibrate.white_band(F.col("c"), F.col("l"))).collect()
    assert [tuple(r) for r in got] == [(True, None, "ok"), (False, "clipped", "clipping"), (False, "too dark", "too dark"), (False, None, "too bright")]
    left = spark.createDataFrame([(1, c) for c in range(5)], "view int, corner int")
    right = spark.createDataFrame([(1, c) for c in range(2, 9)], "view int, corner int")
    assert calibrate.shared_corners(left, right, on=["view"], least=3).count() == 3
    assert calibrate.shared_corners(left, right, on=["view"], least=4).count() == 0


def test_rigid_fit(spark):
    rng = np.random.default_rng(0)
    q, t = R.exp(np.array([0.3, -0.5, 0.2])), np.array([1.0, 2, 3])
    a = rng.normal(0, 1, (30, 3))
    b = R.rotate(np.tile(q, (30, 1)), a) + t
    df = spark.createDataFrame([("e", *map(float, p), *map(float, r)) for p, r in zip(a, b)], "e string, ax double, ay double, az double, bx double, by double, bz double")
    r = calibrate.rigid_fits(df, by=["e"], a=["ax", "ay", "az"], b=["bx", "by", "bz"]).first()
    assert np.allclose(np.reshape(r["rotation"], (3, 3)), R.to_matrix(q[None])[0]) and np.allclose(r["shift"], t) and r["n"] == 30


def test_sharpness(spark):
    edge = np.zeros((40, 40), np.uint8)
    edge[:, 20:] = 200
    soft = np.clip((np.arange(40) - 12) * 12, 0, 200).astype(np.uint8)[None].repeat(40, axis=0)
    rows = [(1, edge.tobytes(), 40, [[20.0, 20.0]]), (2, np.ascontiguousarray(soft).tobytes(), 40, [[20.0, 20.0]]), (3, bytes(1600), 40, [[20.0, 20.0]]), (4, bytes(1600), 40, [])]
    got = {r["k"]: r["sharpness"] for r in calibrate.image_sharpness(spark.createDataFrame(rows, "k int, i binary, w int, c array<array<double>>"), keys=["k"], image="i", width="w", corners="c").collect()}
    assert got[1] == pytest.approx(1.0) and 0 < got[2] < 0.5 and got[3] == got[4] == 0.0


def test_depth(spark):
    still = "named_struct('q', named_struct('w', 1D, 'x', 0D, 'y', 0D, 'z', 0D), 't', named_struct('x', {}D, 'y', 0D, 'z', 0D))"
    views = spark.sql(" union all ".join(f"select '{v}' as view, {still.format(x)} as pose, 20D as fx, 20D as fy, 16D as cx, 16D as cy" for v, x in (("near", 0), ("same", 0), ("far", 0), ("aside", 1), ("blind", 0), ("none", 0))))
    grid = spark.range(32).selectExpr("id as u").crossJoin(spark.range(32).selectExpr("id as v"))
    depth = {"near": "2D", "same": "2D", "far": "4D", "aside": "2D", "blind": "2D", "none": "0D"}
    pixels = reduce(DataFrame.unionByName, [grid.selectExpr(f"'{v}' as view", "u", "v", f"{d} as depth", "cast('nan' as double) as confidence" if v == "blind" else "1D as confidence") for v, d in depth.items()])
    pairs = spark.createDataFrame([("near", v) for v in depth], "a string, b string")
    got = {r["b"]: r["overlap"] for r in calibrate.depth_overlap(pairs, views, pixels).collect()}
    assert got["near"] == got["same"] == 1.0 and got["far"] == got["blind"] == got["none"] == 0.0 and 0 < got["aside"] < 1


def plain_sharpness(image, corners):
    values = []
    for x, y in np.rint(corners).astype(int):
        w = image[max(0, y - 4) : y + 5, max(0, x - 4) : x + 5].astype(float)
        if w.size and w.max() - w.min() >= 8:
            p = np.pad(w, 1, mode="reflect")
            gx = [[sum(k * (p[j + d, i + 2] - p[j + d, i]) for d, k in enumerate((1, 2, 1))) for i in range(w.shape[1])] for j in range(w.shape[0])]
            gy = [[sum(k * (p[j + 2, i + d] - p[j, i + d]) for d, k in enumerate((1, 2, 1))) for i in range(w.shape[1])] for j in range(w.shape[0])]
            values.append(np.hypot(gx, gy).max() / (4 * (w.max() - w.min())))
    return values


def test_contrast_of_edges_at_borders():
    rng = np.random.default_rng(4)
    image = rng.integers(0, 255, (30, 40)).astype(np.uint8)
    corners = rng.uniform(-6, 45, (60, 2))
    assert np.allclose(sorted(calibrate.edge_contrast(image, corners)), sorted(plain_sharpness(image, corners)))


def test_graphs(spark):
    nodes = spark.createDataFrame([("g", k) for k in (0, 1, 2, 3)], "e string, n long")
    edges = spark.createDataFrame([("g", 0, 1, 0.5, 0), ("g", 0, 1, 0.9, 1), ("g", 0, 1, 0.9, 2), ("g", 1, 3, 1.0, 3), ("g", 3, 7, 1.0, 4)], "e string, a long, b long, q double, pos int")
    assert graphs.between_nodes(edges, nodes, by=["e"], a="a", b="b", node="n").count() == 4
    assert [r["pos"] for r in graphs.best_steps(edges, by=["e"], a="a", b="b", quality="q", position="pos").collect()] == [1]
    both = graphs.first_by_priority([nodes.where("n < 2").withColumn("s", F.lit("x")), nodes.withColumn("s", F.lit("y"))], ["e", "n"])
    assert sorted((r["n"], r["s"]) for r in both.collect()) == [(0, "x"), (1, "x"), (2, "y"), (3, "y")]
    snapped = graphs.snapped_pairs(spark.createDataFrame([("g", 5, -9)], "e string, a long, b long"), nodes, by=["e"], frame="n", a="a", b="b").first()
    assert (snapped["a"], snapped["b"]) == (3, 0)
    r = spark.range(1).select(graphs.is_subset(F.array(F.lit(1)), F.array(F.lit(1), F.lit(2))), graphs.is_subset(F.array(F.lit(3)), F.array(F.lit(1)))).first()
    assert tuple(r) == (True, False)


def test_composed_rotations(spark):
    rng = np.random.default_rng(1)
    q = R.exp(rng.normal(0, 0.4, (8, 3)))
    rows = [("e", k, *map(float, q[k]), k != 5) for k in range(8) if k != 7]
    steps = spark.createDataFrame(rows, "e string, f long, w double, x double, y double, z double, ok boolean").select("e", "f", G.quat(*(F.col(c) for c in "wxyz")).alias("r"), "ok")
    pairs = spark.createDataFrame([("e", 0, 3), ("e", 2, 5), ("e", 4, 6), ("e", 6, 8)], "e string, a long, b long")
    got = {(r["a"], r["b"]): r for r in graphs.composed_rotations(steps, pairs, by=["e"], frame="f", rotation="r", valid="ok", a="a", b="b").collect()}
    for a, b in ((0, 3), (2, 5)):
        want = np.array([1.0, 0, 0, 0])
        for k in range(a, b):
            want = R.multiply(q[k], want)
        assert np.allclose([got[a, b][c] for c in "wxyz"], want)
    assert got[4, 6]["w"] is None and got[6, 8]["w"] is None


def test_cameras(spark):
    zero, ahead = G.vec(F.lit(0.0), F.lit(0.0), F.lit(0.0)), G.vec(F.lit(1.0), F.lit(0.0), F.lit(0.0))
    up, side = G.vec(F.lit(0.0), F.lit(0.0), F.lit(1.0)), G.vec(F.lit(0.0), F.lit(1.0), F.lit(0.0))
    r = spark.range(1).select(views.camera_target(zero, ahead, side, "follow").alias("f"), views.camera_target(zero, ahead, side, "ego").alias("e"), views.camera_target(zero, up, side, "follow").alias("u")).first()
    assert tuple(r["f"]["position"]) == pytest.approx((-0.75, 0, 0.24)) and tuple(r["e"]["look_at"]) == pytest.approx((1, 0, 0))
    assert tuple(r["u"]["position"]) == pytest.approx((0, -0.75, 0.24))
    df = spark.createDataFrame([(0.0, 0.0, 0.0), (2.0, 0.0, 0.0)], "x double, y double, z double")
    o = df.agg(views.overview_target(F.col("x"), F.col("y"), F.col("z"), G.vec(F.lit(1.0), F.lit(0.0), F.lit(0.0))).alias("o")).first()["o"]
    assert np.linalg.norm(np.array(o["position"]) - [1, 0, 0]) == pytest.approx(2.7)
    t = spark.range(1).select(camera.triangulate(G.vec(F.lit(0.5), F.lit(0.0), F.lit(1.0)), G.vec(F.lit(-0.5), F.lit(0.0), F.lit(1.0)), ahead).alias("p"), camera.triangulate(up, up, ahead).alias("n"), camera.pinhole_project(ahead, F.lit(1.0), F.lit(0.0), F.lit(0.0)).alias("b")).first()
    assert tuple(t["p"]) == pytest.approx((0.5, 0, 1)) and t["n"] is None and t["b"] is None


def test_poses(spark):
    df = poses(spark, [("a", 0, 40, 0.3), ("a", 1, 170, 1.0)])
    twice = df.select(G.bind(G.pose_half(F.col("p")), lambda h: G.pose_compose(h, h)).alias("h"), "p").collect()
    for r in twice:
        assert np.allclose([r["h"]["t"][c] for c in "xyz"], [r["p"]["t"][c] for c in "xyz"]) and np.allclose([r["h"]["q"][c] for c in "wxyz"], [r["p"]["q"][c] for c in "wxyz"])
    unit = df.select(G.bind(G.pose_inverse(F.col("p")), lambda b: G.pose_compose(F.col("p"), b)).alias("u"), G.pose_relative(F.col("p"), F.col("p")).alias("r"), G.camera_center(F.col("p")).alias("c"), G.from_row(G.to_row(F.col("p"))).alias("b")).first()
    assert tuple(unit["u"]["q"]) == pytest.approx((1, 0, 0, 0)) and tuple(unit["u"]["t"]) == pytest.approx((0, 0, 0))
    assert tuple(unit["r"]["q"]) == pytest.approx((1, 0, 0, 0)) and tuple(unit["r"]["t"]) == pytest.approx((0, 0, 0))
    bad = spark.range(1).select(G.from_row(F.array(*(F.lit(0.0) for _ in range(7)))).alias("z"), G.quat_normalize(G.quat(*(F.lit(0.0) for _ in range(4)))).alias("q")).first()
    assert bad["z"] is None and bad["q"] is None


def test_pixels(spark):
    data = bytes([0xAB, 0x3C, 0xDE, 0x01, 0x20, 0xFF, 0x99])
    r = spark.createDataFrame([(data,), (b"",), (None,)], "d binary").select(pixels.unpack12(F.col("d")).alias("s")).collect()
    assert r[0]["s"] == list(pixels.unpack12_array(data)) == [0xABC, 0xDE3, 0x010, 0xFF2] and r[1]["s"] == [] and r[2]["s"] is None
    df = spark.createDataFrame([(0,), (4095,), (2048,)], "s int")
    assert [x[0] for x in df.select(pixels.custom_tonemap(np.sqrt)(F.col("s"))).collect()] == [0, 255, 180]
    assert df.select(pixels.depth_color(F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("c")).first()["c"]["b"] == 0


def test_scalars(spark):
    r = spark.range(1).select(scalars.us_half_up(F.lit(0.0000025)), scalars.us_half_even(F.lit(0.0000025)), scalars.us_truncated(F.lit(-0.0000015)), scalars.us_floored(F.lit(-0.0000015)), scalars.within_tolerance(F.lit(10.9), F.lit(10.0), 0.5), scalars.normalize_text(F.lit(" Ab-c, 9ß! "))).first()
    assert tuple(r) == (3, 2, -1, -2, True, "ab c 9ß")


def test_probes(spark):
    lines = spark.createDataFrame([("r", 0, "1.000000,"), ("r", 1, "N/A"), ("r", 2, "2.5")], "recording_id string, n int, line string")
    assert tuple(probes.audio_spans(lines).first()) == ("r", 1_000_000, 2_500_000)
    with pytest.raises(Exception, match="no audio"):
        probes.audio_spans(lines.where("n = 1")).collect()
    rows = spark.createDataFrame([("100.5", "0", "N/A", "103.5"), (None, "0.0", "7.25", None), ("N/A", "2.0", None, "1.0")], "packet_pts string, stream_start string, stream_duration string, format_duration string")
    assert [(r["start_pts_us"], r["duration_s"]) for r in probes.audio_probe(rows).collect()] == [(100_500_000, 3.0), (0, 7.25), (2_000_000, 1.0)]
    log = spark.createDataFrame([(1, k, t) for k, t in enumerate(["[9] no", "audio devices:", "x [0] Mic", "noise", "[12] Pods Pro"])], "f int, n int, t string")
    assert [(r["index"], r["name"]) for r in probes.listed_devices(log, by=["f"], order="n", line="t", section="audio devices").orderBy("index").collect()] == [(0, "Mic"), (12, "Pods Pro")]


def test_cut_outs_of_a_fisheye(spark):
    """A cut-out's middle shows what lies along its gaze, and its corners come back through the camera."""
    lens = [F.lit(v) for v in (300.0, 310.0, 320.0, 240.0)], [F.lit(v) for v in (0.05, -0.01, 0.002, 0.0)]
    ray = camera.fisheye_unproject(F.lit(400.0), F.lit(200.0), *lens[0], lens[1])
    axes = camera.aligned_axes(ray, G.vec(F.lit(1.0), F.lit(0.0), F.lit(0.0)))
    at = camera.crop_to_fisheye(F.lit(63.5), F.lit(63.5), F.lit(200.0), F.lit(128), axes, *lens[0], lens[1])
    corners = [camera.fisheye_unproject(F.lit(x), F.lit(y), *lens[0], lens[1]) for x, y in ((390.0, 190.0), (410.0, 190.0), (390.0, 210.0), (410.0, 210.0))]
    r = spark.range(1).select(at.alias("at"), axes.alias("axes"), camera.box_focal(corners, ray, F.lit(128)).alias("f"), F.array(*corners).alias("c"), ray.alias("g")).first()
    assert (r["at"]["u"], r["at"]["v"]) == (pytest.approx(400.0), pytest.approx(200.0))
    m = np.array([[r["axes"][a][c] for c in "xyz"] for a in "xyz"])
    assert np.allclose(m @ m.T, np.eye(3)) and np.linalg.det(m) == pytest.approx(1.0)
    widest = max(np.arccos(sum(c[k] * r["g"][k] for k in "xyz")) for c in r["c"])
    assert r["f"] == pytest.approx(64 / np.tan(widest * 1.1))


def test_host_time(spark):
    df = spark.createDataFrame([(5, 7, True), (-1, 7, True), (None, 7, True), (None, 7, False), (None, None, True), (None, 7, None)], "p long, s long, c boolean")
    assert [r[0] for r in df.select(scalars.host_time(F.col("p"), F.col("s"), F.col("c"))).collect()] == [5, 7, 7, -1, -1, -1]
