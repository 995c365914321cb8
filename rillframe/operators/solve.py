"""Numerical solves as grouped maps: one trajectory, one graph or one fit per group."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillframe.functions.scalars import first_failure
from rillframe.kernels import hand, posegraph, spline
from rillframe.kernels import rotations as R

POSE = ("qw", "qx", "qy", "qz", "tx", "ty", "tz")


def full_rate_poses(keys: DataFrame, frames: DataFrame, *, by: Sequence[str], frame: str, time: str) -> DataFrame:
    """Poses of all ``frames`` by splines through key poses (columns qw to tz): entity, frame, qw to tz.

    Camera centres follow a cubic, orientations a spline with continuous rate. Key times must grow;
    frames outside the keys follow the end pieces. Entities without keys give no rows. A trajectory is
    solved as a whole, in one task per entity.
    """
    types = dict(frames.dtypes)
    schema = ", ".join([*(f"{c} {types[c]}" for c in by), f"{frame} {types[frame]}", *(f"{c} double" for c in POSE)])

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values(time), b.sort_values(time)
        if not len(a) or not len(b):
            return pd.DataFrame({c: [] for c in [*by, frame, *POSE]}, dtype=object)
        t, at = a[time].to_numpy(float), b[time].to_numpy(float)
        if (np.diff(t) <= 0).any():
            raise ValueError("key times must grow")
        p = a[list(POSE)].to_numpy(float)
        q = R.normalize(p[:, :4])
        c = spline.cubic(t, posegraph.center(p), at)
        cw = R.conjugate(spline.rotation(t, R.conjugate(q), at))
        out = b[[*by, frame]].copy()
        full = np.concatenate([cw, -R.rotate(cw, c)], axis=1)
        for k, name in enumerate(POSE):
            out[name] = full[:, k]
        return out

    return keys.groupBy(*by).cogroup(frames.groupBy(*by)).applyInPandas(run, schema)


def solve_pose_graphs(edges: DataFrame, *, by: Sequence[str], baseline: float, weights: posegraph.Weights | None = None, iterations: int = 20) -> DataFrame:
    """Poses of each entity's graph: entity, ``frame``, qw to tz, ``cost_before``, ``cost_after``.

    ``edges`` has ``frame_a``, ``frame_b``, ``window``, ``quality``, ``predicted`` (the window's own
    baseline) and qw to tz. One graph is solved in one task: it is one system of equations.
    """
    types = dict(edges.dtypes)
    schema = ", ".join([*(f"{c} {types[c]}" for c in by), "frame bigint", *(f"{c} double" for c in POSE), "cost_before double", "cost_after double"])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        frames, idx = np.unique(part[["frame_a", "frame_b"]].to_numpy(np.int64), return_inverse=True)
        _, w = np.unique(part["window"].to_numpy(), return_inverse=True)
        predicted = part.groupby(w)["predicted"].first().to_numpy(float)
        graph = posegraph.PoseGraph(np.column_stack([idx.reshape(-1, 2), w]), part[list(POSE)].to_numpy(float), part["quality"].to_numpy(float), predicted, baseline)
        poses, _, first, last = posegraph.solve(graph, len(frames), weights, iterations)
        out = pd.DataFrame({c: [part[c].iloc[0]] * len(frames) for c in by})
        out["frame"] = frames
        for k, name in enumerate(POSE):
            out[name] = poses[:, k]
        out["cost_before"], out["cost_after"] = first, last
        return out

    return edges.groupBy(*by).applyInPandas(run, schema)


MEASURES = ("mean_reproj_px", "p90_reproj_px", "median_epipolar_px", "min_joint_z_m", "depth_m")


def fit_hands(df: DataFrame, *, keys: Sequence[str], left: str, right: str, offsets: np.ndarray, focal: float, baseline: float) -> DataFrame:
    """A hand fitted to each row's points in two views (arrays of 16 pairs): keys, ``root``, ``turns`` and measures.

    Rows are independent and taken as they come, in Arrow batches.
    """
    types = dict(df.dtypes)
    schema = ", ".join([*(f"{c} {types[c]}" for c in keys), "root array<double>", "turns array<double>", *(f"{m} double" for m in MEASURES)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for row in b.itertuples(index=False):
                a, c = (np.array([[np.nan if v is None else v for v in p] for p in getattr(row, n)], float) for n in (left, right))
                x, _, m = hand.fit_stereo(a, c, offsets, focal, baseline)
                rows.append((*(getattr(row, k) for k in keys), x[:3].tolist(), x[3:].tolist(), *(m[k] for k in MEASURES)))
            yield pd.DataFrame(rows, columns=[*keys, "root", "turns", *MEASURES])

    return df.select(*keys, left, right).mapInPandas(run, schema)


def fit_rejection(min_depth: float = 0.1, max_depth: float = 2.0, min_joint_z: float = 0.05, max_reproj_px: float = 12.0, max_epipolar_px: float = 8.0) -> Column:
    """Why a fit is rejected: the first of the tests it fails; null if none."""
    finite = ~F.isnan("mean_reproj_px") & ~F.isnan("depth_m") & ~F.isnan("min_joint_z_m")
    return first_failure({
        "nonfinite": finite,
        "depth": F.col("depth_m").between(min_depth, max_depth),
        "joint_z": F.col("min_joint_z_m") >= min_joint_z,
        "reprojection": F.col("mean_reproj_px") <= max_reproj_px,
        "epipolar": F.isnan("median_epipolar_px") | (F.col("median_epipolar_px") <= max_epipolar_px),
    })


def fit_hand_tracks(df: DataFrame, *, by: Sequence[str], frame: str, time: str, left: str, right: str, offsets: np.ndarray, focal: float, baseline: float) -> DataFrame:
    """Tracks of hands: entity, frame, ``root``, ``turns``, ``bone_length``, ``cost_before``, ``cost_after``.

    Frames are fitted one by one first, then all of a track together. A track is one system of equations
    and is solved in one task.
    """
    types = dict(df.dtypes)
    schema = ", ".join([*(f"{c} {types[c]}" for c in by), f"{frame} {types[frame]}", "root array<double>, turns array<double>, bone_length double, cost_before double, cost_after double"])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(frame)
        a, c = (np.array([[[np.nan if v is None else v for v in p] for p in row] for row in part[n]], float) for n in (left, right))
        start = np.stack([hand.fit_stereo(x, y, offsets, focal, baseline)[0] for x, y in zip(a, c)])
        x, size, first, last = hand.fit_track(a, c, part[time].to_numpy(float), offsets, focal, baseline, start)
        out = part[[*by, frame]].copy()
        out["root"], out["turns"] = x[:, :3].tolist(), x[:, 3:].tolist()
        out["bone_length"], out["cost_before"], out["cost_after"] = size, first, last
        return out

    return df.select(*by, frame, time, left, right).groupBy(*by).applyInPandas(run, schema)
