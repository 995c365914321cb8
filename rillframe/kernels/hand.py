"""A jointed hand: forward kinematics, fit to two views, measures of the fit."""

from __future__ import annotations

import numpy as np

from rillframe.kernels import rotations as R
from rillframe.kernels.leastsq import Factor, fit, solve_graph

# The parent of each of the 16 joints, wrist first.
PARENTS = (-1, 0, 1, 2, 0, 4, 5, 0, 7, 8, 0, 10, 11, 0, 13, 14)


def joints(offsets: np.ndarray, turns: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Positions (16, 3) of joints with ``offsets`` from their parents, turned by rotation vectors (16, 3), wrist at ``root``."""
    q = R.exp(turns)
    world = np.zeros((len(PARENTS), 4))
    out = np.zeros((len(PARENTS), 3))
    for k, p in enumerate(PARENTS):
        if p < 0:
            world[k], out[k] = q[k], root
        else:
            out[k] = out[p] + R.rotate(world[p], offsets[k])
            world[k] = R.multiply(world[p], q[k])
    return out


def project(points: np.ndarray, focal: float) -> np.ndarray:
    """Pixels around the centre of an ideal camera."""
    return focal * points[:, :2] / np.maximum(points[:, 2:], 1e-6)


def fit_stereo(left: np.ndarray, right: np.ndarray, offsets: np.ndarray, focal: float, baseline: float, start: np.ndarray | None = None, pull: float = 1e-2, iterations: int = 25) -> tuple[np.ndarray, np.ndarray, dict[str, float]]:
    """Wrist position and turns that bring the joints onto both views' points (16, 2), the joints, and measures.

    NaN points don't count. ``pull`` keeps turns small where nothing is seen.
    """
    n = len(PARENTS)
    shift = np.array([baseline, 0.0, 0.0])
    seen = np.concatenate([left, right]).ravel()
    known = np.isfinite(seen)

    def place(x: np.ndarray) -> np.ndarray:
        return joints(offsets, x[3:].reshape(n, 3), x[:3])

    def views(x: np.ndarray) -> np.ndarray:
        p = place(x)
        return np.concatenate([project(p, focal), project(p - shift, focal)]).ravel()

    x = np.zeros(3 + 3 * n)
    x[:3] = (0, 0, 0.4) if start is None else start
    x, _, _ = fit(lambda y: np.concatenate([(views(y) - seen)[known], pull * y[6:]]), x, iterations)
    p = place(x)
    error = np.linalg.norm((views(x) - np.where(known, seen, views(x))).reshape(-1, 2), axis=1)
    rows = np.abs((left[:, 1] - right[:, 1]))
    measures = {
        "mean_reproj_px": float(error.mean()),
        "p90_reproj_px": float(np.percentile(error, 90)),
        "median_epipolar_px": float(np.nanmedian(rows)) if np.isfinite(rows).any() else float("nan"),
        "min_joint_z_m": float(p[:, 2].min()),
        "depth_m": float(p[0, 2]),
    }
    return x, p, measures


def joints_of_many(offsets: np.ndarray, turns: np.ndarray, root: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Joints (n, 16, 3) of many frames: turns (n, 16, 3), roots (n, 3), and how much longer bones are than ``offsets`` (n,)."""
    q = R.exp(turns)
    world, out = np.zeros((len(turns), len(PARENTS), 4)), np.zeros((len(turns), len(PARENTS), 3))
    for k, p in enumerate(PARENTS):
        if p < 0:
            world[:, k], out[:, k] = q[:, k], root
        else:
            out[:, k] = out[:, p] + R.rotate(world[:, p], size[:, None] * offsets[k])
            world[:, k] = R.multiply(world[:, p], q[:, k])
    return out


def fit_track(left: np.ndarray, right: np.ndarray, times: np.ndarray, offsets: np.ndarray, focal: float, baseline: float, start: np.ndarray, smooth: tuple[float, float] = (50.0, 5.0), pull: float = 1e-2, iterations: int = 15) -> tuple[np.ndarray, float, float, float]:
    """All frames of a hand at once: points (n, 16, 2) of both views, from single fits ``start`` (n, 51).

    The bones' length is shared; second differences of wrist and turns, scaled by the steps in time, are
    kept small by ``smooth``. Returns the states (n, 51), the bones' length, first and last cost.
    """
    n, joints_n = len(left), len(PARENTS)
    states = np.zeros((n + 1, 3 + 3 * joints_n))
    states[:n] = start
    dims = np.full(n + 1, states.shape[1])
    dims[n] = 1
    seen = np.concatenate([left, right], axis=1).reshape(n, -1)
    known = np.isfinite(seen)
    shift = np.array([baseline, 0.0, 0.0])

    def views(blocks):
        x, s = blocks
        p = joints_of_many(offsets, x[:, 3:].reshape(-1, joints_n, 3), x[:, :3], np.exp(s[:, 0]))
        flat = np.concatenate([focal * (p - d)[..., :2] / np.maximum((p - d)[..., 2:], 1e-6) for d in (0, shift)], axis=1).reshape(len(x), -1)
        return np.concatenate([np.where(known, flat - np.where(known, seen, 0.0), 0.0), pull * x[:, 6:]], axis=1)

    idx = np.arange(n)
    factors = [Factor(np.stack([idx, np.full(n, n)], axis=1), views), Factor(np.array([[n]]), lambda b: 10 * b[0][:, :1])]
    if n >= 3:
        step = np.diff(times)
        ref = np.median(step)
        weight = np.concatenate([np.full(3, smooth[0]), np.full(3 * joints_n, smooth[1])])
        before, after = (ref / step[:-1])[:, None], (ref / step[1:])[:, None]
        k = idx[1:-1]
        factors.append(Factor(np.stack([k - 1, k, k + 1], axis=1), lambda b: weight * (before * (b[0] - b[1]) + after * (b[2] - b[1]))))
    states, first, last = solve_graph(states, dims, lambda s, d: s + d, factors, iterations)
    return states[:n], float(np.exp(states[n, 0])), first, last
