"""A pose graph of visual, inertial and gravity measurements with one scale per window."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from rillframe.kernels import rotations as R
from rillframe.kernels.leastsq import Factor, solve_graph


@dataclass
class PoseGraph:
    """Measurements. Poses map world to camera and are rows w, x, y, z, x, y, z.

    ``edges``: rows i, j, window; ``relative``: pose of j from i in the window's own scale;
    ``quality``: weight of each edge. ``predicted``: the baseline that each window sees;
    ``baseline``: the true one. ``turns``: rows i, j, with ``turned`` rotations of j from i as
    quaternions, of world to camera. ``down``: where each camera sees down; ``trust``: how far.
    """

    edges: np.ndarray
    relative: np.ndarray
    quality: np.ndarray
    predicted: np.ndarray
    baseline: float
    turns: np.ndarray = field(default_factory=lambda: np.zeros((0, 2), int))
    turned: np.ndarray = field(default_factory=lambda: np.zeros((0, 4)))
    down: np.ndarray | None = None
    trust: np.ndarray | None = None
    times: np.ndarray | None = None


@dataclass(frozen=True)
class Weights:
    """How much each kind of residual counts; a Cauchy scale of 0 means plain squares."""

    translation: float = 10.0
    rotation: float = 10.0
    cauchy: float = 2.0
    baseline: float = 100.0
    turn: float = 10.0
    gravity: float = 1.0
    velocity: float = 0.0
    anchor_translation: float = 1.0
    anchor_rotation: float = 0.01


def chain(graph: PoseGraph, count: int, scales: np.ndarray) -> np.ndarray:
    """First poses: the best edge between each two neighbours, one after the other; LookupError if one is missing."""
    best: dict[int, int] = {}
    for k, (i, j, _) in enumerate(graph.edges):
        if j == i + 1 and (i not in best or graph.quality[k] > graph.quality[best[i]]):
            best[int(i)] = k
    poses = np.zeros((count, 7))
    poses[0, 0] = 1.0
    for i in range(count - 1):
        if i not in best:
            raise LookupError(f"no edge from pose {i} to the next")
        k = best[i]
        rel = graph.relative[k]
        poses[i + 1, :4] = R.normalize(R.multiply(rel[:4], poses[i, :4]))
        poses[i + 1, 4:] = R.rotate(rel[:4], poses[i, 4:]) + np.exp(scales[graph.edges[k, 2]]) * rel[4:]
    return poses


def center(p: np.ndarray) -> np.ndarray:
    """Where cameras stand."""
    return -R.rotate(R.conjugate(p[..., :4]), p[..., 4:7])


def _move(states: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Poses turned and shifted on the left; a log scale, kept in the first place behind the pose, added to."""
    out = states.copy()
    turn = R.exp(step[:, 3:6])
    pose = states[:, 8] == 0
    out[:, :4] = np.where(pose[:, None], R.normalize(R.multiply(turn, states[:, :4])), states[:, :4])
    out[:, 4:7] = np.where(pose[:, None], R.rotate(turn, states[:, 4:7]) + step[:, :3], states[:, 4:7])
    out[:, 7] = np.where(pose, states[:, 7], states[:, 7] + step[:, 0])
    return out


def solve(graph: PoseGraph, count: int, w: Weights | None = None, iterations: int = 20) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Poses (count, 7), log scales of the windows, first and last cost."""
    w = w or Weights()
    windows = len(graph.predicted)
    scales = np.log(graph.baseline / graph.predicted)
    states = np.zeros((count + windows, 9))
    states[:count, :7] = chain(graph, count, scales)
    states[count:, 0] = 1.0
    states[count:, 7], states[count:, 8] = scales, 1.0
    dims = np.where(states[:, 8] == 0, 6, 1)

    def visual(blocks):
        a, b, s = blocks
        q = R.multiply(b[:, :4], R.conjugate(a[:, :4]))
        t = b[:, 4:7] - R.rotate(q, a[:, 4:7])
        k = graph.quality[:, None]
        r = np.concatenate([(t - np.exp(s[:, 7:8]) * graph.relative[:, 4:]) * w.translation * k, R.log(R.multiply(R.conjugate(graph.relative[:, :4]), q)) * w.rotation * k], axis=1)
        if w.cauchy > 0:
            # The square of the residual becomes the Cauchy loss.
            n = (r * r).sum(axis=1, keepdims=True)
            r = r * np.sqrt(w.cauchy**2 * np.log1p(n / w.cauchy**2) / np.maximum(n, 1e-18))
        return r

    factors = [
        Factor(np.stack([graph.edges[:, 0], graph.edges[:, 1], count + graph.edges[:, 2]], axis=1), visual),
        Factor(np.arange(count, count + windows)[:, None], lambda b: w.baseline * (b[0][:, 7:8] + np.log(graph.predicted)[:, None] - np.log(graph.baseline))),
        Factor(np.zeros((1, 1), int), lambda b: np.concatenate([w.anchor_translation * center(b[0]), w.anchor_rotation * R.log(b[0][:, :4])], axis=1)),
    ]
    if len(graph.turns):
        factors.append(Factor(graph.turns, lambda b: w.turn * R.log(R.multiply(R.conjugate(graph.turned), R.multiply(b[0][:, :4], R.conjugate(b[1][:, :4]))))))
    if graph.down is not None:
        k = w.gravity * np.sqrt(np.ones(count) if graph.trust is None else graph.trust)[:, None]
        factors.append(Factor(np.arange(count)[:, None], lambda b: k * (R.rotate(b[0][:, :4], np.broadcast_to([0.0, 0.0, -1.0], (count, 3))) - graph.down)))
    if w.velocity > 0 and count >= 3 and graph.times is not None:
        dt = np.diff(graph.times)[:, None]
        idx = np.arange(count - 2)
        factors.append(Factor(np.stack([idx, idx + 1, idx + 2], axis=1), lambda b: w.velocity * ((center(b[2]) - center(b[1])) / dt[1:] - (center(b[1]) - center(b[0])) / dt[:-1])))
    states, first, last = solve_graph(states, dims, _move, factors, iterations)
    return states[:count, :7], states[count:, 7], first, last
