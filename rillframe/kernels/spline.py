"""Cubic splines of values and of rotations."""

from __future__ import annotations

import numpy as np

from rillframe.kernels import rotations as R


def _slopes(t: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Slopes at the knots of a cubic spline through chords of slope ``d``; the third derivative is continuous at the second and last but one knot."""
    h = np.diff(t)
    n = len(t)
    if n == 2:
        return np.stack([d[0], d[0]])
    a = np.zeros((n, n))
    b = np.zeros((n, *d.shape[1:]))
    k = np.arange(1, n - 1)
    a[k, k - 1], a[k, k], a[k, k + 1] = h[1:], 2 * (h[:-1] + h[1:]), h[:-1]
    wide = (slice(None),) + (None,) * (d.ndim - 1)
    b[1:-1] = 3 * (h[1:][wide] * d[:-1] + h[:-1][wide] * d[1:])
    if n == 3:  # one parabola
        a[0, :2], b[0] = (1, 1), 2 * d[0]
        a[2, 1:], b[2] = (1, 1), 2 * d[1]
    else:
        for end, x, y, p, q, s in ((0, h[0], h[1], d[0], d[1], 1), (n - 1, h[-1], h[-2], d[-1], d[-2], -1)):
            a[end, end], a[end, end + s] = y, x + y
            b[end] = ((x + 2 * (x + y)) * y * p + x * x * q) / (x + y)
    return np.linalg.solve(a, b.reshape(n, -1)).reshape(b.shape)


def _place(t: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k = np.clip(np.searchsorted(t, at, side="right") - 1, 0, len(t) - 2)
    h = np.diff(t)[k]
    return k, h, (at - t[k]) / h


def cubic(t: np.ndarray, values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Values (n, m) at increasing times ``t``, interpolated at other times."""
    if len(t) < 2:
        return np.repeat(values, len(at), axis=0)
    m = _slopes(t, np.diff(values, axis=0) / np.diff(t)[:, None])
    k, h, u = _place(t, at)
    u, h = u[:, None], h[:, None]
    return (1 + 2 * u) * (1 - u) ** 2 * values[k] + u * (1 - u) ** 2 * h * m[k] + u * u * (3 - 2 * u) * values[k + 1] + u * u * (u - 1) * h * m[k + 1]


def rotation(t: np.ndarray, q: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rotations interpolated with a continuous rate: a cubic of the rotation vector within each stretch."""
    if len(t) < 2:
        return np.repeat(q, len(at), axis=0)
    step = R.log(R.multiply(R.conjugate(q[:-1]), q[1:]))
    rate = _slopes(t, step / np.diff(t)[:, None])
    k, h, u = _place(t, at)
    u, h = u[:, None], h[:, None]
    w1 = _inverse_right_jacobian(step[k], rate[k + 1])
    v = u * (1 - u) ** 2 * h * rate[k] + u * u * (3 - 2 * u) * step[k] + u * u * (u - 1) * h * w1
    return R.multiply(q[k], R.exp(v))


def _inverse_right_jacobian(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """How fast a rotation vector ``v`` changes under a body rate ``w``."""
    angle = np.linalg.norm(v, axis=-1, keepdims=True)
    safe = np.maximum(angle, 1e-6)
    k = np.where(angle > 1e-4, 1 / safe**2 - (1 + np.cos(safe)) / (2 * safe * np.sin(safe)), 1 / 12)
    c = np.cross(v, w)
    return w + c / 2 + k * np.cross(v, c)
