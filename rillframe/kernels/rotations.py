"""Rotations as arrays: quaternions w, x, y, z along the last axis."""

from __future__ import annotations

import numpy as np

Array = np.ndarray


def multiply(a: Array, b: Array) -> Array:
    """First ``b``, then ``a``."""
    w, v = a[..., :1], a[..., 1:]
    s, u = b[..., :1], b[..., 1:]
    return np.concatenate([w * s - (v * u).sum(-1, keepdims=True), w * u + s * v + np.cross(v, u)], axis=-1)


def conjugate(q: Array) -> Array:
    """The inverse rotation."""
    return q * np.array([1.0, -1.0, -1.0, -1.0])


def normalize(q: Array) -> Array:
    """Unit length."""
    return q / np.linalg.norm(q, axis=-1, keepdims=True)


def rotate(q: Array, v: Array) -> Array:
    """Vectors turned by unit quaternions."""
    t = 2 * np.cross(q[..., 1:], v)
    return v + q[..., :1] * t + np.cross(q[..., 1:], t)


def exp(v: Array) -> Array:
    """The quaternions of rotation vectors."""
    angle = np.linalg.norm(v, axis=-1, keepdims=True)
    k = np.where(angle > 1e-8, np.sin(angle / 2) / np.maximum(angle, 1e-300), 0.5 - angle * angle / 48)
    return np.concatenate([np.cos(angle / 2), k * v], axis=-1)


def log(q: Array) -> Array:
    """The rotation vectors, at most a half turn, of unit quaternions."""
    q = np.where(q[..., :1] < 0, -q, q)
    n = np.linalg.norm(q[..., 1:], axis=-1, keepdims=True)
    angle = 2 * np.arctan2(n, q[..., :1])
    return q[..., 1:] * np.where(n > 1e-8, angle / np.maximum(n, 1e-300), 2.0)


def to_matrix(q: Array) -> Array:
    """Rotation matrices."""
    eye = np.eye(3)
    return np.stack([rotate(q, np.broadcast_to(eye[k], (*q.shape[:-1], 3))) for k in range(3)], axis=-1)
