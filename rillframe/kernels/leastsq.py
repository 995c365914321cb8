"""Levenberg-Marquardt: dense for small problems, blockwise with conjugate gradients for graphs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np


def fit(residual: Callable[[np.ndarray], np.ndarray], x: np.ndarray, iterations: int = 30, tolerance: float = 1e-12) -> tuple[np.ndarray, float, int]:
    """A least-squares point near ``x``, its cost and the number of steps; derivatives are differences."""
    x = np.asarray(x, float).copy()
    r = residual(x)
    cost, damp, steps = float(r @ r), 1e-3, 0
    for steps in range(1, iterations + 1):  # noqa: B007
        e = 1e-6 * np.maximum(np.abs(x), 1.0)
        jac = np.stack([(residual(x + e * (np.arange(len(x)) == k)) - residual(x - e * (np.arange(len(x)) == k))) / (2 * e[k]) for k in range(len(x))], axis=1)
        hess, grad = jac.T @ jac, jac.T @ r
        for _ in range(8):
            move = np.linalg.solve(hess + damp * np.diag(np.maximum(np.diag(hess), 1e-9)), -grad)
            r2 = residual(x + move)
            c2 = float(r2 @ r2)
            if c2 < cost:
                break
            damp *= 10
        else:
            break
        done = cost - c2 <= tolerance * max(cost, 1e-30)
        x, r, cost, damp = x + move, r2, c2, max(damp / 10, 1e-12)
        if done:
            break
    return x, cost, steps


@dataclass
class Factor:
    """Residual rows of one kind: ``evaluate(blocks)`` of the states at ``variables`` (rows, arity) gives (rows, size)."""

    variables: np.ndarray
    evaluate: Callable[[Sequence[np.ndarray]], np.ndarray]


def solve_graph(states: np.ndarray, dims: np.ndarray, retract: Callable[[np.ndarray, np.ndarray], np.ndarray], factors: Sequence[Factor], iterations: int = 20) -> tuple[np.ndarray, float, float]:
    """States (n, m) moved by ``retract`` along up to six directions each so that the factors' squares are least.

    ``dims`` says how many directions a state has. Derivatives are differences taken for all rows of a
    factor at once; steps are solved by conjugate gradients on the normal equations, so neither time nor
    memory exceeds the number of factor rows. Returns the states, the first and the last cost.
    """
    width, eps = int(dims.max()), 1e-6
    live = (np.arange(width)[None, :] < dims[:, None]).astype(float)

    def residuals(s: np.ndarray) -> list[np.ndarray]:
        return [f.evaluate([s[f.variables[:, k]] for k in range(f.variables.shape[1])]) for f in factors]

    cost = first = float(sum((r * r).sum() for r in residuals(states)))
    damp = 1e-4
    for _ in range(iterations):
        rs = residuals(states)
        jacs = []
        for f, r in zip(factors, rs):
            blocks = [states[f.variables[:, k]] for k in range(f.variables.shape[1])]
            j = np.zeros((r.shape[0], r.shape[1], f.variables.shape[1], width))
            for k in range(f.variables.shape[1]):
                for d in range(width):
                    move = np.zeros((len(blocks[k]), width))
                    move[:, d] = eps
                    plus, minus = list(blocks), list(blocks)
                    plus[k], minus[k] = retract(blocks[k], move), retract(blocks[k], -move)
                    j[:, :, k, d] = (f.evaluate(plus) - f.evaluate(minus)) / (2 * eps) * live[f.variables[:, k], d][:, None]
            jacs.append(j)
        grad, diag = np.zeros((len(states), width)), np.zeros((len(states), width))
        for f, r, j in zip(factors, rs, jacs):
            for k in range(f.variables.shape[1]):
                np.add.at(grad, f.variables[:, k], np.einsum("nrd,nr->nd", j[:, :, k], r))
                np.add.at(diag, f.variables[:, k], (j[:, :, k] ** 2).sum(axis=1))
        better = False
        for _ in range(8):
            step = _conjugate_gradients(factors, jacs, -grad, damp * np.maximum(diag, 1e-9), diag + damp * np.maximum(diag, 1e-9) + 1e-12)
            moved = retract(states, step * live)
            c2 = float(sum((r * r).sum() for r in residuals(moved)))
            if c2 < cost:
                better = True
                break
            damp *= 10
        if not better:
            break
        done = cost - c2 < 1e-12 * max(cost, 1e-30)
        states, cost, damp = moved, c2, max(damp / 10, 1e-10)
        if done:
            break
    return states, first, cost


def _conjugate_gradients(factors: Sequence[Factor], jacs: Sequence[np.ndarray], b: np.ndarray, ridge: np.ndarray, pre: np.ndarray, most: int = 400) -> np.ndarray:
    def apply(x: np.ndarray) -> np.ndarray:
        out = ridge * x
        for f, j in zip(factors, jacs):
            y = sum(np.einsum("nrd,nd->nr", j[:, :, k], x[f.variables[:, k]]) for k in range(f.variables.shape[1]))
            for k in range(f.variables.shape[1]):
                np.add.at(out, f.variables[:, k], np.einsum("nrd,nr->nd", j[:, :, k], y))
        return out

    x, r = np.zeros_like(b), b.copy()
    z = r / pre
    p, rz = z.copy(), float((r * z).sum())
    goal = 1e-20 * max(float((b * b).sum()), 1e-300)
    for _ in range(most):
        if float((r * r).sum()) <= goal:
            break
        ap = apply(p)
        alpha = rz / max(float((p * ap).sum()), 1e-300)
        x += alpha * p
        r -= alpha * ap
        z = r / pre
        new = float((r * z).sum())
        p, rz = z + new / max(rz, 1e-300) * p, new
    return x
