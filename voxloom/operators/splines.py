"""Cubic B-splines through volumes: coefficients, values and slopes at any point."""

from __future__ import annotations

import numpy as np


def coefficients(v: np.ndarray) -> np.ndarray:
    """Coefficients of the cubic spline through ``v`` (nz x ny x nx), which goes on beyond its edges as in a mirror on the
    outermost voxels."""
    out = np.asarray(v, float)
    for axis, n in enumerate(v.shape):
        if n > 1:
            m = np.diag(np.full(n, 4 / 6)) + np.diag(np.full(n - 1, 1 / 6), 1) + np.diag(np.full(n - 1, 1 / 6), -1)
            m[0, 1] += 1 / 6
            m[-1, -2] += 1 / 6
            out = np.moveaxis(np.tensordot(np.linalg.inv(m), out, (1, axis)), 0, axis)
    return out


def _taps(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For places along an axis of ``n`` voxels: the four voxels each, their weights, and the weights' slopes."""
    if n == 1:
        one = np.ones((1, len(at)))
        return np.zeros((1, len(at)), int), one, 0 * one
    low = np.floor(at).astype(int)
    t = at - low
    w = np.stack([(1 - t) ** 3, 3 * t**3 - 6 * t**2 + 4, -3 * t**3 + 3 * t**2 + 3 * t + 1, t**3]) / 6
    d = np.stack([-((1 - t) ** 2), 3 * t**2 - 4 * t, -3 * t**2 + 2 * t + 1, t**2]) / 2
    k = np.abs(low + np.arange(-1, 3)[:, None]) % (2 * n - 2)
    return np.minimum(k, 2 * n - 2 - k), w, d


def sample(c: np.ndarray, points: np.ndarray, slopes: bool = False):
    """Values of the spline with coefficients ``c`` at ``points`` (m x 3, xyz from 0); with ``slopes`` also the m x 3
    slopes along x, y and z."""
    (zk, zw, zd), (yk, yw, yd), (xk, xw, xd) = (_taps(points[:, a], c.shape[2 - a]) for a in (2, 1, 0))
    value, slope = np.zeros(len(points)), np.zeros((len(points), 3))
    for i in range(len(zk)):
        for j in range(len(yk)):
            line = [c[zk[i], yk[j], k] for k in xk]
            along = sum(w * v for w, v in zip(xw, line, strict=True))
            value += zw[i] * yw[j] * along
            if slopes:
                slope[:, 0] += zw[i] * yw[j] * sum(d * v for d, v in zip(xd, line, strict=True))
                slope[:, 1] += zw[i] * yd[j] * along
                slope[:, 2] += zd[i] * yw[j] * along
    return (value, slope) if slopes else value
