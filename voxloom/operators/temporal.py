"""Temporal operators over series rows: small matrices built once and sent with the task, no shuffle."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.operators.relational import percentile
from voxloom.session import settled


def fourier_shift(dt: float, tr: float, pad: str | None = None):
    """Delay every series by ``dt`` seconds: x(t) becomes x(t - dt). Without padding the ends wrap around; ``ramp``
    pads with a line from the last value to the first."""

    def kernel(y):
        n = y.shape[1]
        if pad == "ramp":
            m = 2 ** (int(math.log2(n)) + 1)
            ramp = y[:, -1:] + (y[:, :1] - y[:, -1:]) * (np.arange(1, m - n + 1) / (m - n + 1))[None, :]
            y = np.concatenate([y, ramp], 1)
        f = np.fft.rfftfreq(y.shape[1], tr)
        return np.fft.irfft(np.fft.rfft(y, axis=1) * np.exp(-2j * np.pi * f * dt), y.shape[1], axis=1)[:, :n]

    return kernel


def dct_basis(n: int, tr: float, cutoff: float, legacy: bool = False) -> np.ndarray:
    """n x k orthonormal DCT-II columns of periods over ``cutoff`` seconds, without the constant. ``legacy``: plain cosines
    without the half-sample offset, which are neither normal nor orthogonal."""
    k = int(2 * n * tr / cutoff + 1)
    t = np.arange(n)
    if k < 2:
        return np.zeros((n, 0))
    if legacy:
        return np.stack([np.cos(np.pi * t * j / n) for j in range(1, k)], 1)
    return np.stack([math.sqrt(2 / n) * np.cos(np.pi * (2 * t + 1) * j / (2 * n)) for j in range(1, k)], 1)


def high_pass(n: int, tr: float, cutoff: float):
    """Take the slow DCT part out of every series."""
    b = dct_basis(n, tr, cutoff)
    return lambda y: y - (y @ b) @ b.T


def lag1(series: Column) -> Column:
    """Lag-1 autocorrelation of one series: sum of x(t) x(t-1) over sum of x(t-1)^2."""
    n = F.size(series)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    before, after = F.slice(series, F.lit(1), n - 1), F.slice(series, F.lit(2), n - 1)
    return F.when(n > 1, dot(after, before) / (dot(before, before) + 2.220446049250313e-16))


def global_rho(rows: DataFrame, series: str = "series") -> float:
    """The median lag-1 autocorrelation over all voxels, kept within [-0.5, 0.95]."""
    rhos = settled(rows.select(lag1(F.col(series)).alias("rho")))  # read several times
    found = percentile(rhos, [], "rho", 50, "linear").first()
    return max(-0.5, min(0.95, found["percentile"] if found else 0.0))


def whiten(series: Column, rho: float) -> Column:
    """AR(1) prewhitening; left alone for a tiny rho or fewer than three scans."""
    n = F.size(series)
    moved = F.zip_with(F.slice(series, F.lit(2), n - 1), F.slice(series, F.lit(1), n - 1), lambda a, b: a - F.lit(rho) * b)
    out = F.concat(F.array(series[0] * math.sqrt(1 - rho * rho)), moved)
    return series if abs(rho) < 1e-4 else F.when(n >= 3, out).otherwise(series)
