"""Scalar functions as Column expressions and their numpy twins."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the rational approximation of the error function (absolute error below 1.5e-7).
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x: Column) -> Column:
    t = 1 / (1 + ERF_P * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def erf_sql(x: str) -> str:
    t = f"(1 / (1 + {ERF_P} * abs({x})))"
    poly = "0.0"
    for a in reversed(ERF_A):
        poly = f"(({poly} + {a}) * {t})"
    return f"(sign({x}) * (1 - {poly} * exp(-({x}) * ({x}))))"


def normal_p(t: Column, tails: int = 2) -> Column:
    """Tail probability of a standard normal value."""
    return 1 - erf(F.abs(t) / math.sqrt(2)) if tails == 2 else (1 - erf(t / math.sqrt(2))) / 2


def _beta_fraction(a: float, b: float, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function, for all x at once."""
    kept = lambda v: np.where(np.abs(v) > 1e-300, v, 1e-300)
    c, d = np.ones_like(x), 1.0 / kept(1.0 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1.0 / kept(1.0 + top * d), kept(1.0 + top / c)
            h *= d * c
        if (np.abs(d * c - 1) < 1e-15).all():
            break
    return h


def incomplete_beta(a: float, b: float, x) -> np.ndarray:
    """Regularised incomplete beta function."""
    shape, x = np.shape(x), np.atleast_1d(np.asarray(x, float))
    out = (x >= 1).astype(float)
    inside = (x > 0) & (x < 1)
    u = x[inside]
    front = np.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * np.log(u) + b * np.log1p(-u))
    low = u < (a + 1) / (a + b + 2)
    part = np.empty_like(u)
    part[low] = front[low] * _beta_fraction(a, b, u[low]) / a
    part[~low] = 1 - front[~low] * _beta_fraction(b, a, 1 - u[~low]) / b
    out[inside] = part
    return out.reshape(shape)


def t_p(t: np.ndarray, df: float, tails: int = 2) -> np.ndarray:
    """Exact tail probability of Student's t."""
    t = np.asarray(t, float)
    two = np.where(np.isnan(t), np.nan, incomplete_beta(df / 2, 0.5, np.where(np.isnan(t), 0.0, df / (df + np.square(t)))))
    return two if tails == 2 else np.where(t > 0, two / 2, 1 - two / 2)


def gamma_pdf(x: Column, shape: int, rate: float = 1.0) -> Column:
    """Density of the gamma distribution with a whole shape; 0 for x <= 0."""
    return F.when(x > 0, F.pow(F.lit(rate), F.lit(shape)) * F.pow(x, F.lit(shape - 1)) * F.exp(-rate * x) / math.factorial(shape - 1)).otherwise(0.0)


def hrf(t: np.ndarray, peak: float = 6, undershoot: float = 16, ratio: float = 6) -> np.ndarray:
    """Canonical response: a gamma density less a sixth of a later one, with its peak at 1."""
    pdf = lambda a: np.where(t > 0, np.power(np.maximum(t, 1e-300), a - 1) * np.exp(-t) / math.gamma(a), 0.0)
    h = pdf(peak) - pdf(undershoot) / ratio
    return h / h.max()


def saturated(x: Column, low: int, high: int, kind: str) -> Column:
    """Round half away from zero, clamp, cast: how whole-number voxels are written."""
    return F.greatest(F.least(F.round(x), F.lit(float(high))), F.lit(float(low))).cast(kind)


def quaternion_affine(b: float, c: float, d: float, offset, pixdim) -> np.ndarray:
    """Affine of a unit quaternion; pixdim[0] is the handedness, 0 counts as 1."""
    a = math.sqrt(max(1 - b * b - c * c - d * d, 0.0))
    r = np.array(
        [
            [a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)],
            [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)],
            [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c],
        ]
    )
    out = np.eye(4)
    out[:3, :3] = r * np.array([pixdim[1], pixdim[2], pixdim[3] * (-1.0 if pixdim[0] < 0 else 1.0)])
    out[:3, 3] = offset
    return out
