"""Kernels beyond trilinear sampling: B-splines, fields of view, integrated smoothing kernels, modulation, rescaling.

All are kernels for ``layout.map_arrays`` or functions on volumes (n x nz x ny x nx); what lies outside is NaN."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxloom.operators.layout import Shape
from voxloom.operators.masks import zero_padded
from voxloom.operators.spatial import trilinear


def in_view(points: np.ndarray, shape: Shape, tolerance: float = 0.05, wrap: tuple[bool, bool, bool] = (False, False, False)) -> np.ndarray:
    """Whether points (xyz from 0) lie in the volume, give or take ``tolerance`` voxels; wrapped axes have no ends."""
    ok = (points >= -tolerance) & (points <= np.array(shape) - 1 + tolerance)
    return (ok | np.array(wrap)).all(1)


def visible(at: list[Column], shape: Shape, tolerance: float = 0.05) -> Column:
    """The same for columns."""
    out = F.lit(True)
    for c, n in zip(at, shape, strict=True):
        out = out & (c >= -tolerance) & (c <= n - 1 + tolerance)
    return out


def _cubic(x: np.ndarray) -> np.ndarray:
    """The centred cubic B-spline."""
    a = np.abs(x)
    return np.where(a < 1, 2 / 3 - a * a + a**3 / 2, np.where(a < 2, (2 - a) ** 3 / 6, 0.0))


def spline_coefficients(v: np.ndarray) -> np.ndarray:
    """Coefficients whose cubic spline passes through the samples; the volume is mirrored at its edges."""
    for axis in (1, 2, 3):
        n = v.shape[axis]
        if n < 2:
            continue
        m = np.zeros((n, n))
        for i in range(n):
            for step, w in ((-1, 1 / 6), (0, 2 / 3), (1, 1 / 6)):
                j = i + step
                m[i, -j if j < 0 else 2 * n - 2 - j if j >= n else j] += w
        v = np.moveaxis(np.tensordot(np.linalg.inv(m), v, (1, axis)), 0, axis)
    return v


def spline(v: np.ndarray, points: np.ndarray, degree: int = 3) -> np.ndarray:
    """Values at points (m x 3): n x m. Degree 0 takes the nearest sample, as labels need, 1 is trilinear, 3 cubic."""
    size = np.array(v.shape[:0:-1])
    if degree == 0:
        at = np.clip(np.floor(points + 0.5).astype(int), 0, size - 1)
        return v[:, at[:, 2], at[:, 1], at[:, 0]]
    points = np.clip(points, 0, size - 1)
    if degree == 1:
        return trilinear(v, points)
    c = spline_coefficients(v)
    low = np.floor(points).astype(int)
    out = np.zeros((len(v), len(points)))
    mirror = lambda k, n: np.where(k < 0, -k, np.where(k >= n, 2 * n - 2 - k, k)) if n > 1 else np.zeros_like(k)
    for dz in range(-1, 3):
        for dy in range(-1, 3):
            for dx in range(-1, 3):
                at = low + np.array([dx, dy, dz])
                w = _cubic(points - at).prod(1)
                x, y, z = (mirror(at[:, k], size[k]) for k in range(3))
                out += w * c[:, z, y, x]
    return out


def reslice(shape: Shape, points: np.ndarray, degree: int = 3, visible_in_all: np.ndarray | None = None):
    """Kernel: volumes at ``points``; NaN where a point is out of view, or out of the common view of all scans."""
    nx, ny, nz = shape
    ok = in_view(points, shape) if visible_in_all is None else visible_in_all

    def kernel(flat):
        out = spline(flat.reshape(len(flat), nz, ny, nx), points, degree)
        out[:, ~ok] = np.nan
        return out

    return kernel


def common_view(all_points: list[np.ndarray], shape: Shape) -> np.ndarray:
    """Which points every scan sees."""
    return np.all([in_view(p, shape) for p in all_points], axis=0)


def sheared(volume: np.ndarray, axis: int, along: int, factor: float) -> np.ndarray:
    """Each line along ``axis`` moved by ``factor`` times its place along another axis, in the Fourier domain: one of the
    shears that a rigid turn is made of. Lines wrap around."""
    n, m = volume.shape[axis], volume.shape[along]
    shift = factor * (np.arange(m) - (m - 1) / 2)
    f = np.fft.rfftfreq(n)
    turn = np.exp(-2j * np.pi * np.multiply.outer(shift, f))
    lines = np.moveaxis(volume, (along, axis), (-2, -1))
    return np.moveaxis(np.fft.irfft(np.fft.rfft(lines, axis=-1) * turn, n, axis=-1), (-2, -1), (along, axis))


def turned(plane: np.ndarray, angle: float) -> np.ndarray:
    """A plane (y, x) turned about its middle by three Fourier shears."""
    a, b = -math.tan(angle / 2), math.sin(angle)
    return sheared(sheared(sheared(plane, 1, 0, a), 0, 1, b), 1, 0, a)


def integrated_taps(fwhm: float, voxel: float) -> np.ndarray:
    """A Gaussian convolved with linear interpolation, out to six standard deviations, normalised."""
    s = fwhm / voxel / math.sqrt(8 * math.log(2))
    if s <= 0:
        return np.ones(1)
    radius = round(6 * s)
    x = np.arange(-radius - 1, radius + 2, dtype=float)
    # the second antiderivative of the Gaussian; the triangle is a second difference
    second = x * np.array([0.5 * (1 + math.erf(v / s / math.sqrt(2))) for v in x]) + s / math.sqrt(2 * math.pi) * np.exp(-0.5 * (x / s) ** 2)
    taps = np.maximum(second[2:] - 2 * second[1:-1] + second[:-2], 0.0)
    return taps / taps.sum()


def smooth_integrated(shape: Shape, fwhm: float, voxel: tuple[float, float, float]):
    """Kernel: separable smoothing with the integrated taps; outside counts as 0."""
    nx, ny, nz = shape

    def kernel(flat):
        v = flat.reshape(len(flat), nz, ny, nx)
        for axis in (3, 2, 1):
            v = zero_padded(v, integrated_taps(fwhm, voxel[3 - axis]), axis)
        return v.reshape(len(flat), -1)

    return kernel


def jacobian(u: np.ndarray) -> np.ndarray:
    """Determinant of x -> x + u(x) for displacements (3 x nz x ny x nx, components x, y, z)."""
    slopes = np.array([[np.gradient(c, axis=2 - j) for j in range(3)] for c in u])
    slopes += np.eye(3)[:, :, None, None, None]
    return np.linalg.det(np.moveaxis(slopes, (0, 1), (-2, -1)))


def modulated(v: np.ndarray, u: np.ndarray, power: float = 1.0) -> np.ndarray:
    """Volumes times the Jacobian's determinant to a power, which keeps amounts when space is stretched."""
    return v * jacobian(u)[None] ** power


def bytes_levels(rows: DataFrame, by: list[str], value: str, bins: int = 2048, share: float = 0.9999) -> DataFrame:
    """Adds ``level``, 0 to 255: the range is cut where a histogram of ``bins`` bins holds ``share`` of the voxels."""
    ends = rows.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_n"))
    width = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0)
    binned = rows.join(ends, by).withColumn("_bin", F.floor((F.col(value) - F.col("_lo")) / width * (bins - 1)).cast("int"))
    upto = F.sum("_c").over(Window.partitionBy(*by).orderBy("_bin"))
    counts = binned.groupBy(*by, "_bin", "_n").agg(F.count("*").alias("_c")).withColumn("_upto", upto)
    cut = counts.filter(F.col("_upto") >= F.col("_n") * share).groupBy(*by).agg(F.min("_bin").alias("_cut"))
    top = F.col("_lo") + (F.col("_cut") + 1) / (bins - 1) * width
    scaled = F.round((F.least(F.col(value), top) - F.col("_lo")) / (top - F.col("_lo")) * 255)
    return binned.join(cut, by).withColumn("level", F.least(F.greatest(scaled, F.lit(0.0)), F.lit(255.0)).cast("int")).drop("_lo", "_hi", "_n", "_bin", "_cut")
