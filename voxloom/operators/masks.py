"""Masks as key-only tables or as 0/1 block rows: thresholds, fallbacks, brain extraction, and values inside a mask only."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.operators.layout import Shape, map_arrays, voxels
from voxloom.operators.spatial import gaussian_taps, resample


def on_grid(mask: DataFrame, mask_shape: Shape, mask_affine: np.ndarray, shape: Shape, affine: np.ndarray, data: str = "data", least: float = 0.5) -> DataFrame:
    """The voxel keys (other columns, z, y, x) of a mask on another grid: resampled wherever its size or its affine differs,
    and ``least`` or more there."""
    rest = [c for c in mask.columns if c != data]
    if tuple(mask_shape) != tuple(shape) or not np.allclose(mask_affine, affine, atol=1e-6):
        mask = map_arrays(mask, data, resample(mask_shape, mask_affine, shape, affine))
    return voxels(mask, shape, data, "_m").filter(F.col("_m") >= least).select(*rest, "z", "y", "x")


def within(rows: DataFrame, mask: DataFrame, at: Sequence[str] = ("z", "y", "x")) -> DataFrame:
    """The rows whose voxel is in the mask."""
    return rows.join(mask.select(*at).distinct(), list(at), "left_semi")


def first_usable(*masks: DataFrame) -> DataFrame:
    """The first mask that has a voxel; the last one if none has. Only one row of each is looked for."""
    for m in masks[:-1]:
        if m.limit(1).count():
            return m
    return masks[-1]


def analysed(series: Column, least: Column) -> Column:
    """Whether a voxel takes part: every scan is finite, not 0 and over the threshold, and the course isn't constant."""
    good = F.forall(series, lambda v: v.isNotNull() & ~F.isnan(v) & (v != 0) & (v > least))
    return F.coalesce(good & (F.array_min(series) < F.array_max(series)), F.lit(False))


def midpoint_percentile(values: np.ndarray, percent: float) -> float:
    """The percentile of a sample by the midpoint rule; NaN without values."""
    v = np.sort(values)
    if not len(v):
        return np.nan
    at = min(max(len(v) * percent / 100 + 0.5, 1.0), float(len(v)))
    low = int(at)
    return float(v[low - 1] + (at - low) * (v[min(low, len(v) - 1)] - v[low - 1]))


def zero_padded(v: np.ndarray, taps: np.ndarray, axis: int) -> np.ndarray:
    """Convolution along one axis; what lies outside counts as 0."""
    radius, n = len(taps) // 2, v.shape[axis]
    wide = np.pad(v, [(radius, radius) if k == axis else (0, 0) for k in range(v.ndim)])
    return sum(w * np.take(wide, np.arange(n) + k, axis) for k, w in enumerate(taps))


def brain(shape: Shape, percent: float = 20.0, sigma: float = 1.0):
    """Kernel for ``layout.map_arrays``: 1 where the smoothed mask of voxels over a percentile of the non-zero ones is over
    a half, 0 elsewhere. ``sigma`` in voxels."""
    nx, ny, nz = shape
    taps = gaussian_taps(sigma * 2 * np.sqrt(2 * np.log(2)), 1.0)

    def kernel(flat):
        cut = np.array([midpoint_percentile(v[v != 0], percent) for v in flat])
        m = (flat > cut[:, None]).astype(float).reshape(len(flat), nz, ny, nx)
        for axis in (3, 2, 1):
            m = zero_padded(m, taps, axis)
        return (m > 0.5).astype(float).reshape(len(flat), -1)

    return kernel


def tissue_brain(maps: Sequence[Column], least: float = 0.2, gamma: float = 1.0, scale: float = 1.0) -> Column:
    """Brain weight of a voxel from its tissue probabilities: the greatest to the power of gamma, 0 below ``least``, scaled."""
    top = F.pow(F.greatest(*maps), F.lit(gamma))
    return F.when(top < least, 0.0).otherwise(top * scale)


def filled(rows: DataFrame, mask: DataFrame, value: str, at: Sequence[str] = ("z", "y", "x"), outside: float = 0.0) -> DataFrame:
    """All rows, with ``outside`` in place of the value where the voxel isn't in the mask."""
    known = mask.select(*at).distinct().withColumn("_in", F.lit(True))
    return rows.join(known, list(at), "left").withColumn(value, F.when(F.col("_in"), F.col(value)).otherwise(F.lit(outside))).drop("_in")
