"""Spatial kernels over block rows: numpy on whole Arrow batches, no shuffle.

Arrays are volumes x nz x ny x nx. Every function returns a kernel for ``layout.map_arrays``.
"""

from __future__ import annotations

import math

import numpy as np

from voxloom.operators.layout import Shape


def gaussian_taps(fwhm: float, voxel: float) -> np.ndarray:
    """Normalised weights out to three standard deviations; a single 1 for no width."""
    sigma = fwhm / voxel / (2 * math.sqrt(2 * math.log(2)))
    if sigma <= 0:
        return np.ones(1)
    radius = math.ceil(3 * sigma)
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return w / w.sum()


def _volumes(flat: np.ndarray, shape: Shape) -> np.ndarray:
    nx, ny, nz = shape
    return flat.reshape(len(flat), nz, ny, nx)


def convolve_axis(v: np.ndarray, taps: np.ndarray, axis: int) -> np.ndarray:
    """Edges repeat."""
    n, radius = v.shape[axis], len(taps) // 2
    out = np.zeros_like(v)
    for k, w in enumerate(taps):
        out += w * np.take(v, np.clip(np.arange(n) + k - radius, 0, n - 1), axis)
    return out


def smooth(shape: Shape, fwhm: float, voxel: tuple[float, float, float], axes: str = "xyz"):
    """Separable Gaussian smoothing along the named axes."""

    def kernel(flat):
        v = _volumes(flat, shape)
        for a in axes:
            v = convolve_axis(v, gaussian_taps(fwhm, voxel["xyz".index(a)]), 3 - "xyz".index(a))
        return v.reshape(len(flat), -1)

    return kernel


def laplacian(shape: Shape):
    """Sum of the differences to the six neighbours; a missing neighbour adds nothing."""

    def kernel(flat):
        v = _volumes(flat, shape)
        out = np.zeros_like(v)
        for axis in (1, 2, 3):
            d = np.diff(v, axis=axis)
            low, high = [slice(None)] * 4, [slice(None)] * 4
            low[axis], high[axis] = slice(0, -1), slice(1, None)
            out[tuple(low)] += d
            out[tuple(high)] -= d
        return out.reshape(len(flat), -1)

    return kernel


def gradient(shape: Shape, axis: str):
    """Central differences along ``axis``, one-sided at the ends."""
    return lambda flat: np.gradient(_volumes(flat, shape), axis=3 - "xyz".index(axis)).reshape(len(flat), -1)


def pool(shape: Shape, scale: int):
    """Means of scale^3 cells; a remainder at the upper end is dropped."""
    nx, ny, nz = (n // scale for n in shape)

    def kernel(flat):
        v = _volumes(flat, shape)[:, : nz * scale, : ny * scale, : nx * scale]
        return v.reshape(len(flat), nz, scale, ny, scale, nx, scale).mean((2, 4, 6)).reshape(len(flat), -1)

    return kernel


def trilinear(v: np.ndarray, points: np.ndarray, legacy_edge: bool = False) -> np.ndarray:
    """Values of volumes (n x nz x ny x nx) at ``points`` (m x 3, xyz from 0): n x m; 0 outside the grid.

    ``legacy_edge``: samples in the last cell take its lower corner's value along that axis."""
    size = np.array(v.shape[:0:-1])
    inside = ((points >= 0) & (points <= size - 1)).all(1)
    low = np.clip(np.floor(points).astype(int), 0, np.maximum(size - 2, 0))
    frac = np.clip(points - low, 0, 1)
    if legacy_edge:
        frac = np.where(points > size - 2, 0.0, frac)
    out = np.zeros((len(v), len(points)))
    for corner in range(8):
        step = np.array([corner & 1, corner >> 1 & 1, corner >> 2 & 1])
        at = np.minimum(low + step, size - 1)
        w = np.where(step, frac, 1 - frac).prod(1) * inside
        out += w * v[:, at[:, 2], at[:, 1], at[:, 0]]
    return out


def trilinear_each(v: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Values of images (n x images x nz x ny x nx) at points of their own (n x m x 3): n x images x m; 0 outside the grid."""
    n, images = v.shape[:2]
    size = np.array(v.shape[:1:-1])
    inside = ((points >= 0) & (points <= size - 1)).all(2)
    low = np.clip(np.floor(points).astype(int), 0, np.maximum(size - 2, 0))
    frac = np.clip(points - low, 0, 1)
    flat, first = np.ascontiguousarray(v).reshape(-1), (np.arange(n * images) * size.prod()).reshape(n, images, 1)
    out = np.zeros((n, images, points.shape[1]))
    for corner in range(8):
        step = np.array([corner & 1, corner >> 1 & 1, corner >> 2 & 1])
        x, y, z = np.moveaxis(np.minimum(low + step, size - 1), 2, 0)
        wx, wy, wz = (frac[:, :, a] if step[a] else 1 - frac[:, :, a] for a in range(3))
        out += (wx * wy * wz * inside)[:, None] * flat[first + (x + size[0] * (y + size[1] * z))[:, None]]
    return out


def grid(shape: Shape) -> np.ndarray:
    """Voxel coordinates (xyz) in the order of block values."""
    nx, ny, nz = shape
    z, y, x = np.meshgrid(np.arange(nz), np.arange(ny), np.arange(nx), indexing="ij")
    return np.stack([x.ravel(), y.ravel(), z.ravel()], 1).astype(float)


def resample(shape: Shape, source_affine: np.ndarray, target_shape: Shape, target_affine: np.ndarray):
    """Each target voxel's value at the source position with the same world coordinates."""
    to_source = np.linalg.inv(source_affine) @ target_affine
    points = grid(target_shape) @ to_source[:3, :3].T + to_source[:3, 3]
    return lambda flat: trilinear(_volumes(flat, shape), points)


def sample_at(shape: Shape, points: np.ndarray, legacy_edge: bool = False):
    return lambda flat: trilinear(_volumes(flat, shape), points, legacy_edge)


def push(shape: Shape, points: np.ndarray, target_shape: Shape, floor: float = 0.001):
    """Scatter: each source voxel gives its value to the eight cells around its target position; sums over
    (weights + floor). The adjoint of trilinear sampling."""
    nx, ny, nz = target_shape
    size = np.array(target_shape)
    low = np.floor(points).astype(int)
    frac = points - low

    def kernel(flat):
        f, c = np.zeros((len(flat), nx * ny * nz)), np.zeros(nx * ny * nz)
        for corner in range(8):
            step = np.array([corner & 1, corner >> 1 & 1, corner >> 2 & 1])
            at = low + step
            ok = ((at >= 0) & (at < size)).all(1)
            w = np.where(step, frac, 1 - frac).prod(1)[ok]
            k = at[ok, 0] + nx * (at[ok, 1] + ny * at[ok, 2])
            np.add.at(c, k, w)
            np.add.at(f.T, k, (flat[:, ok] * w).T)
        return f / (c + floor)

    return kernel


def rigid(p) -> np.ndarray:
    """4 x 4 matrix of (tx, ty, tz, rx, ry, rz): turns about x, then y, then z, then the shift."""
    tx, ty, tz, rx, ry, rz = p
    cx, sx, cy, sy, cz, sz = math.cos(rx), math.sin(rx), math.cos(ry), math.sin(ry), math.cos(rz), math.sin(rz)
    x = np.array([[1, 0, 0], [0, cx, -sx], [0, sx, cx]])
    y = np.array([[cy, 0, sy], [0, 1, 0], [-sy, 0, cy]])
    z = np.array([[cz, -sz, 0], [sz, cz, 0], [0, 0, 1]])
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = z @ y @ x, (tx, ty, tz)
    return out
