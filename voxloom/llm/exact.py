"""Exact integer inner products by numpy, at any size of the components."""

from __future__ import annotations

import numpy as np

FLOAT, LONG = 2.0**53, 2.0**63


def reach(a: np.ndarray, b: np.ndarray) -> float:
    """A bound of all partial sums of inner products of rows of ``a`` with rows of ``b``."""
    most = lambda x: float(np.abs(x.astype(np.float64)).max(initial=0.0))
    return most(a) * most(b) * max(1, a.shape[-1]) * (1 + 1e-9)


def clipped(values: np.ndarray) -> np.ndarray:
    """Python integers as longs; what lies beyond a long becomes the nearest one."""
    return np.array([min(max(v, -(2**63)), 2**63 - 1) for v in values.ravel().tolist()], np.int64).reshape(values.shape)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of the rows of two matrices of longs, as longs: by floats while these hold every partial sum
    exactly, else by longs, else by Python integers, clipped to a long."""
    most = reach(a, b)
    if most < FLOAT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < LONG:
        return a @ b.T
    return clipped(a.astype(object) @ b.T.astype(object))


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of row k of ``a`` with row k of ``b``, likewise."""
    most = reach(a, b)
    if most < FLOAT:
        return np.einsum("ij,ij->i", a.astype(np.float64), b.astype(np.float64)).astype(np.int64)
    if most < LONG:
        return np.einsum("ij,ij->i", a, b)
    return clipped((a.astype(object) * b.astype(object)).sum(1) if len(a) else np.zeros(0, object))
