"""Smooth brightness fields of volumes: a mixture of tissue classes and a few cosine waves, fitted in turn.

A voxel's logarithm is its class's mean plus the field plus noise. One pass over the voxels gives, for every volume, the sums
that both updates need: responsibilities and moments of the classes about the present field, and the weighted normal
equations of the field about the present classes. Tasks add up their own voxels; a volume's parameters are one small row.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.operators.layout import Shape, matrix
from voxloom.session import settled

PARAMETERS = "means array<double>, variances array<double>, shares array<double>, waves array<double>"


def terms(order: int) -> list[tuple[int, int, int]]:
    """The waves along x, y and z with fewer than ``order`` half turns each, without the constant."""
    return [t for t in itertools.product(range(order), repeat=3) if any(t)]


def basis(shape: Shape, order: int, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    wave = lambda c, n, k: np.cos(np.pi * (2 * c + 1) * k / (2 * n))
    along = [np.stack([wave(c, n, k) for k in range(order)], 1) for c, n in zip((x, y, z), shape, strict=True)]
    return np.stack([along[0][:, i] * along[1][:, j] * along[2][:, k] for i, j, k in terms(order)], 1)


def field(shape: Shape, order: int, waves: Column) -> Column:
    """The field of a voxel (columns x, y, z) from the waves' sizes."""
    wave = lambda c, n, k: F.cos(math.pi * (2 * F.col(c) + 1) * k / (2 * n)) if k else F.lit(1.0)
    return sum((waves[at] * wave("x", shape[0], i) * wave("y", shape[1], j) * wave("z", shape[2], k) for at, (i, j, k) in enumerate(terms(order))), F.lit(0.0))


def bias_field(voxels: DataFrame, by: str, shape: Shape, classes: int = 2, order: int = 3, rounds: int = 12, penalty: float = 1e-3, value: str = "v") -> DataFrame:
    """(by, means, variances, shares, waves) of every volume, after ``rounds`` passes.

    Classes start at evenly spaced ranks of the logarithms. ``penalty`` holds small waves down, as a share of the mean weight.
    Defined results: values that are null, not finite or not above 0 take no part; a volume without others has no row; a class
    that loses its voxels keeps its mean."""
    usable = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & (F.col(value) > 0) & (F.col(value) < float("inf"))
    rows = settled(voxels.filter(usable).select(by, "x", "y", "z", F.log(F.col(value).cast("double")).alias("u")))
    kind, waves, size = rows.schema[by].dataType.simpleString(), terms(order), len(terms(order))
    ranks = F.percentile_approx("u", [(k + 0.5) / classes for k in range(classes)], 10_000)
    spread = F.greatest(F.var_pop("u"), F.lit(1e-6)) / classes
    state = settled(rows.groupBy(by).agg(ranks.alias("means"), F.array_repeat(spread, classes).alias("variances")).select(by, "means", "variances", F.array_repeat(F.lit(1.0 / classes), classes).alias("shares"), F.array_repeat(F.lit(0.0), size).alias("waves")))

    def sums(batches):
        held: dict = {}
        for b in batches:
            keys = b.column(by).dictionary_encode()
            code = keys.indices.to_numpy(zero_copy_only=False)
            x, y, z, u = (b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y", "z", "u"))
            means, variances, shares, own = (matrix(b.column(c)) for c in ("means", "variances", "shares", "waves"))
            phi = basis(shape, order, x, y, z)
            rest = u - (phi * own).sum(1)
            log = np.log(np.maximum(shares, 1e-300)) - 0.5 * np.log(variances) - 0.5 * (rest[:, None] - means) ** 2 / variances
            p = np.exp(log - log.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            weight = (p / variances).sum(1)
            pull = (p * (u[:, None] - means) / variances).sum(1)
            for k, key in enumerate(keys.dictionary.to_pylist()):
                at = code == k
                q, f = p[at], phi[at]
                part = np.concatenate([q.sum(0), (q * rest[at, None]).sum(0), (q * rest[at, None] ** 2).sum(0), (f.T @ (f * weight[at, None])).ravel(), f.T @ pull[at]])
                held[key] = held.get(key, 0.0) + part
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), b.column(by).type), pa.array(list(held.values()), pa.list_(pa.float64()))], [by, "part"])

    def updated(group: pa.Table) -> pa.Table:
        total = matrix(group.column("part")).sum(0)
        old = {c: matrix(group.column(c).slice(0, 1))[0] for c in ("means", "variances")}
        n, first, second = total[:classes], total[classes : 2 * classes], total[2 * classes : 3 * classes]
        normal, right = total[3 * classes :][: size * size].reshape(size, size), total[-size:]
        alive = n > 1e-9
        means = np.where(alive, first / np.where(alive, n, 1), old["means"])
        variances = np.where(alive, np.maximum(second / np.where(alive, n, 1) - means**2, 1e-6), old["variances"])
        found = np.linalg.solve(normal + penalty * np.trace(normal) / size * np.eye(size), right)
        out = [means, variances, n / n.sum(), found]
        return pa.table([group.column(by).slice(0, 1), *(pa.array([v.tolist()], pa.list_(pa.float64())) for v in out)], [by, "means", "variances", "shares", "waves"])

    for _ in range(rounds if waves else 0):
        parts = rows.join(state, by).select(by, "x", "y", "z", "u", "means", "variances", "shares", "waves").mapInArrow(sums, f"`{by}` {kind}, part array<double>")
        state = settled(parts.join(state, by).groupBy(by).applyInArrow(updated, f"`{by}` {kind}, {PARAMETERS}"))
    return state


def corrected(voxels: DataFrame, by: str, shape: Shape, found: DataFrame, order: int = 3, value: str = "v") -> DataFrame:
    """``voxels`` with their field taken out of ``value``; volumes without a field stay as they are."""
    own = F.coalesce(F.exp(-field(shape, order, F.col("waves"))), F.lit(1.0))
    return voxels.join(found.select(by, "waves"), by, "left").withColumn(value, F.col(value) * own).drop("waves")
