"""Intensity classes: one-dimensional k-means, Gaussian mixtures by EM, and neighbourhood smoothing of class weights.

Each iteration is one aggregation over the voxels; only a row per class reaches the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nearest(x: Column, centres: list[float]) -> Column:
    """Index of the nearest centre, ties to the lowest."""
    best = F.array_min(F.array(*[F.struct(F.abs(x - c).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(centres)]))
    return best["k"]


def kmeans_start(rows: DataFrame, x: str, k: int) -> list[float]:
    """Evenly spaced centres from the least to the greatest value."""
    low, high = rows.agg(F.min(x), F.max(x)).first()
    return [low + (high - low) * j / max(1, k - 1) for j in range(k)]


def kmeans_step(rows: DataFrame, x: str, centres: list[float]) -> DataFrame:
    """(k, centre, n) after one assignment; classes without voxels have no row."""
    return rows.groupBy(nearest(F.col(x), centres).alias("k")).agg(F.avg(x).alias("centre"), F.count("*").alias("n"))


def kmeans(rows: DataFrame, x: str, k: int, iterations: int = 100) -> list[float]:
    centres = kmeans_start(rows, x, k)
    for _ in range(iterations):
        new = list(centres)
        for r in kmeans_step(rows, x, centres).collect():
            new[r["k"]] = r["centre"]
        if new == centres:
            break
        centres = new
    return sorted(centres)


def density(x: Column, mean: float, sd: float) -> Column:
    return F.greatest(F.exp(-0.5 * ((x - mean) / sd) ** 2) / (sd * math.sqrt(2 * math.pi)), F.lit(1e-300))


def responsibilities(x: Column, classes: list[tuple[float, float, float]]) -> list[Column]:
    """Posterior weight of each (share, mean, sd)."""
    joint = [share * density(x, mean, sd) for share, mean, sd in classes]
    total = sum(joint[1:], joint[0])
    return [j / total for j in joint]


def em_sums(rows: DataFrame, x: str, classes: list[tuple[float, float, float]]) -> DataFrame:
    """One row: log likelihood, voxels, and per class the weight, weighted sum and weighted squares about its mean."""
    v = F.col(x)
    joint = [share * density(v, mean, sd) for share, mean, sd in classes]
    g = responsibilities(v, classes)
    sums = [F.sum(F.log(sum(joint[1:], joint[0]))).alias("loglik"), F.count("*").alias("n")]
    for k, (w, (_, mean, _)) in enumerate(zip(g, classes, strict=True)):
        sums += [F.sum(w).alias(f"w{k}"), F.sum(w * v).alias(f"x{k}"), F.sum(w * (v - mean) ** 2).alias(f"s{k}")]
    return rows.agg(*sums)


def mixture(rows: DataFrame, x: str, k: int = 3, iterations: int = 100, tolerance: float = 1e-4) -> list[tuple[float, float, float]]:
    """Classes by rising mean, from k-means on; a class that gets no voxels has sd 1 and share 1/k."""
    centres = kmeans(rows, x, k)
    start = {r["k"]: r for r in rows.groupBy(nearest(F.col(x), centres).alias("k")).agg(F.stddev_samp(x).alias("sd"), F.count("*").alias("n")).collect()}
    total = sum(r["n"] for r in start.values())
    classes = [(start[j]["n"] / total if j in start else 1 / k, c, (start[j]["sd"] or 0.0) + 1e-3 if j in start else 1.0) for j, c in enumerate(centres)]
    last = -math.inf
    for _ in range(iterations):
        r = em_sums(rows, x, classes).first()
        new = []
        for j, old in enumerate(classes):
            w = r[f"w{j}"]
            new.append((w / r["n"], r[f"x{j}"] / w, math.sqrt(max(r[f"s{j}"] / w, 0.0)) + 1e-3) if w > 0 else old)
        if abs(r["loglik"] - last) <= tolerance * abs(r["loglik"]):
            break
        classes, last = new, r["loglik"]
    return sorted(classes, key=lambda c: c[1])


STEPS = ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))


def neighbour_votes(rows: DataFrame, by: list[str], label: str, beta: float, weights: list[str], iterations: int = 1) -> DataFrame:
    """Weights after ``iterations`` of log w + beta * (neighbours with that label), softmax; a missing neighbour votes for
    the voxel's own label. ``rows``: by, z, y, x, label and the weight columns."""
    at = [*by, "z", "y", "x"]
    for _ in range(iterations):
        steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(dz).alias("dz")) for dx, dy, dz in STEPS])
        asked = rows.select(*at, F.col(label).alias("_own"), F.explode(steps).alias("_s"))
        asked = asked.select(*[F.col(c).alias(f"_{c}") for c in at], "_own", *by, *[(F.col(c) + F.col(f"_s.d{c}")).alias(c) for c in ("z", "y", "x")])
        told = asked.join(rows.select(*at, F.col(label).alias("_told")), at, "left").select(*[F.col(f"_{c}").alias(c) for c in at], F.coalesce("_told", "_own").alias("_vote"))
        votes = told.groupBy(*at).agg(*[F.sum((F.col("_vote") == k).cast("int")).alias(f"_v{k}") for k in range(len(weights))])
        logs = [F.log(F.greatest(F.col(w), F.lit(1e-12))) + beta * F.col(f"_v{k}") for k, w in enumerate(weights)]
        top = F.greatest(*logs)
        e = [F.exp(x - top) for x in logs]
        total = sum(e[1:], e[0])
        new = rows.join(votes, at).select(*by, "z", "y", "x", *[(x / total).alias(w) for x, w in zip(e, weights, strict=True)])
        best = F.array_max(F.array(*[F.struct(F.col(w).alias("w"), F.lit(-k).alias("k")) for k, w in enumerate(weights)]))
        rows = new.withColumn(label, -best["k"])
    return rows
