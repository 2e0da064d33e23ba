"""The first-level analysis as a whole: design, mask, filter, whitening, fit and contrasts, in this order."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.operators import glm, layout, masks, relational, temporal
from voxloom.session import settled


@dataclass
class Fit:
    """What a run found: the rows of the voxels, the design as fitted, its names, the autocorrelation, filtered dimensions."""

    rows: DataFrame
    design: np.ndarray
    names: list[str]
    rho: float
    removed: int
    dropped: list[str] = field(default_factory=list)


def analysed_voxels(rows: DataFrame, at: Sequence[str], fraction: float, brain: DataFrame | None = None, standard: DataFrame | None = None) -> DataFrame:
    """The voxel keys of the analysis: means over a fraction of the global level, in the standard-space mask if that leaves
    any; within the brain mask if there is one, else these, else all positive means."""
    n = F.size("series")
    means = settled(rows.select(*at, (F.aggregate("series", F.lit(0.0), lambda a, v: a + v) / n).alias("mean")))
    base = relational.global_mask(means, fraction).select(*at)
    if standard is not None:
        base = masks.first_usable(base.join(standard, list(at), "left_semi"), base)
    chain = [base, means.filter("mean > 0").select(*at)]
    if brain is not None:
        chain.insert(0, base.join(brain, list(at), "left_semi"))
    return masks.first_usable(*chain)


def repaired(x: np.ndarray, names: Sequence[str], conditions: Sequence[str]) -> tuple[np.ndarray, list[str], list[str]]:
    """The design without nuisance columns that others already span; conditions always stay."""
    keep = glm.full_rank(x, [k for k, n in enumerate(names) if n in conditions])
    return x[:, keep], [names[k] for k in keep], [n for k, n in enumerate(names) if k not in keep]


def fit(rows: DataFrame, at: Sequence[str], x: np.ndarray, names: Sequence[str], conditions: Sequence[str], contrasts: dict[str, dict[str, float]], tr: float, cutoff: float | None = 128.0, ar1: bool = True, fraction: float = 0.5, brain: DataFrame | None = None, standard: DataFrame | None = None) -> Fit:
    """Analyse series rows (``at``, series) with a design (scans x columns). ``contrasts`` gives weights by column name.

    Series and design are filtered and whitened alike; the filter's dimensions count against the degrees of freedom."""
    x, names, dropped = repaired(np.asarray(x, float), list(names), conditions)
    inside = rows.join(analysed_voxels(rows, at, fraction, brain, standard), list(at), "left_semi")
    removed = 0
    if cutoff:
        n = len(x)
        basis = temporal.dct_basis(n, tr, cutoff)
        inside = layout.map_arrays(inside, "series", temporal.high_pass(n, tr, cutoff))
        x, removed = x - basis @ (basis.T @ x), basis.shape[1]
    rho = 0.0
    if ar1 and len(x) >= 3:
        inside = settled(inside)  # read twice: for the autocorrelation, and to be whitened
        rho = temporal.global_rho(inside)
        inside = inside.withColumn("series", temporal.whiten(F.col("series"), rho))
        if abs(rho) >= 1e-4:
            x = np.concatenate([x[:1] * np.sqrt(1 - rho * rho), x[1:] - rho * x[:-1]])
    weights = {n: [w.get(c, 0.0) for c in names] for n, w in contrasts.items()}
    if any(not np.any(w) for w in weights.values()):
        raise ValueError("a contrast names no column of the design")
    return Fit(glm.ols(inside, x, weights, removed), x, names, rho, removed, dropped)
