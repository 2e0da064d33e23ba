"""Design matrices, linear models, contrasts and multiple comparisons."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxloom.functions.scalar import hrf, t_p
from voxloom.operators.layout import lists, map_arrays, matrix
from voxloom.operators.temporal import dct_basis
from voxloom.session import settled

MICRO, MICRO_ONSET = 16, 8


def boxcar(scans: DataFrame, events: DataFrame, onset: str = "onset", duration: str = "duration") -> DataFrame:
    """(scan, hits): events whose half-open interval covers each scan. Every event is spread over the scans that it
    covers, so this is an equi-join and not a range join."""
    last = F.ceil(F.col(onset) + F.col(duration)).cast("long") - 1
    first = F.ceil(F.col(onset)).cast("long")
    covered = events.filter(last >= first).select(F.explode(F.sequence(first, last)).alias("scan")).groupBy("scan").agg(F.count("*").alias("hits"))
    return scans.join(covered, "scan", "left").select("scan", F.coalesce("hits", F.lit(0)).alias("hits"))


def task_regressor(onsets: Sequence[float], durations: Sequence[float], scans: int, tr: float) -> np.ndarray:
    """Boxcars (in scans) convolved with the canonical response in micro time, sampled within every scan."""
    dt = tr / MICRO
    t = np.arange(scans * MICRO) * dt
    box = np.zeros(len(t))
    for o, d in zip(onsets, durations, strict=True):
        box += (t >= o * tr) & (t < (o + d) * tr)
    return convolved(box, scans, tr)


def convolved(box: np.ndarray, scans: int, tr: float) -> np.ndarray:
    """A course in micro time convolved with the canonical response, sampled within every scan."""
    dt = tr / MICRO
    h = hrf(np.arange(int(round(32 / dt)) + 1) * dt)
    full = np.convolve(box, h)[: len(box)] * dt
    return full[np.minimum(np.arange(scans) * MICRO + MICRO_ONSET - 1, len(box) - 1)]


def design(conditions: dict[str, tuple[Sequence[float], Sequence[float]]], scans: int, tr: float, motion: np.ndarray | None = None, cutoff: float | None = None) -> tuple[np.ndarray, list[str]]:
    """Columns: conditions, motion, constant, drift; and their names. A motion table of another length is an error."""
    columns, names = [task_regressor(*v, scans, tr) for v in conditions.values()], list(conditions)
    if motion is not None:
        if len(motion) != scans:
            raise ValueError(f"{len(motion)} rows of motion for {scans} scans")
        columns += list(motion.T)
        names += [f"motion{k + 1}" for k in range(motion.shape[1])]
    columns.append(np.ones(scans))
    names.append("constant")
    if cutoff:
        b = dct_basis(scans, tr, cutoff)
        columns += list(b.T)
        names += [f"drift{k + 1}" for k in range(b.shape[1])]
    return np.stack(columns, 1), names


def full_rank(x: np.ndarray, protected: Sequence[int] = ()) -> list[int]:
    """Columns to keep: the protected ones first, then each that adds to the rank, in order."""
    keep: list[int] = []
    for j in [*protected, *(j for j in range(x.shape[1]) if j not in protected)]:
        if np.linalg.matrix_rank(x[:, [*keep, j]]) == len(keep) + 1:
            keep.append(j)
        elif j in protected:
            raise ValueError(f"protected column {j} depends on others")
    return sorted(keep)


def orthogonalised(x: np.ndarray) -> np.ndarray:
    """Each column less its projection on those before it."""
    out = x.astype(float).copy()
    for j in range(1, x.shape[1]):
        out[:, j] -= out[:, :j] @ np.linalg.pinv(out[:, :j]) @ out[:, j]
    return out


def ols(rows: DataFrame, x: np.ndarray, contrasts: dict[str, Sequence[float]], removed: int = 0, series: str = "series", tails: int = 2) -> DataFrame:
    """Adds beta, sigma2 and, for each contrast, con_, t_ and p_ columns to series rows.

    ``removed``: dimensions that filtering has taken from the series; they count against the degrees of freedom.
    Shorter contrasts are padded with zeros."""
    pinv = np.linalg.pinv(x)
    df = len(x) - int(np.linalg.matrix_rank(x)) - removed
    if df <= 0:
        raise ValueError("no degrees of freedom are left")
    cov = pinv @ pinv.T
    cs = {n: np.pad(np.asarray(c, float), (0, x.shape[1] - len(c))) for n, c in contrasts.items()}
    names = [c for c in rows.columns if c != series]
    extra = ["beta array<double>", "sigma2 double", *(f"{k}_{n} double" for n in cs for k in ("con", "t", "p"))]
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names), *extra])

    def run(batches):
        for b in batches:
            y = matrix(b.column(series)).reshape(b.num_rows, len(x))
            beta = y @ pinv.T
            sigma2 = np.maximum(((y - beta @ x.T) ** 2).sum(1) / df, 1e-12)
            out = [lists(beta), pa.array(sigma2)]
            for c in cs.values():
                con = beta @ c
                t = con / np.sqrt(np.maximum(sigma2 * (c @ cov @ c), 1e-12))
                out += [pa.array(con), pa.array(t), pa.array(t_p(t, df, tails))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *out], names=[*names, *(e.split()[0] for e in extra)])

    return rows.mapInArrow(run, schema)


def f_statistic(rows: DataFrame, x: np.ndarray, hypothesis: np.ndarray, series: str = "series") -> DataFrame:
    """Adds ``f``: extra sum of squares of the ``hypothesis`` rows (k x p) over the residual mean square."""
    pinv = np.linalg.pinv(x)
    df = len(x) - int(np.linalg.matrix_rank(x))
    middle = np.linalg.pinv(hypothesis @ pinv @ pinv.T @ hypothesis.T)
    k = int(np.linalg.matrix_rank(hypothesis))

    names = rows.columns

    def run(batches):
        for b in batches:
            y = matrix(b.column(series)).reshape(b.num_rows, len(x))
            beta = y @ pinv.T
            h = beta @ hypothesis.T
            f = np.einsum("ij,jk,ik->i", h, middle, h) / k / np.maximum(((y - beta @ x.T) ** 2).sum(1) / df, 1e-12)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(f)], names=[*names, "f"])

    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names), "f double"]))


def whitener(v: np.ndarray) -> np.ndarray:
    """V^(-1/2) of a covariance over scans."""
    w, u = np.linalg.eigh(v)
    return (u / np.sqrt(np.maximum(w, 1e-12 * w.max()))) @ u.T


def effective_df(x: np.ndarray, v: np.ndarray, removed: int = 0) -> float:
    """tr(RV)^2 / tr(RVRV): the degrees of freedom of residuals whose scans covary as V."""
    rv = (np.eye(len(x)) - x @ np.linalg.pinv(x)) @ v
    return float(np.trace(rv) ** 2 / np.sum(rv * rv.T)) - removed


def wls(rows: DataFrame, x: np.ndarray, v: np.ndarray, contrasts: dict[str, Sequence[float]], series: str = "series", tails: int = 2) -> DataFrame:
    """``ols`` after both sides are whitened by the covariance V over scans, which all voxels share."""
    w = whitener(v)
    return ols(map_arrays(rows, series, lambda y: y @ w.T), w @ x, contrasts, series=series, tails=tails)


def scatter(rows: DataFrame, series: str = "series") -> tuple[np.ndarray, int]:
    """The sum of y y^T over all series, and their number. Every task adds up its own rows; the driver gets one matrix of
    scans x scans, however many voxels there are. Series that are null, hold a null or aren't finite are left out; series of
    different lengths fail."""
    held = rows.filter(F.col(series).isNotNull() & F.forall(series, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))

    def sums(batches):
        total, n = None, 0
        for b in batches:
            if b.num_rows:
                if len({*b.column("y").value_lengths().to_pylist(), *([] if total is None else [len(total)])}) > 1:
                    raise ValueError("series of different lengths")
                y = matrix(b.column("y"))
                total, n = y.T @ y + (0 if total is None else total), n + len(y)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), lists(total), pa.array([n] + [0] * (len(total) - 1), pa.int64())], ["row", "cells", "n"])

    parts = held.select(F.col(series).cast("array<double>").alias("y")).mapInArrow(sums, "row int, cells array<double>, n long")
    counts = parts.select("row", "n", F.posexplode("cells").alias("col", "v")).groupBy("row", "col").agg(F.sum("v").alias("v"), F.sum(F.when(F.col("col") == 0, F.col("n"))).alias("n"))
    got = counts.groupBy("row").agg(F.transform(F.sort_array(F.collect_list(F.struct("col", "v"))), lambda c: c["v"]).alias("cells"), F.sum("n").alias("n")).collect()
    out = np.zeros((len(got), len(got)))
    for r in got:
        if r["row"] >= len(got) or len(r["cells"]) != len(got):
            raise ValueError("series of different lengths")
        out[r["row"]] = r["cells"]
    return out, sum(r["n"] for r in got)


def autoregressive(scans: int, rho: float = 0.2, sessions: Sequence[int] = ()) -> list[np.ndarray]:
    """Covariance components of first-order autocorrelation about ``rho``: for each session independent noise and the slope
    of the covariance along rho, so a sum of both follows noise whose rho isn't far off."""
    out, at = [], 0
    for n in sessions or (scans,):
        lag = np.abs(np.subtract.outer(np.arange(n), np.arange(n))).astype(float)
        for block in (np.eye(n), np.where(lag > 0, lag * rho ** np.maximum(lag - 1, 0), 0.0)):
            q = np.zeros((scans, scans))
            q[at : at + n, at : at + n] = block
            out.append(q)
        at += n
    return out


def covariance(yy: np.ndarray, n: int, x: np.ndarray, components: Sequence[np.ndarray], iterations: int = 64, tolerance: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """Restricted maximum likelihood of V = sum of h_i Q_i from the scatter of ``n`` series that share it: (h, V).

    Fisher scoring. A step that makes V indefinite or the likelihood smaller is halved. V has the scale of one series."""
    components = [np.asarray(q, float) for q in components]
    size = len(yy)
    mean = yy / max(1, n)

    def likelihood(h):
        """Log likelihood a series, and what its slopes need; nothing where V isn't positive."""
        v = sum(a * q for a, q in zip(h, components, strict=True))
        w = np.linalg.eigvalsh(v)
        if w[0] <= 1e-12 * max(w[-1], 0) or w[-1] <= 0:
            return -np.inf, None
        inverse = np.linalg.inv(v)
        inner = x.T @ inverse @ x
        p = inverse - inverse @ x @ np.linalg.pinv(inner) @ x.T @ inverse
        logs = np.linalg.eigvalsh((inner + inner.T) / 2)
        return -0.5 * (np.log(w).sum() + np.log(logs[logs > 1e-12 * logs[-1]]).sum() + np.sum(p * mean)), p

    rank = np.linalg.matrix_rank(x)
    resid = np.eye(size) - x @ np.linalg.pinv(x)
    h = np.zeros(len(components))
    definite = [k for k, q in enumerate(components) if np.linalg.eigvalsh(q)[0] >= -1e-12 and np.trace(q) > 0]
    for k in definite or range(len(components)):
        h[k] = np.trace(resid @ mean @ resid) / max(1, size - rank) * size / np.trace(components[k]) / len(definite)
    best, p = likelihood(h)
    if p is None:
        raise ValueError("the components' sum isn't positive")
    for _ in range(iterations):
        pq = [p @ q for q in components]
        slope = np.array([0.5 * (np.sum(a * (mean @ p)) - np.trace(a)) for a in pq])
        information = 0.5 * np.array([[np.sum(a * b.T) for b in pq] for a in pq])
        step, share = np.linalg.pinv(information) @ slope, 1.0
        while share > 1e-6:
            found, q = likelihood(h + share * step)
            if found >= best - 1e-12 * abs(best):
                break
            share /= 2
        else:
            break
        h, gained, best, p = h + share * step, found - best, found, q
        if gained < tolerance * (1 + abs(best)) and np.abs(share * step).max() <= 1e-8 * np.abs(h).max():
            break
    return h, sum(a * q for a, q in zip(h, components, strict=True))


def reml(rows: DataFrame, x: np.ndarray, components: Sequence[np.ndarray], contrasts: dict[str, Sequence[float]], series: str = "series", tails: int = 2, responding: float | None = None) -> DataFrame:
    """``ols`` under the noise covariance that all series share, estimated from themselves: one pass for the scatter, one
    for the fit. The scale of V stays with each series.

    ``responding``: only series whose F of all columns of ``x`` reaches this are used for V."""
    used = rows if responding is None else f_statistic(rows, x, np.eye(x.shape[1]), series).filter(F.col("f") >= responding)
    yy, n = scatter(used, series)
    if not n:
        raise ValueError("no series to estimate the covariance from")
    h, v = covariance(yy, n, x, components)
    return wls(rows, x, v * len(v) / np.trace(v), contrasts, series, tails)


def smoothness(residuals: DataFrame, by: Sequence[str], scans: int, df: float, value: str = "series") -> DataFrame:
    """(by, axis, pairs, slope2, fwhm): the smoothness of residuals along x, y and z, from the squared steps between
    neighbouring voxels' standardised series.

    ``residuals``: (by, z, y, x, series). Series without variance are left out. Steps of standardised residuals have a variance
    of 4 log 2 / FWHM^2 a voxel. Neighbours meet by an equi-join on shifted places."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    scale = F.sqrt(dot(F.col(value), F.col(value)) / df)
    u = residuals.withColumn("_scale", scale).filter(F.col("_scale") > 1e-12).select(*by, "z", "y", "x", F.transform(value, lambda v: v / F.col("_scale")).alias("u"))
    shifts = F.array(*[F.struct(F.lit(a).alias("axis"), *[(F.col(c) - (1 if c == a else 0)).alias(c) for c in ("z", "y", "x")]) for a in ("x", "y", "z")])
    moved = u.select(*by, F.col("u").alias("other"), F.explode(shifts).alias("s")).select(*by, "s.*", "other")
    step = F.zip_with("other", "u", lambda p, q: p - q)
    steps = u.join(moved, [*by, "z", "y", "x"]).select(*by, "axis", (dot(step, step) / df).alias("d2"))
    got = steps.groupBy(*by, "axis").agg(F.count("*").alias("pairs"), F.avg("d2").alias("slope2"))
    return got.withColumn("fwhm", F.when(F.col("slope2") > 0, F.sqrt(4 * math.log(2) / F.col("slope2"))))


def resels(smooth: DataFrame, by: Sequence[str], sizes: DataFrame) -> DataFrame:
    """(by, voxels, resels): the number of voxels over the product of the widths in voxels; an axis without pairs of
    voxels or without steps counts as one voxel wide. ``sizes``: (by, voxels)."""
    wide = smooth.groupBy(*by).agg(F.product(F.coalesce("fwhm", F.lit(1.0))).alias("_wide"))
    return sizes.join(wide, list(by), "left").select(*by, "voxels", (F.col("voxels") / F.coalesce("_wide", F.lit(1.0))).alias("resels"))


def euler_p(t: float, resels: Sequence[float], df: float) -> float:
    """Chance of a maximum over ``t`` somewhere in a smooth t field: expected Euler characteristic, with ``resels`` counts of
    dimensions 0 to 3, at most 1."""
    base = (1 + t * t / df) ** (-(df - 1) / 2)
    four = 4 * math.log(2)
    gammas = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df / 2)
    density = (
        float(t_p(np.array([t]), df, 1)[0]), math.sqrt(four) / (2 * math.pi) * base, four / (2 * math.pi) ** 1.5 * base * t * gammas,
        four**1.5 / (2 * math.pi) ** 2 * base * ((df - 1) / df * t * t - 1),
    )
    return min(1.0, max(0.0, sum(r * d for r, d in zip(resels, density, strict=False))))


def leverage(x: np.ndarray) -> np.ndarray:
    """How much each row of a design informs its fit: the diagonal of the hat matrix."""
    return np.einsum("ij,jk,ik->i", x, np.linalg.pinv(x.T @ x), x)


def informative(jacobian: np.ndarray, quality: float = 0.9, share: float = 0.1) -> np.ndarray:
    """Indices of the samples that carry a fit: the least informative tenth goes again and again, while the determinant of
    the normal equations keeps ``quality`` of its first value."""
    keep = np.arange(len(jacobian))
    whole = np.linalg.det(jacobian.T @ jacobian)
    while len(keep) > 2 * jacobian.shape[1]:
        weight = leverage(jacobian[keep])
        fewer = np.sort(keep[np.argsort(weight, kind="stable")[max(1, int(len(keep) * share)) :]])
        if np.linalg.det(jacobian[fewer].T @ jacobian[fewer]) < quality * whole:
            break
        keep = fewer
    return keep


def sessions(designs: Sequence[tuple[np.ndarray, list[str]]]) -> tuple[np.ndarray, list[str]]:
    """The designs of several sessions as one: blocks along the diagonal, names numbered by session."""
    x = np.zeros((sum(len(d) for d, _ in designs), sum(d.shape[1] for d, _ in designs)))
    names, row, col = [], 0, 0
    for k, (d, own) in enumerate(designs):
        x[row : row + len(d), col : col + d.shape[1]] = d
        names += [f"s{k + 1}:{n}" for n in own]
        row, col = row + len(d), col + d.shape[1]
    return x, names


def mean_corrected(x: np.ndarray) -> np.ndarray:
    return x - x.mean(0)


def orthogonal_contrasts(c: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Contrasts (rows) made independent of those before them, as their estimates covary; collinear ones are dropped."""
    pinv = np.linalg.pinv(x)
    cov, out = pinv @ pinv.T, []
    for row in np.asarray(c, float):
        for o in out:
            row = row - (row @ cov @ o) / (o @ cov @ o) * o
        if row @ cov @ row > 1e-12:
            out.append(row)
    return np.array(out)


def two_regressors(rows: DataFrame, by: Sequence[str], y: Column, x1: Column, x2: Column) -> DataFrame:
    """Least squares of y on 1, x1, x2 for every group, from one pass of centred moments; null where x1 and x2 are
    collinear in a group."""
    m = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        *[F.avg(c).alias(f"m{k}") for k, c in (("y", y), ("1", x1), ("2", x2))],
        F.var_pop(x1).alias("s11"), F.var_pop(x2).alias("s22"), F.covar_pop(x1, x2).alias("s12"), F.covar_pop(x1, y).alias("s1y"), F.covar_pop(x2, y).alias("s2y"),
    )
    c = F.col
    det = c("s11") * c("s22") - c("s12") * c("s12")
    b1 = F.when(det > 1e-12, (c("s22") * c("s1y") - c("s12") * c("s2y")) / det)
    b2 = F.when(det > 1e-12, (c("s11") * c("s2y") - c("s12") * c("s1y")) / det)
    return m.select(*by, "n", b1.alias("b1"), b2.alias("b2"), (c("my") - b1 * c("m1") - b2 * c("m2")).alias("b0"))


def slope(rows: DataFrame, by: Sequence[str], y: Column, x: Column) -> DataFrame:
    """(by, n, slope, intercept, t): one-regressor least squares with the slope's t value."""
    m = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(y).alias("my"), F.avg(x).alias("mx"), F.var_pop(x).alias("sxx"), F.var_pop(y).alias("syy"), F.covar_pop(x, y).alias("sxy"))
    c = F.col
    b = c("sxy") / c("sxx")
    rss = F.greatest(c("n") * (c("syy") - b * c("sxy")), F.lit(1e-12))
    t = b / F.sqrt(rss / (c("n") - 2) / (c("n") * c("sxx")))
    ok = (c("n") > 2) & (c("sxx") > 0)
    return m.select(*by, "n", F.when(ok, b).alias("slope"), F.when(ok, c("my") - b * c("mx")).alias("intercept"), F.when(ok, t).alias("t"))


def ranked(df: DataFrame, *order: str, to: str = "rank") -> DataFrame:
    """Global ranks from 1 without a global window: rows are range-partitioned, ranked within partitions, and each
    partition adds the number of rows before it."""
    parts = settled(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row per partition
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_local", local).join(F.broadcast(before.select("_part", "_before")), "_part").withColumn(to, F.col("_before") + F.col("_local")).drop("_part", "_local", "_before")


def fdr(df: DataFrame, p: str, *ties: str, q: float = 0.05) -> DataFrame:
    """Adds ``rank`` and ``significant`` by the step-up rule: p at most the largest p(i) with p(i) <= q i / m."""
    got = ranked(df.filter(F.col(p).isNotNull()), p, *ties)
    m = got.count()
    cut = got.filter(F.col(p) <= q * F.col("rank") / F.lit(max(1, m))).agg(F.max(p)).first()[0]
    return got.withColumn("significant", F.col(p) <= F.lit(-1.0 if cut is None else cut))


def bonferroni(df: DataFrame, p: str) -> DataFrame:
    """Adds ``p_fwe``: p times the number of tests, at most 1."""
    return df.withColumn("p_fwe", F.least(F.lit(1.0), F.col(p) * df.count()))


def thresholded(df: DataFrame, t: str, least: float) -> DataFrame:
    return df.filter(F.col(t) >= least)


def conjunction(df: DataFrame, *ts: str) -> Column:
    """The least of several statistics: all effects reach it."""
    return F.least(*ts)
