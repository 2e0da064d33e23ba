"""Registration: rigid realignment, mutual-information coregistration, deformable warps, normalisation.

One volume is one unit of work, handled as numpy arrays inside a Spark task; what a run has in common, its target and its
mean, moves between passes by joins and aggregations. All coordinates count from 0; rigid parameters are in mm and radians.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.operators import splines
from voxloom.operators.glm import informative
from voxloom.operators.layout import Shape, lists, matrix
from voxloom.operators.spatial import grid, rigid, trilinear, trilinear_each
from voxloom.session import settled

#: No motion goes beyond these, in voxels and radians.
LIMITS = np.array([20, 20, 20, 0.35, 0.35, 0.35])
#: Ways along which an image changes by less than this share of the most aren't told from noise.
CURVE = 2e-3


def moved_points(p: np.ndarray, points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    m = rigid(p)
    return (points - centre) @ m[:3, :3].T + centre + m[:3, 3]


def turned(p: np.ndarray, arms: np.ndarray) -> np.ndarray:
    """Derivatives of the moved points (m x 3 x 6) in the six parameters; ``arms``: the points from the centre of rotation."""
    one = [rigid([0, 0, 0, *(a if k == n else 0 for k in range(3))])[:3, :3] for n, a in enumerate(p[3:])]
    out = np.zeros((len(arms), 3, 6))
    out[:, :, :3] = np.eye(3)
    for n, (i, j) in enumerate(((1, 2), (2, 0), (0, 1))):  # the plane that turns
        spin = np.zeros((3, 3))
        spin[j, i], spin[i, j] = 1, -1
        parts = [spin @ r if k == n else r for k, r in enumerate(one)]
        out[:, :, 3 + n] = arms @ (parts[2] @ parts[1] @ parts[0]).T
    return out


def sample_points(size: tuple[int, int, int], sep: int) -> np.ndarray:
    """Every ``sep``-th voxel (xyz) of a volume of ``size`` (nz, ny, nx)."""
    return np.stack(np.meshgrid(*[np.arange(0, n, sep, dtype=float) for n in size[::-1]], indexing="ij"), -1).reshape(-1, 3)


def estimate(reference: np.ndarray, volume: np.ndarray, start: np.ndarray, sep: int = 1, iterations: int = 48, tolerance: float = 1e-8, overlap: float = 0.25) -> np.ndarray:
    """Parameters p (voxels, radians) at which volume(p(x)) matches reference(x): least mean square of the difference.

    Levenberg-Marquardt: a step is taken only if it lowers the cost, and the damping follows the ratio of the gain to what
    the linear model promised. A place where less than ``overlap`` of the samples lie inside counts as infinitely bad, so
    the result is never worse than the start; without overlap there, it is the start. Samples are jittered: on the grid itself
    the reference is sharp, and motion would pay merely because it blurs the volume less or more. Along axes of over eight
    voxels they stay off the edge, where a mean of moved scans has holes."""
    points = sample_points(reference.shape, sep)
    end = np.array(reference.shape[::-1]) - 1
    points = np.clip(points + np.random.default_rng(0).uniform(-0.5, 0.5, points.shape), 0, end)
    edge = np.where(end >= 8, rim(end), 0)
    points = points[((points >= edge) & (points <= end - edge)).all(1)]
    centre, last = (np.array(reference.shape[::-1]) - 1) / 2, np.array(volume.shape[::-1]) - 1
    fixed = trilinear(reference[None], points)[0]
    images = np.stack([volume, *(np.gradient(volume, axis=a) if n > 1 else np.zeros(volume.shape) for a, n in zip((2, 1, 0), volume.shape[::-1], strict=True))])

    def look(p):
        """Cost, and what the next step needs."""
        q = moved_points(p, points, centre)
        inside = ((q >= 0) & (q <= last)).all(1)
        if inside.sum() < max(6, overlap * len(points)):
            return np.inf, None
        value, *slopes = trilinear(images, q[inside])
        r = value - fixed[inside]
        return float(r @ r) / len(r), (r, np.stack(slopes, 1), points[inside] - centre)

    p = np.clip(np.asarray(start, float), -LIMITS, LIMITS)
    cost, seen = look(p)
    damping, raise_by = 1e-3, 2.0
    for _ in range(iterations):
        if seen is None or not np.isfinite(cost):
            break
        r, slopes, arms = seen
        j = np.einsum("mi,mik->mk", slopes, turned(p, arms))
        normal, down = j.T @ j / len(r), -(j.T @ r) / len(r)
        if cost <= 1e-24 * max(1.0, float(fixed @ fixed) / len(fixed)):
            break
        # turns count by how far they carry a sample; ways that hardly change the image, as turns of a ball, aren't gone
        unit = np.append(np.ones(3), np.ones(3) / max(1.0, np.sqrt((arms**2).sum(1).mean())))
        curve, ways = np.linalg.eigh(normal * np.outer(unit, unit))
        seen_ways = ways[:, curve > CURVE * max(curve[-1], 1e-300)]
        curve = curve[curve > CURVE * max(curve[-1], 1e-300)]
        step = unit * (seen_ways @ ((seen_ways.T @ (unit * down)) / (curve * (1 + damping))))
        step = np.clip(p + step, -LIMITS, LIMITS) - p
        promised = float(2 * step @ down - step @ normal @ step)
        if np.abs(step).max() < tolerance or promised <= 0:
            break
        new, then = look(p + step)
        gain = (cost - new) / promised
        if gain > 0:
            p, cost, seen = p + step, new, then
            damping, raise_by = max(1e-9, damping * max(1 / 3, 1 - (2 * gain - 1) ** 3)), 2.0
        else:
            damping, raise_by = damping * raise_by, raise_by * 2
            if damping > 1e9:
                break
    return p


def reslice(volume: np.ndarray, p: np.ndarray) -> np.ndarray:
    nz, ny, nx = volume.shape
    points = grid((nx, ny, nz))
    return trilinear(volume[None], moved_points(p, points, (np.array([nx, ny, nz]) - 1) / 2))[0].reshape(volume.shape)


def realign(blocks: DataFrame, shape: Shape, by: str, scan: str = "t", voxel: tuple[float, float, float] = (1, 1, 1), passes: int = 2, sep: int = 1) -> DataFrame:
    """(by, scan, tx..rz, data): motion of every scan against its run's first scan, then against the mean of the
    realigned scans, and the resliced volume.

    Scans are rows of their own in every pass, so a run spreads over as many tasks as it has scans; only the run's target,
    one volume, is joined to them (``beside``). A later pass starts from the estimates of the one before it."""
    nx, ny, nz = shape
    kinds = {c: blocks.schema[c].dataType.simpleString() for c in (by, scan)}
    rows = blocks.select(by, scan, "data").filter(F.col("data").isNotNull()).withColumn("p", F.array(*[F.lit(0.0)] * 6))
    first = rows.groupBy(by).agg(F.min(scan).alias(scan))
    target = rows.join(first, [by, scan]).dropDuplicates([by]).select(by, F.col("data").alias("target"))

    def fitted(batches):
        for b in batches:
            v, fixed, start = (matrix(b.column(c)) for c in ("data", "target", "p"))
            v, fixed = v.reshape(-1, nz, ny, nx), fixed.reshape(-1, nz, ny, nx)
            p = np.array([estimate(f, a, s, sep) for f, a, s in zip(fixed, v, start, strict=True)]).reshape(-1, 6)
            out = np.array([reslice(a, q) for a, q in zip(v, p, strict=True)]).reshape(len(v), nx * ny * nz)
            yield pa.RecordBatch.from_arrays([b.column(by), b.column(scan), b.column("data"), lists(p), lists(out)], [by, scan, "data", "p", "moved"])

    for turn in range(passes):
        rows = settled(dealt(beside(rows, target, by, scan).select(by, scan, "data", "p", "target")).mapInArrow(fitted, f"`{by}` {kinds[by]}, `{scan}` {kinds[scan]}, data array<double>, p array<double>, moved array<double>"))
        if turn + 1 < passes:
            target = mean_volume(rows, by, "moved", kinds[by]).withColumnRenamed("mean", "target")
            rows = rows.drop("moved")
    size = [*voxel, 1.0, 1.0, 1.0]
    return rows.select(by, scan, *[(F.col("p")[k] * float(size[k])).alias(n) for k, n in enumerate(("tx", "ty", "tz", "rx", "ry", "rz"))], F.col("moved").alias("data"))


def beside(rows: DataFrame, one: DataFrame, by: str, scan: str, together: int = 64) -> DataFrame:
    """``rows`` with the columns of ``one``, a row for each ``by``. A group of many scans gets a copy of its row for every
    ``together`` of them, so no group is one task."""
    many = rows.groupBy(by).agg(F.ceil(F.count("*") / together).cast("int").alias("_copies"))
    copies = one.join(many, by).withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    cut = rows.join(many, by).withColumn("_copy", F.pmod(F.xxhash64(scan), F.col("_copies")).cast("int")).drop("_copies")
    return cut.join(copies.drop("_copies"), [by, "_copy"]).drop("_copy")


def mean_volume(rows: DataFrame, by: str, data: str, kind: str) -> DataFrame:
    """(by, mean): the mean volume of every group. Tasks add up what they have of a group first, so one volume for each
    task and group moves, and not its scans."""

    def sums(batches):
        held: dict = {}

        def told(keys):
            n, totals = zip(*held.values(), strict=True)
            out = pa.RecordBatch.from_arrays([pa.array(list(held), keys), pa.array(n, pa.int64()), lists(np.array(totals))], [by, "n", "total"])
            held.clear()
            return out

        for b in batches:
            keys = b.column(by).type
            for k, row in zip(b.column(by).to_pylist(), matrix(b.column(data)), strict=True):
                n, total = held.get(k, (0, 0.0))
                held[k] = n + 1, total + row
            if len(held) > 64:
                yield told(keys)
        if held:
            yield told(keys)

    def mean(group: pa.Table) -> pa.Table:
        total = matrix(group.column("total")).sum(0) / sum(group.column("n").to_pylist())
        return pa.table({by: group.column(by).slice(0, 1), "mean": lists(total[None, :])})

    parts = rows.select(by, data).mapInArrow(sums, f"`{by}` {kind}, n long, total array<double>")
    return parts.groupBy(by).applyInArrow(mean, f"`{by}` {kind}, mean array<double>")


def checked_motion(blocks: DataFrame, shape: Shape, data: str = "data", least: float = 1e-6) -> DataFrame:
    """``blocks``; a resliced volume that isn't finite or hardly varies fails the job."""
    from voxloom.operators.layout import map_arrays

    def kernel(flat):
        if not np.isfinite(flat).all() or (flat.std(1, ddof=1) < least).any():
            raise ValueError("a resliced volume isn't finite or is nearly constant")
        return flat

    return map_arrays(blocks, data, kernel)


def mutual_information(a: np.ndarray, b: np.ndarray, bins: int = 32) -> float:
    """Natural-log mutual information of two intensity lists scaled to their ranges."""
    h, _, _ = np.histogram2d(a, b, bins)
    p = h / h.sum()
    pa_, pb = p.sum(1, keepdims=True), p.sum(0, keepdims=True)
    ok = p > 0
    return float((p[ok] * np.log(p[ok] / (pa_ @ pb)[ok])).sum())


def realign_splines(blocks: DataFrame, shape: Shape, by: str, scan: str = "t", voxel: tuple[float, float, float] = (1, 1, 1), passes: int = 2, sep: int = 1, quality: float = 0.9, seed: int = 0, iterations: int = 64) -> DataFrame:
    """``realign`` through cubic splines, with the Jacobian of the target alone.

    For each run the target's slopes at jittered samples give one Jacobian, and the samples that carry least are dropped
    while its determinant keeps ``quality`` of its size (``glm.informative``). Samples, values and Jacobian are one row, which
    goes to the run's scans (``beside``); a scan's steps then need its own spline only. Motion is composed, never added."""
    nx, ny, nz = shape
    kinds = {c: blocks.schema[c].dataType.simpleString() for c in (by, scan)}
    rows = blocks.select(by, scan, "data").filter(F.col("data").isNotNull())
    first = rows.groupBy(by).agg(F.min(scan).alias(scan))
    target = rows.join(first, [by, scan]).dropDuplicates([by]).select(by, F.col("data").alias("target"))
    start = F.array(*[F.lit(float(k % 5 == 0)) for k in range(16)])  # a matrix without motion

    def prepared(batches):
        for b in batches:
            for k, v in enumerate(matrix(b.column("target")).reshape(-1, nz, ny, nx)):
                points, fixed, jacobian = samples(v, sep, quality, seed)
                yield pa.RecordBatch.from_arrays([b.column(by).slice(k, 1), lists(points.reshape(1, -1)), lists(fixed[None, :]), lists(jacobian.reshape(1, -1))], [by, "points", "fixed", "jacobian"])

    def fitted(batches):
        for b in batches:
            ms, out = [], []
            for k, (v, m) in enumerate(zip(matrix(b.column("data")).reshape(-1, nz, ny, nx), matrix(b.column("m")).reshape(-1, 4, 4), strict=True)):
                points, fixed, jacobian = (b.column(c)[k].values.to_numpy() for c in ("points", "fixed", "jacobian"))
                c = splines.coefficients(v)
                m = composed(c, points.reshape(-1, 3), fixed, jacobian.reshape(-1, 6), m, iterations)
                ms.append(m.ravel())
                at = grid(shape) @ m[:3, :3].T + m[:3, 3]
                out.append(splines.sample(c, at) * ((at >= 0) & (at <= np.array(shape) - 1)).all(1))
            if ms:
                yield pa.RecordBatch.from_arrays([b.column(by), b.column(scan), b.column("data"), lists(np.array(ms)), lists(np.array(out))], [by, scan, "data", "m", "moved"])

    rows = rows.withColumn("m", start)
    for turn in range(passes):
        ready = settled(target.mapInArrow(prepared, f"`{by}` {kinds[by]}, points array<double>, fixed array<double>, jacobian array<double>"))
        rows = settled(dealt(beside(rows, ready, by, scan).select(by, scan, "data", "m", "points", "fixed", "jacobian")).mapInArrow(fitted, f"`{by}` {kinds[by]}, `{scan}` {kinds[scan]}, data array<double>, m array<double>, moved array<double>"))
        if turn + 1 < passes:
            target = mean_volume(rows, by, "moved", kinds[by]).withColumnRenamed("mean", "target")
            rows = rows.drop("moved")
    size = [*voxel, 1.0, 1.0, 1.0]
    centre = (np.array(shape) - 1) / 2
    m = lambda i, j: F.col("m")[4 * i + j]
    shift = [m(i, 3) - float(centre[i]) + sum((m(i, j) * float(centre[j]) for j in range(3)), F.lit(0.0)) for i in range(3)]
    angles = [F.atan2(m(2, 1), m(2, 2)), F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -m(2, 0)))), F.atan2(m(1, 0), m(0, 0))]
    return rows.select(by, scan, *[(c * float(size[k])).alias(n) for k, (n, c) in enumerate(zip(("tx", "ty", "tz", "rx", "ry", "rz"), [*shift, *angles], strict=True))], F.col("moved").alias("data"))


def samples(target: np.ndarray, sep: int, quality: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points of a target (jittered within half a step, kept inside), its values there, and the Jacobian of small motions about
    the middle; only the informative ones. One volume decides on them, however many scans a run has."""
    last = np.array(target.shape[::-1]) - 1
    points = sample_points(target.shape, sep)
    points = points + np.random.default_rng(seed).uniform(-0.5, 0.5, points.shape) * sep
    points = points[((points >= margin(last)) & (points <= last - margin(last))).all(1)]
    value, slope = splines.sample(splines.coefficients(target), points, slopes=True)
    jacobian = np.einsum("mi,mik->mk", slope, turned(np.zeros(6), points - last / 2))
    keep = informative(jacobian, quality) if np.linalg.matrix_rank(jacobian) == 6 else np.arange(len(points))
    return points[keep], value[keep], jacobian[keep]


def rim(last: np.ndarray) -> np.ndarray:
    """How far from the edge samples stay."""
    return np.minimum(2.0, last / 4)


def margin(last: np.ndarray) -> np.ndarray:
    """The same for splines, which the mirror beyond the edge bends: by a quarter of that a voxel on."""
    return np.minimum(3.0, 0.3 * last)


def composed(c: np.ndarray, points: np.ndarray, fixed: np.ndarray, jacobian: np.ndarray, m: np.ndarray, iterations: int, tolerance: float = 1e-7) -> np.ndarray:
    """The matrix that carries the target's points to where the spline ``c`` has the target's values. Each step asks which small
    motion of the target explains the difference, and takes it back; steps that don't help are halved."""
    last = np.array(c.shape[::-1]) - 1
    centre = np.eye(4)
    centre[:3, 3] = last / 2

    def look(m):
        q = points @ m[:3, :3].T + m[:3, 3]
        inside = ((q >= 0.9 * margin(last)) & (q <= last - 0.9 * margin(last))).all(1)
        if inside.sum() < max(6, len(points) // 4):
            return np.inf, None, inside
        r = splines.sample(c, q[inside]) - fixed[inside]
        return float(r @ r) / len(r), r, inside

    cost, r, inside = look(m)
    for _ in range(iterations):
        if r is None or cost == 0:
            break
        j = jacobian[inside]
        normal = j.T @ j
        step = np.linalg.lstsq(normal + 1e-9 * np.trace(normal) * np.eye(6) / 6, j.T @ r, rcond=None)[0]
        share = 1.0
        while share > 1e-3:
            back = centre @ np.linalg.inv(rigid(share * step)) @ np.linalg.inv(centre)
            found = look(m @ back)
            if found[0] < cost:
                break
            share /= 2
        else:
            break
        m, (cost, r, inside) = m @ back, found
        if np.abs(share * step).max() < tolerance:
            break
    return m


def in_bins(v: np.ndarray, bins: int) -> np.ndarray:
    """Every value's place among all values of its volume, from 0 to ``bins`` - 1; equal values share the middle of theirs. So bins
    hold as many values each, and rare high ones don't press all others into a few."""
    out = np.empty(v.shape)
    for k, volume in enumerate(v):
        _, which, many = np.unique(volume.ravel(), return_inverse=True, return_counts=True)
        places = np.cumsum(many) - (many + 1) / 2
        out[k] = (places / max(1, volume.size - 1) * (bins - 1))[which].reshape(volume.shape)
    return out


def normalised_information(h: np.ndarray) -> np.ndarray:
    """(H(a) + H(b)) / H(a, b) of every joint histogram (n x bins x bins): 1 without any relation, 2 at most."""
    total = np.maximum(h.sum((1, 2)), 1e-300)

    def entropy(q):
        logs = np.maximum(q, 1e-300)
        return np.log(total) - np.einsum("nk,nk->n", q, np.log(logs, out=logs)) / total

    return (entropy(h.sum(1)) + entropy(h.sum(2))) / np.maximum(entropy(h.reshape(len(h), -1)), 1e-12)


def likeness(moving: np.ndarray, fixed: np.ndarray, points: np.ndarray, size: np.ndarray, bins: int, width: float = 1.0, together: int = 1 << 15):
    """A function of pairs and places (numbers k, rigid parameters k x 6): the normalised information of ``fixed`` at ``points`` (mm)
    and ``moving`` where they are moved to; -inf if less than a quarter lie inside. Volumes (n x nz x ny x nx) are ``in_bins``.

    A value is shared by the two bins next to it, so the histogram changes smoothly with it, and then spread over ``width`` bins
    (standard deviation). Some ``together`` samples are worked on at once, in the same few arrays."""
    (nz, ny, nx), some = moving.shape[1:], max(1, together // max(len(points), bins * bins))
    flat, strides = np.ascontiguousarray(moving, dtype=float).ravel(), (1, nx, nx * ny)
    steps = [stride if n > 1 else 0 for stride, n in zip(strides, (nx, ny, nz), strict=True)]
    centre, last = (np.array(fixed.shape[:0:-1]) - 1) / 2 * size, np.array([[nx - 1.0], [ny - 1.0], [nz - 1.0]])
    arms = np.vstack([(points - centre).T, np.ones(len(points))])
    known = trilinear(fixed, points / size)
    row, share = np.floor(known) * bins, known - np.floor(known)
    spread = np.exp(-0.5 * (np.subtract.outer(np.arange(bins), np.arange(bins)) / width) ** 2)
    spread[spread < 1e-60] = 0  # no sum changes by them, but products of such numbers are slow
    spread /= spread.sum(0)
    room = [np.empty((some, *axes, len(points)), kind) for axes, kind in (((3,), float), ((3,), float), ((), int), *[((), float)] * 4)]

    def part(which, m):
        n = len(which)
        at, low, place, *near, u = (r[:n] for r in room)
        np.matmul(m.reshape(-1, 4), arms, out=at.reshape(3 * n, -1))
        if (size != 1).any():
            at /= size[:, None]
        inside = at >= 0
        inside &= at <= last
        inside = inside[:, 0] & inside[:, 1] & inside[:, 2]
        np.floor(at, out=low)
        at -= low
        np.matmul(np.array([strides], float), low, out=u[:, None])
        u += (which * float(nx * ny * nz))[:, None]
        place[:] = u

        def values(axis, first, out):
            """Between the voxels next to a place; what lies past the edge has no share in what is inside."""
            if axis < 0:
                flat[first:].take(place, out=out, mode="wrap")
                return
            values(axis - 1, first, out)
            values(axis - 1, first + steps[axis], near[axis])
            near[axis] -= out
            near[axis] *= at[:, axis]
            out += near[axis]

        values(2, 0, u)
        np.clip(u, 0, bins - 1, out=u)
        upper, lower, other = near
        np.floor(u, out=other)
        u -= other
        other += row.take(which, axis=0, out=upper, mode="wrap")
        other += (np.arange(n) * float(bins * bins))[:, None]
        place[:] = other
        lower[:] = inside
        share.take(which, axis=0, out=upper, mode="wrap")
        upper *= lower
        lower -= upper
        h = np.zeros(n * bins * bins + bins + 1)
        for first, weight in ((0, lower), (bins, upper)):
            np.multiply(weight, u, out=other)
            weight -= other
            for k, w in ((first, weight), (first + 1, other)):
                h[k:] += np.bincount(place.ravel(), w.ravel(), len(h))[: len(h) - k]
        found = normalised_information(spread @ h[: n * bins * bins].reshape(n, bins, bins) @ spread.T)
        found[inside.sum(1) < max(1, len(points) // 4)] = -np.inf
        return found

    def value(which, p):
        m = rigid_each(p)[:, :3].copy()
        m[:, :, 3] += centre
        return np.concatenate([part(which[k : k + some], m[k : k + some]) for k in range(0, len(p), some)])

    return value


def along(value, which: np.ndarray, p: np.ndarray, direction: np.ndarray, best: np.ndarray, tolerance: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """Steps, each along its direction, that don't lower ``value``: from the best of a few places on the line to the top by
    golden sections, on all lines side by side."""
    rows, ratio = np.arange(len(p)), (5**0.5 - 1) / 2
    spots = np.array([-2.0, -1.0, -0.4, 0.4, 1.0, 2.0])
    look = lambda some, s: value(which[some], p[some] + s[:, None] * direction[some])
    seen = np.insert(look(np.repeat(rows, 6), np.tile(spots, len(p))).reshape(-1, 6), 3, best, axis=1)
    spots, at = np.insert(spots, 3, 0.0), seen.argmax(1)
    top, best, low, high = spots[at], seen[rows, at], spots[np.maximum(at - 1, 0)], spots[np.minimum(at + 1, 6)]
    a, b = high - ratio * (high - low), low + ratio * (high - low)
    at_a, at_b = look(rows, a), look(rows, b)
    while True:
        for s, found in ((a, at_a), (b, at_b)):
            top, best = np.where(found > best, s, top), np.maximum(found, best)
        first = at_a >= at_b
        low, high = np.where(first, low, a), np.where(first, b, high)
        left = np.flatnonzero(high - low > tolerance)
        if not len(left):
            return p + top[:, None] * direction, best
        new = np.where(first, high - ratio * (high - low), low + ratio * (high - low))
        found = np.full(len(p), -np.inf)
        found[left] = look(left, new[left])
        a, b, at_a, at_b = np.where(first, new, b), np.where(first, a, new), np.where(first, found, at_b), np.where(first, at_a, found)


def coregister_levels(moving: np.ndarray, fixed: np.ndarray, voxel: tuple[float, float, float] = (1, 1, 1), sep: tuple[float, ...] = (4.0, 2.0), rounds: int = 8, bins: int = 64, seed: int = 0) -> np.ndarray:
    """Rigid parameters (mm, radians) that carry fixed's coordinates into moving by normalised mutual information, from coarse
    to fine samples (``sep`` in mm, jittered). Bins lie over the values of the whole images, with as many in each: over those of the overlap,
    motion would pay merely because it moves the bins.

    Powell's method: line searches along a set of directions, in which the way of a whole round takes the place of the
    direction that gained most. A round that gains little ends a level. Both may be many volumes (n x nz x ny x nx), pair by pair,
    which are searched side by side."""
    if moving.ndim == 3:
        return coregister_levels(moving[None], fixed[None], voxel, sep, rounds, bins, seed)[0]
    if not (np.isfinite(moving).all() and np.isfinite(fixed).all()):
        raise ValueError("a volume isn't finite")
    size, p = np.array(voxel, float), np.zeros((len(moving), 6))
    if not len(p):
        return p
    rng, end = np.random.default_rng(seed), (np.array(fixed.shape[:0:-1]) - 1) * size
    moving, fixed = in_bins(moving, bins), in_bins(fixed, bins)
    for step in sep:
        steps = [np.arange(0, n * s, step) for n, s in zip(fixed.shape[:0:-1], size, strict=True)]
        points = np.stack(np.meshgrid(*steps, indexing="ij"), -1).reshape(-1, 3)
        points = np.clip(points + rng.uniform(-0.5, 0.5, points.shape) * step, 0, end)
        value = likeness(moving, fixed, points, size, bins)
        directions, left = np.tile(np.diag([step, step, step, 0.03, 0.03, 0.03]), (len(p), 1, 1)), np.arange(len(p))
        best = value(left, p)
        for _ in range(rounds):
            start, was, gains = p[left], best[left], np.zeros((6, len(left)))
            for k in range(6):
                before = best[left]
                p[left], best[left] = along(value, left, p[left], directions[left, k], before)
                gains[k] = best[left] - before
            way = p[left] - start
            gone = (way != 0).any(1)
            if gone.any():
                some = left[gone]
                p[some], best[some] = along(value, some, p[some], way[gone], best[some])
                directions[some, gains.argmax(0)[gone]] = way[gone]
            left = left[~(best[left] - was < 1e-5 * (1 + np.abs(was)))]
            if not len(left):
                break
    return p


def coregister(moving: np.ndarray, fixed: np.ndarray, iterations: int = 64, step: float = 0.25, tolerance: float = 1e-4, mode: str = "mi") -> np.ndarray:
    """Rigid parameters (voxels, radians) that carry fixed's coordinates into moving, by ascent on mutual information.
    ``identity`` leaves the images as they are. ``moving`` may be many volumes (n x nz x ny x nx), which take their steps together."""
    if moving.ndim == 3:
        return coregister(moving[None], fixed, iterations, step, tolerance, mode)[0]
    p = np.zeros((len(moving), 6))
    if mode == "identity" or not len(p):
        return p
    nz, ny, nx = fixed.shape
    points, centre = grid((nx, ny, nz)), (np.array([nx, ny, nz]) - 1) / 2
    last = np.array(moving.shape[:0:-1]) - 1
    sides = np.kron(np.eye(6), [[1.0], [-1.0]])
    scale = np.array([1, 1, 1, 0.05, 0.05, 0.05])

    def values(volumes, q):
        """Of n x k places, n x k."""
        n, k, _ = q.shape
        m = rigid_each(q.reshape(-1, 6))
        at = (points - centre) @ m[:, :3, :3].transpose(0, 2, 1) + centre + m[:, None, :3, 3]
        inside = ((at >= 0) & (at <= last)).all(2)
        there = trilinear_each(volumes[:, None], at.reshape(n, -1, 3)).reshape(n * k, -1)
        out, enough = np.full(n * k, -np.inf), inside.sum(1) > len(points) // 4
        if enough.any():
            out[enough] = informations(np.broadcast_to(fixed.ravel(), there.shape)[enough], there[enough], inside[enough])
        return out.reshape(n, k)

    best, reach, left = values(moving, p[:, None])[:, 0], np.full(len(p), float(step)), np.arange(len(p))
    for _ in range(iterations):
        trials = p[left, None] + reach[left, None, None] * sides * scale
        found = values(moving[left], trials)
        top = found.argmax(1)
        high = found[np.arange(len(left)), top]
        gained = high > best[left] + tolerance
        p[left[gained]], best[left[gained]] = trials[gained, top[gained]], high[gained]
        reach[left[~gained]] /= 2
        left = left[reach[left] >= 0.01]
        if not len(left):
            break
    return p


def rigid_each(p: np.ndarray) -> np.ndarray:
    """``rigid`` of every row: n x 4 x 4."""
    angles, which = np.unique(p[:, 3:], return_inverse=True)
    c, s = (np.array([f(a) for a in angles])[which.reshape(-1, 3)] for f in (math.cos, math.sin))
    x, y, z = (np.tile(np.eye(3), (len(p), 1, 1)) for _ in range(3))
    for m, k, (i, j) in ((x, 0, (1, 2)), (y, 1, (2, 0)), (z, 2, (0, 1))):
        m[:, i, i], m[:, j, j], m[:, i, j], m[:, j, i] = c[:, k], c[:, k], -s[:, k], s[:, k]
    out = np.tile(np.eye(4), (len(p), 1, 1))
    out[:, :3, :3], out[:, :3, 3] = z @ y @ x, p[:, :3]
    return out


def informations(a: np.ndarray, b: np.ndarray, inside: np.ndarray, bins: int = 32) -> np.ndarray:
    """``mutual_information`` of every row of two n x m lists, of the samples that lie ``inside``."""

    def places(v):
        low, high = np.where(inside, v, np.inf).min(1), np.where(inside, v, -np.inf).max(1)
        if not (np.isfinite(low).all() and np.isfinite(high).all()):
            raise ValueError("a volume isn't finite")
        low, high = np.where(low == high, low - 0.5, low)[:, None], np.where(low == high, high + 0.5, high)[:, None]
        edges = np.arange(bins + 1) * ((high - low) / bins) + low
        edges[:, -1:] = high
        k = np.clip(np.where(inside, (v - low) / (high - low) * bins, 0).astype(int), 0, bins - 1)
        k = np.maximum(k - (v < np.take_along_axis(edges, k, 1)), 0)
        return np.minimum(k + (v >= np.take_along_axis(edges, k + 1, 1)), bins - 1)

    n = len(a)
    cell = ((np.arange(n) * bins)[:, None] + places(a)) * bins + places(b)
    h = np.bincount(cell[inside], minlength=n * bins * bins).reshape(n, bins, bins) / inside.sum(1)[:, None, None]
    pa_, pb = h.sum(2), h.sum(1)
    row, i, j = np.nonzero(h)
    p = h[row, i, j]
    terms = p * np.log(p / (pa_[row, i] * pb[row, j]))
    many = np.bincount(row, minlength=n)
    first, out = np.cumsum(many) - many, np.zeros(n)
    for m in np.unique(many):  # rows of one length are added up as one row would be
        out[many == m] = terms[first[many == m][:, None] + np.arange(m)].sum(1)
    return out


def integrate(v: np.ndarray, steps: int = 6) -> np.ndarray:
    """Displacement of a stationary velocity field (3 x nz x ny x nx, or many along an axis before) by scaling and squaring."""
    if v.ndim == 4:
        return integrate(v[None], steps)[0]
    return np.moveaxis(_integrated(np.moveaxis(v, 1, 0), steps), 0, 1)


def compose(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Displacement of x -> x + second(x), then first there."""
    return pull(first, second) + second


def pull(volumes: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Volumes (n x nz x ny x nx) at x + u(x); positions are kept inside. Both may be many, along an axis before."""
    if u.ndim == 4:
        return pull(volumes[None], u[None])[0]
    return np.moveaxis(_pulled(np.moveaxis(volumes, 1, 0), np.moveaxis(u, 1, 0)), 0, 1)


def _integrated(v: np.ndarray, steps: int) -> np.ndarray:
    """``integrate``, but the three components come first, as many volumes before one another."""
    u = v / 2**steps
    for _ in range(steps):
        u = _pulled(u, u) + u
    return u


def _pulled(volumes: np.ndarray, u: np.ndarray) -> np.ndarray:
    """``pull`` of images x n x nz x ny x nx by 3 x n x nz x ny x nx: one list of places and shares serves all images."""
    size = u.shape[:1:-1]
    flat, voxels = volumes.reshape(len(volumes), -1).astype(float, copy=False), math.prod(size)
    place, stride, shares, steps = np.repeat(np.arange(u.shape[1]) * voxels, voxels), 1, [], []
    for a, n in enumerate(size):
        at = np.clip(u[a] + np.arange(float(n)).reshape(-1, *[1] * a), 0, n - 1).ravel()
        low = np.clip(at.astype(int), 0, max(n - 2, 0))
        place += low * stride
        shares.append(at - low)
        steps.append(stride if n > 1 else 0)
        stride *= n

    def values(place, a=2):
        if a < 0:
            return flat.take(place, axis=1)
        near, far = values(place, a - 1), values(place + steps[a], a - 1)
        near *= 1 - shares[a]
        far *= shares[a]
        near += far
        return near

    return values(place).reshape(len(volumes), *u.shape[1:])


def pooled(volumes: np.ndarray, k: int) -> np.ndarray:
    """Means of blocks of k x k x k voxels; voxels beyond the last whole block are left out."""
    n, *size = volumes.shape
    nz, ny, nx = (a // k for a in size)
    return volumes[:, : nz * k, : ny * k, : nx * k].reshape(n, nz, k, ny, k, nx, k).mean((2, 4, 6))


def refined(volumes: np.ndarray, k: int, size: tuple[int, int, int]) -> np.ndarray:
    """Block means brought back to the fine grid of ``size``, block centres to block centres."""
    nz, ny, nx = size
    points = np.clip((grid((nx, ny, nz)) + 0.5) / k - 0.5, 0, np.array(volumes.shape[:0:-1]) - 1)
    return trilinear(volumes, points).reshape(len(volumes), nz, ny, nx)


def warp(moving: np.ndarray, fixed: np.ndarray, iterations: int = 40, rate: float = 0.2, regular: float = 0.1, coarse: tuple[int, ...] = (3, 3, 6)) -> np.ndarray:
    """Displacement that carries ``moving`` onto ``fixed``: descent on squared differences with a smoothing term.

    From coarse to fine: ``coarse`` are the iterations on grids of 1/8, 1/4, 1/2 (if three), ``iterations`` those on the
    full one. Grids of less than two voxels along an axis are left out, as they have no slopes. ``moving`` may be many volumes
    (n x nz x ny x nx), whose fields descend side by side."""
    if moving.ndim == 3:
        return warp(moving[None], fixed, iterations, rate, regular, coarse)[0]
    v = np.zeros((3, len(moving), *fixed.shape))
    whole = lambda c: c.reshape(-1, *c.shape[2:])
    for level, count in enumerate(coarse):
        k = 2 ** (len(coarse) - level)
        if min(fixed.shape) // k >= 2:
            start = pooled(whole(v), k).reshape(3, len(moving), *(n // k for n in fixed.shape)) / k
            gone = _descend(start.copy(), pooled(moving, k), pooled(fixed[None], k)[0], count, rate, regular) - start
            v = v + k * refined(whole(gone), k, fixed.shape).reshape(v.shape)
    return np.moveaxis(_integrated(_descend(v, moving, fixed, iterations, rate, regular), 6), 0, 1)


def _descend(v: np.ndarray, moving: np.ndarray, fixed: np.ndarray, iterations: int, rate: float, regular: float) -> np.ndarray:
    steepest = np.abs(np.stack(np.gradient(moving, axis=(1, 2, 3)), 1)).max((1, 2, 3, 4))
    scale = np.maximum(1e-12, steepest**2)[:, None, None, None]
    for _ in range(iterations):
        warped = _pulled(moving[None], _integrated(v, 4))[0]
        slope = np.stack(np.gradient(warped, axis=(3, 2, 1)))
        v -= rate * ((warped - fixed) * slope / scale - regular * _laplace(v))
    return v


def _laplace(c: np.ndarray) -> np.ndarray:
    """Along the last three axes."""
    out = np.zeros_like(c)
    for a in range(c.ndim - 3, c.ndim):
        d, to = np.diff(c, axis=a), np.moveaxis(out, a, 0)
        to[:-1] += np.moveaxis(d, a, 0)
        to[1:] -= np.moveaxis(d, a, 0)
    return out


def per_volume(blocks: DataFrame, shape: Shape, fixed: np.ndarray, method, columns: str, together: int = 64) -> DataFrame:
    """``method(volumes, fixed)`` for ``together`` block rows at a time; its numbers become the array column ``columns``. The rows
    are dealt out anew, as files of small volumes would be few tasks."""
    from voxloom.operators.layout import map_arrays

    nx, ny, nz = shape

    def kernel(flat):
        v = flat.reshape(-1, nz, ny, nx)
        return np.concatenate([method(v[k : k + together], fixed).reshape(len(v[k : k + together]), -1) for k in range(0, len(v), together)])

    return map_arrays(dealt(blocks), "data", kernel, columns)


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` over four tasks a core, for work that is long for its bytes."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def standard_grid(low, high, voxel: float) -> tuple[Shape, np.ndarray]:
    """Shape and affine (x from left to right) of a box in mm."""
    low, high = np.asarray(low, float), np.asarray(high, float)
    shape = tuple(int(n) for n in np.round((high - low) / voxel) + 1)
    affine = np.diag([voxel, voxel, voxel, 1.0])
    affine[:3, 3] = low
    return shape, affine


def normalise(source: np.ndarray, source_affine: np.ndarray, field: np.ndarray, template_affine: np.ndarray, target_shape: Shape, target_affine: np.ndarray) -> np.ndarray:
    """The source on the target grid: target voxel, world, template voxel plus its displacement, world, source voxel."""
    world = grid(target_shape) @ target_affine[:3, :3].T + target_affine[:3, 3]
    inv = np.linalg.inv(template_affine)
    at = world @ inv[:3, :3].T + inv[:3, 3]
    at = at + trilinear(field, at).T
    world = at @ template_affine[:3, :3].T + template_affine[:3, 3]
    inv = np.linalg.inv(source_affine)
    nx, ny, nz = target_shape
    return trilinear(source[None], world @ inv[:3, :3].T + inv[:3, 3])[0].reshape(nz, ny, nx)
