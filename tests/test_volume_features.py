"""Estimated noise, frames and private headers, tolerance groups, rigid fits and surfaces: made cases with known answers."""

import itertools
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.operators import bias, glm, layout, matching, registration, scaling, spatial, splines, surface
from voxloom.sources import dicom, dicom_frames


def put(spark, arrays, **keys):
    """Rows (keys, series or data) from arrays."""
    name = keys.pop("name", "series")
    rows = [(*(v[k] for v in keys.values()), a.tolist()) for k, a in enumerate(arrays)]
    return spark.createDataFrame(rows, ", ".join([*(f"{k} long" for k in keys), f"{name} array<double>"])).repartition(3)


# --- noise covariance -------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def noise():
    rng, n = np.random.default_rng(1), 40
    v = 0.3 ** np.abs(np.subtract.outer(np.arange(n), np.arange(n)))
    x = np.stack([np.ones(n), np.sin(np.arange(n) / 4)], 1)
    y = rng.normal(size=(1500, n)) @ np.linalg.cholesky(v).T + rng.normal(size=(1500, 1)) * 5
    return v, x, y


def test_covariance_of_made_noise_is_found(noise):
    v, x, y = noise
    h, got = glm.covariance(y.T @ y, len(y), x, glm.autoregressive(len(v)))
    assert np.abs(got * len(v) / np.trace(got) - v).max() < 0.06 and h[1] > 0
    for rho, limit in ((0.0, 0.05), (-0.2, 0.06)):
        white = np.random.default_rng(2).normal(size=(4000, 40)) @ np.linalg.cholesky(rho ** np.abs(np.subtract.outer(range(40), range(40))) if rho else np.eye(40)).T
        h, got = glm.covariance(white.T @ white, 4000, x, glm.autoregressive(40))
        assert abs(got[0, 1] / got[0, 0] - rho) < limit


def test_likelihood_is_at_its_top(noise):
    """No small change of the components' weights raises the restricted likelihood, computed from the residuals' own space."""
    v, x, y = noise
    q = glm.autoregressive(len(v))
    h, _ = glm.covariance(y.T @ y, len(y), x, q)
    space = np.linalg.svd(x, full_matrices=True)[0][:, x.shape[1] :]
    e = y @ space

    def likelihood(h):
        s = space.T @ (h[0] * q[0] + h[1] * q[1]) @ space
        return -0.5 * (len(y) * np.linalg.slogdet(s)[1] + np.einsum("ij,jk,ik->", e, np.linalg.inv(s), e))

    best = likelihood(h)
    assert all(likelihood(h + d) <= best + 1e-6 for d in 0.01 * np.array(list(itertools.product((-1, 0, 1), repeat=2))))


def test_scatter_leaves_out_what_is_not_finite(spark):
    rows = spark.createDataFrame([([1.0, 2.0],), ([3.0, -1.0],), (None,), ([1.0, None],), ([float("nan"), 1.0],), ([float("inf"), 1.0],)], "series array<double>").repartition(3)
    got, n = glm.scatter(rows)
    assert n == 2 and got.tolist() == [[10, -1], [-1, 5]]
    assert glm.scatter(rows.limit(0))[1] == 0
    with pytest.raises(Exception, match="different lengths|lengths"):
        glm.scatter(spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "series array<double>").coalesce(1))


def test_reml_uses_the_effective_degrees_of_freedom(spark, noise):
    v, x, y = noise
    rows = put(spark, y[:300], voxel=list(range(300)))
    got = glm.reml(rows, x, glm.autoregressive(len(v)), {"wave": (0, 1)}).toPandas()
    plain = glm.ols(rows, x, {"wave": (0, 1)}).toPandas()
    # without an effect a twentieth is significant; the plain fit of a slow wave under this noise has more
    assert (got.p_wave < 0.05).mean() < 0.09 < (plain.p_wave < 0.05).mean()
    few = glm.reml(rows, x, glm.autoregressive(len(v)), {"wave": (0, 1)}, responding=1.0)
    assert few.count() == 300
    with pytest.raises(ValueError, match="no series"):
        glm.reml(rows.limit(0), x, glm.autoregressive(len(v)), {"wave": (0, 1)})


# --- smoothness -------------------------------------------------------------------------------------------------------
def test_smoothness_of_smoothed_noise(spark):
    shape, scans = (14, 14, 10), 24
    rng = np.random.default_rng(3)
    v = spatial.smooth(shape, 4.0, (1.0, 1.0, 1.0))(rng.normal(size=(scans, math.prod(shape))))
    v = v - v.mean(0)
    k = np.arange(math.prod(shape))
    rows = spark.createDataFrame([(1, int(i // 196), int(i // 14 % 14), int(i % 14), v[:, i].tolist()) for i in k], "run long, z int, y int, x int, series array<double>")
    found = glm.smoothness(rows, ["run"], scans, scans - 1)
    got = {r.axis: r for r in found.collect()}
    assert {a: r.pairs for a, r in got.items()} == {"x": 13 * 140, "y": 13 * 140, "z": 9 * 196}
    assert all(3.2 < r.fwhm < 4.8 for r in got.values())
    sizes = spark.createDataFrame([(1, len(k)), (2, 5)], "run long, voxels long")
    resels = {r.run: r.resels for r in glm.resels(found, ["run"], sizes).collect()}
    assert resels[1] == pytest.approx(len(k) / math.prod(r.fwhm for r in got.values())) and resels[2] == 5
    assert glm.euler_p(3.0, [1, 5, 20, resels[1]], 23) > glm.euler_p(6.0, [1, 5, 20, resels[1]], 23) >= 0
    assert glm.euler_p(2.5, [1], 23) == pytest.approx(float(glm.t_p(np.array([2.5]), 23, 1)[0]))


# --- frames and private headers -----------------------------------------------------------------------------------------
def files(spark, *contents):
    return spark.createDataFrame([(f"/f/{k}", bytearray(c) if c is not None else None) for k, c in enumerate(contents)], "path string, content binary")


@pytest.mark.parametrize("marked", [False, True])
def test_frames_become_volumes(spark, marked):
    pixels = np.arange(6 * 2 * 3).reshape(6, 2, 3)
    places = [(0, 0, 2), (0, 0, 0), (0, 0, 1), (0, 0, 0), (0, 0, 1), (0, 0, 2)]  # two volumes of three slices
    raw = dicom_frames.encoded_frames(pixels, places, (1, 0, 0, 0, 1, 0), "9.1", ["a"] * 6, [1, 1, 1, 2, 2, 2], [1, 2, 1, 2, 1, 0.5], marked)
    found = dicom_frames.frames(files(spark, raw, b"", None, raw[:300], b"junk" * 100))
    rows = {r.frame: r for r in found.collect()}
    assert len(rows) == 6 and rows[1].position == [0, 0, 0] and rows[1].time == 1 and rows[1].stack == "a" and rows[1].data == (pixels[1].ravel() * 2.0).tolist()
    got = {r.volume: r for r in dicom_frames.volumes(found).collect()}
    assert {k: (r.nx, r.ny, r.nz, r.places) for k, r in got.items()} == {0: (3, 2, 3, [0, 1, 2]), 1: (3, 2, 3, [0, 1, 2])}
    slope = np.array([1, 2, 1, 2, 1, 0.5])
    want = (pixels * slope[:, None, None])[:, ::-1]
    assert got[0].data == want[[1, 2, 0]].ravel().tolist() and got[1].data == want[[3, 4, 5]].ravel().tolist()


def test_frames_of_several_orientations_and_without_own_groups(spark):
    pixels = np.arange(2 * 2 * 2).reshape(2, 2, 2)
    e, word = dicom_frames.element, lambda tag, v: dicom_frames.element(tag, b"US", struct.pack("<H", v))
    plain = b"\0" * 128 + b"DICM" + e(0x00020010, b"UI", b"1.2.840.10008.1.2.1") + e(0x0020000E, b"UI", b"7") + e(0x00280008, b"IS", b"2") + word(0x00280010, 2) + word(0x00280011, 2) + word(0x00280100, 16) + e(0x7FE00010, b"OW", pixels.astype("<i2").tobytes())
    rows = dicom_frames.frames(files(spark, plain)).collect()
    assert [(r.frame, r.position, r.stack, r.spacing) for r in rows] == [(0, [], None, [1, 1]), (1, [], None, [1, 1])]
    assert {(r.volume, r.nz) for r in dicom_frames.volumes(dicom_frames.frames(files(spark, plain))).collect()} == {(0, 1), (1, 1)}
    assert dicom_frames.frames(files(spark, plain).limit(0)).count() == 0


def test_private_headers_turn_slices_round(spark):
    values = {"NumberOfImagesInMosaic": ["4"], "SliceNormalVector": ["0.0", "0.0", "-1.0"], "Empty": []}
    raw = dicom_frames.encoded_private(values)
    assert dicom_frames.private_values(raw) == values
    older = raw[8:]  # the same table without the mark, where the first of four sizes counts
    assert dicom_frames.private_values(older) == values
    assert dicom_frames.private_values(b"") == {} and dicom_frames.private_values(raw[:110]) == {} and isinstance(dicom_frames.private_values(raw[:220]), dict)
    v = np.arange(16).reshape(4, 4)
    tags = lambda n: {0x00080008: (b"CS", b"MOSAIC"), 0x0020000E: (b"UI", b"5"), 0x00200037: (b"DS", b"1\\0\\0\\0\\1\\0"), **({0x00291010: (b"OB", dicom_frames.encoded_private(values | {"SliceNormalVector": n}))} if n else {})}
    found = files(spark, *[dicom.encode(v, tags(n)) for n in (["0", "0", "1"], ["0", "0", "-1"], None, ["0", "x"])])
    private = dicom_frames.private_headers(found)
    volumes = dicom.mosaic_series(dicom.headers(found), 2, 4)
    got = {r.path: r for r in dicom_frames.in_order(volumes, private, 4, 4).collect()}
    assert [got[f"/f/{k}"].backwards for k in range(4)] == [False, True, False, False]
    one = np.array(got["/f/0"].data).reshape(4, 4)
    assert np.array_equal(np.array(got["/f/1"].data).reshape(4, 4), one[::-1]) and got["/f/2"].data == got["/f/0"].data


# --- tolerance groups ---------------------------------------------------------------------------------------------------
def brute_leaders(rows, tolerances):
    """rows: (by, key, vectors)."""
    out, known = {}, []
    for by, key, vectors in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        fits = lambda other: other[0] == by and all(len(a) == len(b) and all(abs(p - q) < t for p, q in zip(a, b, strict=True)) for a, b, t in zip(other[2], vectors, tolerances, strict=True))
        hit = None if any(v is None or None in v for v in vectors) else next((o for o in known if fits(o)), None)
        if hit is None and not any(v is None or None in v for v in vectors):
            known.append((by, key, vectors))
        out[by, key] = hit[1] if hit else key
    return out


@pytest.mark.parametrize("step", [0.25, 0.11])
def test_first_match_equals_brute_force(spark, step):
    """Chains, ties at the edges of cells, many equal rows, and rows that match nothing."""
    rng = random.Random(4)
    rows = [("a", k, ([rng.randrange(12) * step, rng.randrange(6) * step], [rng.randrange(3) * 0.5])) for k in range(250)]
    rows += [("a", 1000 + k, ([0.5, 0.5], [0.0])) for k in range(150)] + [("b", k, ([k * 0.2, 0.0], [0.0])) for k in range(25)]
    rows += [("b", 100, (None, [0.0])), ("b", 101, ([None, 0.0], [0.0])), ("b", 102, ([0.2, 0.0, 1.0], [0.0])), ("b", 103, ([0.2], [0.0]))]
    df = spark.createDataFrame([(b, k, *v, "clash") for b, k, v in rows], "g string, k long, p array<double>, q array<double>, leader_ string").repartition(3)
    got = {(r.g, r.k): r.leader.k for r in matching.leaders(df, ["g"], ["k"], ["p", "q"], [0.3, 0.4]).collect()}
    assert got == brute_leaders(rows, [0.3, 0.4])
    assert matching.leaders(df.limit(0), ["g"], ["k"], ["p", "q"], [0.3, 0.4]).count() == 0


# --- rigid fits ---------------------------------------------------------------------------------------------------------
def bumps(shape, move=None, seed=0, count=40, scale=0.6):
    """A volume of Gaussian bumps, at points moved by rigid parameters; exact at every place."""
    rng = np.random.default_rng(seed)
    c, w, a = rng.uniform(0, 1, (count, 3)) * np.array(shape), rng.uniform(3, 6, count) * scale, rng.uniform(0.5, 2, count)
    g = spatial.grid(shape)
    if move is not None:
        g = registration.moved_points(move, g, (np.array(shape) - 1) / 2)
    nx, ny, nz = shape
    return sum(a[k] * np.exp(-((g - c[k]) ** 2).sum(1) / 2 / w[k] ** 2) for k in range(count)).reshape(nz, ny, nx)


def away(shape, p, q):
    """The farthest that two motions carry a voxel apart."""
    g, c = spatial.grid(shape), (np.array(shape) - 1) / 2
    return np.abs(registration.moved_points(p, g, c) - registration.moved_points(q, g, c)).max()


def test_derivatives_of_motion():
    rng = np.random.default_rng(5)
    p, arms = np.array([0.3, -0.2, 0.1, 0.05, -0.04, 0.03]), rng.normal(size=(6, 3)) * 4
    want = np.stack([(registration.moved_points(p + d, arms, np.zeros(3)) - registration.moved_points(p - d, arms, np.zeros(3))) / 2e-6 for d in np.eye(6) * 1e-6], -1)
    assert np.allclose(registration.turned(p, arms), want, atol=1e-7)


def test_splines_pass_through_their_volume():
    rng = np.random.default_rng(6)
    for shape in ((5, 6, 7), (1, 4, 4), (2, 2, 2)):
        v = rng.normal(size=shape)
        c = splines.coefficients(v)
        assert np.allclose(splines.sample(c, spatial.grid(shape[::-1])), v.ravel())
    c, q = splines.coefficients(rng.normal(size=(6, 6, 6))), rng.uniform(0.5, 4, (30, 3))
    _, slopes = splines.sample(c, q, slopes=True)
    want = np.stack([(splines.sample(c, q + d) - splines.sample(c, q - d)) / 2e-5 for d in np.eye(3) * 1e-5], 1)
    assert np.allclose(slopes, want, atol=1e-6)


@pytest.mark.parametrize("seed", range(3))
def test_rigid_fits_recover_motion_and_splines_do_better(seed):
    shape, true = (24, 24, 18), np.array([0.7, -0.4, 0.5, 0.03, -0.02, 0.04])
    still, moved = bumps(shape, true, seed), bumps(shape, None, seed)
    linear = registration.estimate(still, moved, np.zeros(6), sep=2)
    assert away(shape, linear, true) < 0.03
    points, fixed, jacobian = registration.samples(still, 2, 0.9, 0)
    assert len(points) < len(registration.samples(still, 2, 1.0, 0)[0])  # the least informative are dropped
    m = registration.composed(splines.coefficients(moved), points, fixed, jacobian, np.eye(4), 64)
    g, c = spatial.grid(shape), (np.array(shape) - 1) / 2
    spline = np.abs(g @ m[:3, :3].T + m[:3, 3] - registration.moved_points(true, g, c)).max()
    assert spline < 0.01 and spline < away(shape, linear, true)


def test_estimate_without_overlap_or_structure_is_the_start():
    flat, start = np.ones((4, 5, 6)), np.array([0.5, 0, 0, 0, 0, 0])
    assert np.array_equal(registration.estimate(flat, flat, start), start)
    far = np.array([19.0, 0, 0, 0, 0, 0])
    assert np.array_equal(registration.estimate(bumps((6, 5, 4)), bumps((6, 5, 4)), far), far)


def test_runs_are_realigned_through_splines(spark):
    shape, c = (16, 16, 12), (np.array((16, 16, 12)) - 1) / 2
    motions = [np.zeros(6), np.array([0.6, -0.3, 0.2, 0.02, -0.01, 0.03]), np.array([-0.4, 0.5, 0.1, -0.02, 0.02, 0.01])]
    rows = put(spark, [bumps(shape, p, 7).ravel() for p in motions] * 2, name="data", run=[1] * 3 + [2] * 3, t=[0, 1, 2] * 2)
    got = registration.realign_splines(rows, shape, "run", voxel=(2.0, 2.0, 2.0), passes=1).orderBy("run", "t").collect()
    assert len(got) == 6
    for r, p in zip(got, motions * 2, strict=True):
        # volume(q(x)) is the target: q takes the scan's own motion back
        q = np.array([r.tx / 2, r.ty / 2, r.tz / 2, r.rx, r.ry, r.rz])
        there = registration.moved_points(p, registration.moved_points(q, spatial.grid(shape), c), c)
        assert np.abs(there - spatial.grid(shape)).max() < 0.1
    again = registration.realign_splines(rows, shape, "run", passes=2)
    assert again.count() == 6 and registration.realign_splines(rows.limit(0), shape, "run").count() == 0


def test_registration_by_normalised_information_at_real_size():
    shape, true = (64, 64, 36), np.array([5, -3, 2, math.radians(5), math.radians(-3), math.radians(4)])
    moving, fixed = bumps(shape, None, 3, 60, 1.5), bumps(shape, true, 3, 60, 1.5)
    other = np.sin(moving / moving.max() * np.pi) + 0.3 * moving / moving.max()  # another contrast
    got = registration.coregister_levels(other, fixed)
    assert np.abs(got[:3] - true[:3]).max() < 0.25 and np.abs(got[3:] - true[3:]).max() < 0.01


def test_a_group_of_many_scans_has_copies_of_its_target(spark):
    rows = spark.createDataFrame([(k % 2, k) for k in range(300)], "run long, t long")
    got = registration.beside(rows, spark.createDataFrame([(0, "a"), (1, "b")], "run long, target string"), "run", "t", together=16)
    assert got.count() == 300 and {(r.run, r.target) for r in got.collect()} == {(0, "a"), (1, "b")}


# --- surfaces -----------------------------------------------------------------------------------------------------------
def test_the_surface_of_a_ball_is_closed_and_has_its_size(spark):
    n, radius = 25, 9.3
    g = spatial.grid((n, n, n))
    v = radius - np.sqrt(((g - 12.1) ** 2).sum(1))
    rows = spark.createDataFrame([(1, *map(int, p[::-1]), float(a)) for p, a in zip(g, v, strict=True)], "t long, z int, y int, x int, v double").repartition(4)
    found = surface.triangles(rows, ["t"], 0.0).cache()
    size = found.agg(F.sum(surface.area(F.col("corners"))), F.sum(surface.enclosed(F.col("corners")))).first()
    assert size[0] == pytest.approx(4 * math.pi * radius**2, rel=0.02) and abs(size[1]) == pytest.approx(4 / 3 * math.pi * radius**3, rel=0.02)
    vertices, faces = surface.mesh(found, ["t"])
    edges = faces.select(F.explode(F.array(*[F.struct(F.col("vertices")[a].alias("a"), F.col("vertices")[b].alias("b")) for a, b in ((0, 1), (1, 2), (2, 0))])).alias("e")).select("e.*").filter("a <> b")
    ways = edges.groupBy("a", "b").agg(F.count("*").alias("n"))
    back = ways.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n").alias("m"))
    both = ways.join(back, ["a", "b"], "full")
    assert both.filter("n is null or m is null or n <> m").count() == 0  # each edge is run through both ways
    euler = vertices.count() - ways.count() // 2 + faces.filter("size(array_distinct(vertices)) = 3").count()
    assert euler == 2


def test_surfaces_of_odd_volumes(spark):
    one = spark.createDataFrame([(1, z, y, x, float(x)) for z in range(2) for y in range(2) for x in range(2)], "t long, z int, y int, x int, v double")
    cut = surface.triangles(one, ["t"], 0.25)
    assert cut.agg(F.sum(surface.area(F.col("corners")))).first()[0] == pytest.approx(1.0) and all(c[0] == 0.25 for r in cut.collect() for c in r.corners)
    holes = one.withColumn("v", F.when(F.col("x") + F.col("y") < 2, F.col("v")))
    for rows in (one.limit(0), one.filter("x = 0"), holes, one.withColumn("v", F.lit(float("nan")))):
        assert surface.triangles(rows, ["t"], 0.25).count() == 0
    assert surface.triangles(one, ["t"], 5.0).count() == 0


# --- brightness fields ------------------------------------------------------------------------------------------------
def test_a_made_field_is_found_beside_two_classes(spark):
    shape, rng = (18, 16, 10), np.random.default_rng(8)
    g = spatial.grid(shape)
    tissue = (rng.random((5, 4, 3)) < 0.5)[g[:, 0].astype(int) // 4, g[:, 1].astype(int) // 4, g[:, 2].astype(int) // 4]
    waves = rng.normal(size=len(bias.terms(3))) * 0.12
    true = bias.basis(shape, 3, *g.T) @ waves
    u = 1.0 * tissue + true + rng.normal(size=len(g)) * 0.08
    rows = [(1, *map(int, p), float(np.exp(a))) for p, a in zip(g, u, strict=True)]
    odd = [(1, 0, 0, 0, v) for v in (None, 0.0, -1.0, float("nan"), float("inf"))] + [(2, 0, 0, 0, -1.0)]
    df = spark.createDataFrame(rows + odd, "t long, x int, y int, z int, v double").repartition(5)
    found = bias.bias_field(df, "t", shape, classes=2, order=3, rounds=15)
    got = found.collect()
    assert [r.t for r in got] == [1] and abs(got[0].means[1] - got[0].means[0] - 1) < 0.1
    fitted = bias.basis(shape, 3, *g.T) @ np.array(got[0].waves)
    assert np.sqrt(((fitted - true) ** 2).mean()) < 0.03 < true.std()
    flat = {(r.x, r.y, r.z): r.v for r in bias.corrected(df.filter("v > 0 and v < 1e300"), "t", shape, found).collect()}
    left = np.log([flat[tuple(map(int, p))] for p in g])
    assert left[tissue].std() < 0.12 < u[tissue].std()
    assert bias.bias_field(df.limit(0), "t", shape).count() == 0


# --- one scale for all slices -------------------------------------------------------------------------------------------
def test_dithering_keeps_the_mean_and_single_scales_stay(spark):
    raw = np.linspace(0, 50, 4000).astype(int).tolist()
    rows = spark.createDataFrame([(1, 0, raw, 0.1, 0.0), (1, 1, raw, 0.3, 5.0), (2, 0, raw, 2.0, 1.0), (2, 1, [None, 3], 2.0, 1.0), (3, 0, [1, None, 9], None, None), (3, 1, [1, 1], 2.0, 0.0), (4, 0, [5], 0.0, 1.0), (4, 1, [7], 1.0, -6.0)], "v long, z int, raw array<int>, slope double, intercept double")
    got = {(r.v, r.z): r for r in scaling.one_scale(rows, ["v"], "z", bits=8).collect()}
    assert got[2, 0].stored == raw and got[2, 1].stored == [None, 3] and (got[2, 0].scale, got[2, 0].offset) == (2, 1)
    for z, (slope, shift) in enumerate(((0.1, 0.0), (0.3, 5.0))):
        r = got[1, z]
        error = np.array(r.stored) * r.scale + r.offset - (np.array(raw) * slope + shift)
        assert abs(error).max() <= r.scale * (1 + 1e-9) and abs(error.mean()) < 0.02 * r.scale and -128 <= min(r.stored) <= max(r.stored) <= 127
    assert got[1, 0].scale == got[1, 1].scale and got[3, 0].stored[1] is None
    assert [got[4, z].stored[0] * got[4, z].scale + got[4, z].offset for z in (0, 1)] == [1, 1]
    assert scaling.one_scale(rows.limit(0), ["v"], "z").count() == 0
