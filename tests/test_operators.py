"""Known values, recovery of planted parameters, and odd inputs."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxloom.functions.scalar import erf, hrf, incomplete_beta, quaternion_affine, saturated, t_p
from voxloom.operators import glm, layout, registration, relational, segment, spatial, temporal
from voxloom.plans.config import Acquisition, FirstLevel, Spatial


# --- response, design, models ----------------------------------------------------------------------------------------
def test_response_known_values():
    t = np.arange(257) * 0.125
    h = hrf(t)
    assert h.max() == 1 and t[h.argmax()] == 5.0
    assert h.min() == pytest.approx(-0.088911, abs=1e-6) and t[h.argmin()] == 15.75
    assert h.sum() * 0.125 == pytest.approx(4.750536, abs=1e-6)
    assert (hrf(np.array([-1.0, 0.0, 5.0]))[:2] == 0).all()


def test_task_regressor_known_values():
    r = glm.task_regressor([0, 30, 60, 90, 120], [15] * 5, 150, 2.0)
    assert r[:5] == pytest.approx([0.002386, 0.442908, 2.126426, 3.938041, 4.998860], abs=1e-6)
    assert r.max() == pytest.approx(5.416877, abs=1e-6) and r.std(ddof=1) == pytest.approx(2.440962, abs=1e-6)


def test_design_columns():
    level = FirstLevel()
    x, names = glm.design(level.conditions, 150, 2.0)
    assert x.shape == (150, 2) and names == ["Task", "constant"] and "Rest" not in names and x[:, 0].std() > 1e-6
    x, names = glm.design(level.conditions, 150, 2.0, motion=np.zeros((150, 6)), cutoff=128.0)
    assert x.shape == (150, 2 + 6 + 4)
    with pytest.raises(ValueError):
        glm.design(level.conditions, 150, 2.0, motion=np.zeros((149, 6)))


def test_rank_repair_keeps_the_protected():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20, 4))
    x[:, 2] = x[:, 0] + x[:, 1]
    assert glm.full_rank(x, [0]) == [0, 1, 3]
    with pytest.raises(ValueError):
        glm.full_rank(np.ones((5, 2)), [0, 1])
    q = glm.orthogonalised(x[:, [0, 1, 3]])
    assert abs(q.T @ q - np.diag(np.diag(q.T @ q))).max() < 1e-10


def test_basis_is_orthonormal_and_filter_removes_drift():
    b = temporal.dct_basis(150, 2.0, 128.0)
    assert b.shape == (150, 4) and abs(b.T @ b - np.eye(4)).max() < 1e-12
    y = np.random.default_rng(0).normal(size=(3, 150))
    f = temporal.high_pass(150, 2.0, 128.0)
    assert abs(f(y + 5 * b[:, 1]) - f(y)).max() < 1e-10


def test_ols_contrasts_and_f(spark):
    rng = np.random.default_rng(42)
    x = np.concatenate([rng.normal(size=(40, 4)), np.ones((40, 1))], 1)
    y = rng.normal(size=(4, 40)) + 3 * x[:, 0]
    rows = spark.createDataFrame([(k, list(map(float, v))) for k, v in enumerate(y)], "voxel int, series array<double>")
    got = glm.ols(rows, x, {"a": (1.0,)}).orderBy("voxel").toPandas()
    beta = np.linalg.lstsq(x, y.T, rcond=None)[0]
    s2 = ((y.T - x @ beta) ** 2).sum(0) / 35
    t = beta[0] / np.sqrt(s2 * np.linalg.inv(x.T @ x)[0, 0])
    assert got.t_a.to_numpy() == pytest.approx(t) and np.stack(got.beta.to_numpy()) == pytest.approx(beta.T)
    assert glm.f_statistic(rows, x, np.eye(5)[:1]).orderBy("voxel").toPandas().f.to_numpy() == pytest.approx(t**2)
    with pytest.raises(ValueError):
        glm.ols(rows, x, {"a": (1.0,)}, removed=35)


def test_t_tail_on_both_sides_of_thirty():
    for t, df in ((2.0, 10), (2.0, 30), (2.0, 31), (0.5, 7), (4.0, 138)):
        x = np.linspace(0, t, 20_001)
        density = np.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + x * x / df) ** (-(df + 1) / 2)
        assert t_p(np.array([t]), df)[0] == pytest.approx(1 - 2 * np.trapezoid(density, x), abs=1e-8)
        assert t_p(np.array([-t]), df, 1)[0] == pytest.approx(1 - t_p(np.array([t]), df, 1)[0])
    assert t_p(np.array([1.0]), 1)[0] == pytest.approx(0.5)
    assert t_p(np.array([0.0]), 5, 1)[0] == 0.5 and incomplete_beta(2, 3, 1) == 1


def test_error_function(spark):
    xs = [-2.0, -0.3, 0.0, 0.7, 3.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(erf(F.col("x")).alias("e")).toPandas().e
    assert got.to_numpy() == pytest.approx([math.erf(x) for x in xs], abs=2e-7)


def test_whitening_and_rho(spark):
    rng = np.random.default_rng(3)
    for rho in (0.0, 0.3, 0.8):
        e = rng.normal(size=(60, 400))
        y = np.zeros_like(e)
        y[:, 0] = e[:, 0] / math.sqrt(1 - rho * rho)
        for k in range(1, 400):
            y[:, k] = rho * y[:, k - 1] + e[:, k]
        rows = spark.createDataFrame([(list(map(float, v)),) for v in y], "series array<double>")
        got = temporal.global_rho(rows)
        assert abs(got - rho) < 0.05
        white = rows.select(temporal.whiten(F.col("series"), got).alias("series"))
        assert abs(temporal.global_rho(white)) < 0.05


def test_step_up_rule_and_ranks(spark):
    p = [0.001, 0.04, 0.03, 0.2, 0.001, 0.9, None]
    rows = spark.createDataFrame(list(enumerate(p)), "k int, p double")
    got = glm.fdr(rows, "p", "k", q=0.05).orderBy("k").toPandas()
    assert list(got["rank"]) == [1, 4, 3, 5, 2, 6] and list(got.significant) == [True, False, False, False, True, False]
    assert glm.fdr(rows.limit(0), "p", "k").count() == 0


# --- volumes ---------------------------------------------------------------------------------------------------------
def test_taps_and_smoothing():
    taps = spatial.gaussian_taps(6, 3)
    assert taps[:4] == pytest.approx([0.000917, 0.029358, 0.234862, 0.469725], abs=1e-6) and taps.sum() == pytest.approx(1)
    assert list(spatial.gaussian_taps(0, 3)) == [1.0]
    shape = (5, 4, 3)
    flat = np.full((2, 60), 7.0)
    assert spatial.smooth(shape, 6, (3, 3, 3))(flat) == pytest.approx(flat)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(-3, 3), min_size=4, max_size=4), st.lists(st.floats(0, 1), min_size=3, max_size=3))
def test_interpolation_is_exact_on_ramps(w, at):
    shape = (4, 3, 5)
    g = spatial.grid(shape)
    v = (g @ np.array(w[:3]) + w[3]).reshape(1, 5, 3, 4)
    point = np.array(at) * (np.array(shape) - 1)
    assert spatial.trilinear(v, point[None])[0, 0] == pytest.approx(point @ np.array(w[:3]) + w[3], abs=1e-9)
    assert spatial.trilinear(v, point[None] - 50)[0, 0] == 0


def test_fourier_shift_delays():
    t = np.arange(64)
    x = np.sin(2 * np.pi * 3 * t / 64)[None]
    assert temporal.fourier_shift(2.5, 1.0)(x) == pytest.approx(np.sin(2 * np.pi * 3 * (t - 2.5) / 64)[None], abs=1e-12)


def blob(shape=(20, 20, 16), at=(0, 0, 0)):
    g = spatial.grid(shape) - (np.array(shape) - 1) / 2 - np.array(at)
    v = np.exp(-(g**2).sum(1) / 40) + 0.4 * np.exp(-((g - [4, -3, 2]) ** 2).sum(1) / 12)
    return v.reshape(shape[::-1])


def test_realign_recovers_motion(spark):
    shape, moved = (20, 20, 16), [(0, 0, 0), (0.6, -0.4, 0.3), (-0.8, 0.5, 0.2)]
    rows = spark.createDataFrame([("a", k, list(map(float, blob(shape, m).ravel()))) for k, m in enumerate(moved)], "run string, t int, data array<double>")
    got = registration.realign(rows, shape, "run").orderBy("t").toPandas()
    shift = got[["tx", "ty", "tz"]].to_numpy()
    # interpolation blurs, so a volume that lies on the grid is best matched a little off it
    assert abs(shift - np.array(moved)).max() < 0.15 and abs(got[["rx", "ry", "rz"]].to_numpy()).max() < 0.03
    again = np.stack(got.data.to_numpy())
    inner = lambda v: v.reshape(shape[::-1])[2:-2, 2:-2, 2:-2]
    before = ((blob(shape, moved[1]) - blob(shape)) ** 2)[2:-2, 2:-2, 2:-2].mean()
    assert ((inner(again[1]) - inner(again[0])) ** 2).mean() < 0.2 * before


def test_warp_brings_volumes_closer():
    fixed, moving = blob((12, 12, 10)), blob((12, 12, 10), (1, 0, 0))
    u = registration.warp(moving, fixed)
    assert ((registration.pull(moving[None], u)[0] - fixed) ** 2).mean() < 0.4 * ((moving - fixed) ** 2).mean()
    zero = np.zeros((3, 4, 4, 4))
    assert abs(registration.integrate(zero)).max() == 0 and abs(registration.compose(zero, zero)).max() == 0


def test_coregistration_does_not_lower_the_information():
    fixed = blob((14, 14, 12))
    moving = 1 - blob((14, 14, 12), (1, -1, 0))
    p = registration.coregister(moving, fixed)
    value = lambda v: registration.mutual_information(fixed.ravel(), v.ravel())
    assert value(registration.reslice(moving, p)) > value(moving)
    assert not registration.coregister(moving, fixed, mode="identity").any()


def test_standard_grid():
    shape, affine = registration.standard_grid((-90, -126, -72), (90, 90, 108), 3.0)
    assert shape == (61, 73, 61) and list(affine[:3, 3]) == [-90, -126, -72]


# --- tables ----------------------------------------------------------------------------------------------------------
def test_hazen_percentile(spark):
    rng = np.random.default_rng(2)
    v = np.round(rng.normal(size=500), 1)
    rows = spark.createDataFrame([(int(k % 2), float(x)) for k, x in enumerate(v)] + [(3, None), (4, 2.0)], "g int, v double")
    got = {r.g: r.hazen for r in relational.hazen(rows, ["g"], "v", 70, buckets=7).collect()}
    for g in (0, 1):
        assert got[g] == pytest.approx(np.percentile(v[g::2], 70, method="hazen"))
    assert got[4] == 2.0


def test_clusters_touch_by_faces_only(spark):
    at = [(0, 0, 0), (0, 0, 1), (0, 1, 2), (2, 2, 2), (3, 2, 2)]
    rows = spark.createDataFrame([(1, *p) for p in at], "t int, z int, y int, x int")
    got = relational.clusters(rows, ["t"]).groupBy("cluster").count().collect()
    assert sorted(r["count"] for r in got) == [1, 2, 2]
    assert relational.extent(relational.clusters(rows, ["t"]), ["t"], 2).count() == 4


def test_mixture_recovers_classes(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(0, 1, 600), rng.normal(8, 1.5, 300)])
    found = segment.mixture(spark.createDataFrame([(float(x),) for x in v], "v double"), "v", 2, iterations=30)
    assert [round(c[1]) for c in found] == [0, 8] and found[0][0] == pytest.approx(2 / 3, abs=0.03)


def test_whole_number_cast_saturates(spark):
    rows = spark.createDataFrame([(2.5,), (-2.5,), (400.0,), (-400.0,), (None,)], "v double")
    got = [r[0] for r in rows.filter("v is not null").select(saturated(F.col("v"), -128, 127, "int")).collect()]
    assert got == [3, -3, 127, -128]


def test_blocks_and_voxels_round_trip(spark):
    shape = (3, 2, 2)
    rows = spark.createDataFrame([(7, [float(k) for k in range(12)])], "t int, data array<double>")
    voxels = layout.voxels(rows, shape)
    assert voxels.count() == 12 and voxels.filter("z = 1 and y = 0 and x = 2").first().v == 8.0
    back = layout.blocks(voxels.filter("v <> 3"), shape, ["t"]).first()
    data = next(v for v in back if isinstance(v, list))
    assert data[3] is None and data[11] == 11.0


def test_quaternion_handedness():
    a = quaternion_affine(0, 0, 0, (1, 2, 3), (0, 2, 2, 2, 0, 0, 0, 0))
    assert a[2, 2] == 2 and list(a[:3, 3]) == [1, 2, 3]
    assert quaternion_affine(0, 0, 0, (0, 0, 0), (-1, 2, 2, 2, 0, 0, 0, 0))[2, 2] == -2


def test_configuration_fails_fast():
    for wrong in (lambda: Acquisition(tr=0), lambda: Acquisition(slices=3), lambda: FirstLevel(correction="x"), lambda: FirstLevel(contrast=(1, 2)), lambda: Spatial(voxel=0)):
        with pytest.raises(ValueError):
            wrong()
