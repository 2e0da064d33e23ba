"""Masks, headers, DICOM, reslicing, weighted fits, exact percentiles and the first-level driver on small fixtures."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.functions.scalar import incomplete_beta, t_p
from voxloom.operators import firstlevel, glm, headers, layout, lookup, masks, relational, reslicing, temporal
from voxloom.sources import dicom, motion


# --- percentiles -------------------------------------------------------------------------------------------------------
def midpoint(v, percent):
    return masks.midpoint_percentile(np.array(v, float), percent)


@pytest.mark.parametrize("few", [5, 100_000])
def test_percentiles_by_narrowing_equal_sorted_ones(spark, few):
    rng = np.random.default_rng(4)
    groups = {"a": rng.normal(size=3000), "b": rng.integers(0, 4, 2500).astype(float), "c": np.array([7.0]), "d": np.full(900, 2.0)}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("a", None), ("e", None), ("b", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double")
    for percent in (0, 37.5, 100):
        got = {r.k: r.percentile for r in relational.percentile(df, ["k"], "v", percent, few=few, cuts=50).collect()}
        assert got.keys() == groups.keys()
        for k, v in groups.items():
            assert got[k] == pytest.approx(midpoint(v, percent), abs=1e-12)
        linear = {r.k: r.percentile for r in relational.percentile(df, ["k"], "v", percent, "linear", few=few, cuts=50).collect()}
        assert linear["a"] == pytest.approx(np.percentile(groups["a"], percent), abs=1e-9)
    assert relational.percentile(df.filter("k = 'a'"), [], "v", 50, "linear", few=few).first()[0] == pytest.approx(np.median(groups["a"]))
    assert relational.percentile(df.limit(0), [], "v", 50).count() == 0


# --- layout --------------------------------------------------------------------------------------------------------------
def test_series_fill_gaps_and_leave_out_strays(spark):
    rows = spark.createDataFrame([(1, 0, 2.0), (1, 3, 1.0), (1, 3, 4.0), (1, 9, 5.0), (2, 4, None)], "k int, s int, v double")
    got = {r.k: r.series for r in layout.series(rows, ["k"], "s", F.col("v"), 5).collect()}
    assert got == {1: [2.0, 0, 0, 5.0, 0], 2: [0.0] * 5}


def test_blocks_keep_holes_and_refuse_doubles(spark):
    rows = spark.createDataFrame([(1, 0, 0, 1, 5.0), (1, 1, 1, 0, 7.0)], "t int, z int, y int, x int, v double")
    assert layout.blocks(rows, (2, 2, 2), ["t"]).first().data == [None, 5.0, None, None, None, None, 7.0, None]
    with pytest.raises(Exception, match="occurs twice"):
        layout.blocks(rows.union(rows), (2, 2, 2), ["t"]).collect()


def test_kernels_on_ragged_and_broken_rows(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [3.0, 4.0, 5.0]), (5, [])], "k int, a array<double>")
    got = {r.k: r.a for r in layout.map_arrays(rows, "a", lambda v: v * 2).collect()}
    assert got == {1: [2.0, 4.0], 2: None, 3: None, 4: [6.0, 8.0, 10.0], 5: []}


# --- masks ---------------------------------------------------------------------------------------------------------------
def test_mask_on_its_own_grid_is_not_resampled(spark):
    m = spark.createDataFrame([([0.0, 1.0, 0.4, 0.5, 0.0, 0.0, 0.0, 1.0],)], "data array<double>")
    got = {(r.z, r.y, r.x) for r in masks.on_grid(m, (2, 2, 2), np.eye(4), (2, 2, 2), np.eye(4)).collect()}
    assert got == {(0, 0, 1), (0, 1, 1), (1, 1, 1)}
    moved = np.eye(4)
    moved[0, 3] = 1.0  # same size, other place
    assert {(r.z, r.y, r.x) for r in masks.on_grid(m, (2, 2, 2), moved, (2, 2, 2), np.eye(4)).collect()} == set()


def test_analysed_voxels_fall_back(spark):
    rows = spark.createDataFrame([(k, [float(k)] * 4) for k in range(-1, 9)], "voxel int, series array<double>")
    keys = lambda df: sorted(r.voxel for r in df.collect())
    assert keys(firstlevel.analysed_voxels(rows, ["voxel"], 0.5)) == [3, 4, 5, 6, 7, 8]
    none = rows.limit(0).select("voxel")
    assert keys(firstlevel.analysed_voxels(rows, ["voxel"], 0.5, brain=none, standard=none)) == [3, 4, 5, 6, 7, 8]
    assert keys(firstlevel.analysed_voxels(rows, ["voxel"], 0.5, brain=rows.filter("voxel < 5").select("voxel"))) == [3, 4]


def test_zero_padding_loses_weight_at_the_edge():
    v = np.ones((1, 1, 1, 5))
    got = masks.zero_padded(v, np.array([0.25, 0.5, 0.25]), 3).ravel()
    assert got.tolist() == [0.75, 1, 1, 1, 0.75]


# --- headers -------------------------------------------------------------------------------------------------------------
def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], column.alias("out")).first().out


def test_origin_goes_to_the_point(spark):
    old = np.array([[-3, 0.2, 0, 90], [0.1, 3, 0.4, -126], [0, -0.3, 4, -72], [0, 0, 0, 1.0]])
    affine = F.array(*[F.lit(float(v)) for v in old.ravel()])
    dim = [F.lit(64)] * 3
    new = np.array(one(spark, headers.with_origin(affine, dim, [F.lit(10), F.lit(20), F.lit(30)]))).reshape(4, 4)
    assert np.allclose(new @ [9, 19, 29, 1], [0, 0, 0, 1]) and np.allclose(new[:3, :3], old[:3, :3])
    out = np.array(one(spark, headers.with_origin(affine, dim, [F.lit(10), F.lit(99), F.lit(30)]))).reshape(4, 4)
    assert np.allclose(out @ [31, 31, 31, 1], [0, 0, 0, 1])
    both = np.array(one(spark, headers.product(old, affine))).reshape(4, 4)
    assert np.allclose(both, old @ old)
    assert np.allclose(headers.default_affine((4, 6, 8), (1, 2, 3))[:3, 3], [-2, -6, -12])


def test_plain_slice_affine(spark):
    lit = lambda *v: [F.lit(float(x)) for x in v]
    a = np.array(one(spark, headers.dicom_affine(lit(1, 0, 0), lit(0, 1, 0), lit(-10, -20, 5), lit(2, 2, 3), 4, F.lit(8)))).reshape(4, 4)
    # the first voxel row is the file's last one: 20 mm to the front less 7 rows
    assert np.allclose(a @ [0, 0, 0, 1], [10, 20 - 14, 5, 1]) and np.allclose(a @ [1, 7, 1, 1], [8, 20, 8, 1])


# --- DICOM ---------------------------------------------------------------------------------------------------------------
def element(tag, kind, value, order="<", implicit=False):
    value += b" " * (len(value) % 2)
    head = struct.pack(order + "2H", tag >> 16, tag & 0xFFFF)
    if implicit:
        return head + struct.pack(order + "I", len(value)) + value
    return head + kind + (b"\0\0" + struct.pack(order + "I", len(value)) if kind in dicom.LONG_FORM else struct.pack(order + "H", len(value))) + value


def slice_file(z, instance, syntax=None):
    pixels = (np.arange(6) + 10 * z).reshape(2, 3)
    tags = {0x0020000E: (b"UI", b"1.9"), 0x00200013: (b"IS", str(instance).encode()), 0x00200032: (b"DS", b"0\\0\\%d" % z), 0x00200037: (b"DS", b"1\\0\\0\\0\\1\\0"), 0x00280030: (b"DS", b"2\\2")}
    return dicom.encode(pixels, tags)


def test_slices_stack_by_position(spark):
    files = [(f"/a/{z}", bytearray(slice_file(z, 9 - z))) for z in (3, 0, 2, 1)] + [("/a/bad", bytearray(b"nothing")), ("/a/none", bytearray(b""))]
    rows = dicom.headers(spark.createDataFrame(files, "path string, content binary"))
    assert {r.path: r["class"] for r in rows.collect()} == {"/a/0": "standard", "/a/1": "standard", "/a/2": "standard", "/a/3": "standard", "/a/bad": "guff", "/a/none": "guff"}
    got = dicom.stacked(rows).collect()
    assert len(got) == 1 and (got[0].nx, got[0].ny, got[0].nz) == (3, 2, 4) and got[0].positions == [0, 1, 2, 3]
    assert got[0].data[:6] == [3, 4, 5, 0, 1, 2] and got[0].data[-1] == 32


def test_both_byte_orders_and_sequences():
    body = lambda order, implicit: b"".join(
        element(t, k, v, order, implicit)
        for t, k, v in (
            (0x00080060, b"CS", b"MR"), (0x00280010, b"US", struct.pack(order + "H", 1)), (0x00280011, b"US", struct.pack(order + "H", 2)), (0x00280100, b"US", struct.pack(order + "H", 16)),
            (0x00280101, b"US", struct.pack(order + "H", 12)), (0x00280102, b"US", struct.pack(order + "H", 11)), (0x00280103, b"US", struct.pack(order + "H", 1)), (0x7FE00010, b"OW", struct.pack(order + "2H", 5, 4095)),
        )
    )
    start = lambda s: b"\0" * 128 + b"DICM" + element(0x00020010, b"UI", s.encode() + b"\0")
    for syntax, order, implicit in (("1.2.840.10008.1.2.1", "<", False), (dicom.SYNTAX_IMPLICIT, "<", True), (dicom.SYNTAX_BIG, ">", False)):
        h = dicom.parsed(start(syntax) + body(order, implicit))
        assert h["modality"] == "MR" and dicom.decoded(h).tolist() == [5, -1]
    nested = struct.pack("<2H", 8, 0x1140) + b"SQ\0\0" + struct.pack("<I", dicom.OPEN) + struct.pack("<2HI", 0xFFFE, 0xE000, dicom.OPEN) + element(0x00081150, b"UI", b"1.2") + struct.pack("<2HI", 0xFFFE, 0xE00D, 0) + struct.pack("<2HI", 0xFFFE, 0xE0DD, 0)
    assert dicom.decoded(dicom.parsed(start("1.2.840.10008.1.2.1") + nested + body("<", False))).tolist() == [5, -1]


def test_uneven_slices_and_empty_ends(spark):
    kernel = dicom.evenly_spaced([0.0, 1.0, 3.0])
    assert kernel(np.array([[0.0, 10.0, 30.0]])).tolist() == [[0.0, 10.0, 20.0, 30.0]]
    same = np.ones((1, 3))
    assert dicom.evenly_spaced([0.0, 2.0, 4.0])(same) is same
    df = spark.createDataFrame([([1.0, 0.0, 0.0, 2.0, 0.0, 0.0],), ([0.0] * 6,)], "d array<double>")
    assert [r[0] for r in df.select(dicom.trimmed(F.col("d"), 2, 3)).collect()] == [[1.0, 0, 0, 2.0], [0.0, 0.0]]


def test_files_of_the_highest_folder(spark, tmp_path):
    for name in ("a/1.dcm", "a/b/2.dcm", "c/d/3", "c/e/4.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    got = {r.path.rpartition("/")[2] for r in dicom.files(spark, f"file://{tmp_path}").collect()}
    assert got == {"1.dcm", "3"}


def test_sidecar_json(spark):
    fields = spark.createDataFrame([("s", "tr", "2"), ("s", "tr", "2"), ("s", "z", "1"), ("s", "z", "2"), ("s", "n", None), ("s", "n", "1")], "series string, key string, value string")
    got = json.loads(dicom.sidecar_json(dicom.sidecar(fields, ["series"]), ["series"]).first().json)
    assert got == {"acqpar": {"tr": "2"}, "perSlice": ["n", "z"]}


# --- reslicing -----------------------------------------------------------------------------------------------------------
def test_cubic_splines_pass_through_samples_and_follow_smooth_shapes():
    rng = np.random.default_rng(2)
    v = rng.normal(size=(2, 5, 6, 7))
    z, y, x = (a.ravel() for a in np.meshgrid(range(5), range(6), range(7), indexing="ij"))
    nodes = np.stack([x, y, z], 1).astype(float)
    assert np.allclose(reslicing.spline(v, nodes).reshape(v.shape), v)
    wave = np.cos(np.pi * np.arange(32) / 31 * 2)[None, None, None, :]
    at = np.stack([np.linspace(4, 27, 60), np.zeros(60), np.zeros(60)], 1)
    exact = np.cos(np.pi * at[:, 0] / 31 * 2)
    assert np.abs(reslicing.spline(wave, at)[0] - exact).max() < 1e-4 < np.abs(reslicing.spline(wave, at, 1)[0] - exact).max()
    assert set(reslicing.spline(np.round(v), nodes + 0.3, 0).ravel()) <= set(np.round(v).ravel())


def test_a_turn_by_three_shears_and_back():
    y, x = np.meshgrid(np.arange(33) - 16, np.arange(33) - 16, indexing="ij")
    blob = np.exp(-((x - 4) ** 2 + y**2) / 12.0)
    turned = reslicing.turned(blob, np.pi / 2 * 0.5)
    peak = np.unravel_index(turned.argmax(), turned.shape)
    assert abs(np.hypot(peak[0] - 16, peak[1] - 16) - 4) < 1 and peak[0] != 16
    assert np.abs(reslicing.turned(turned, -np.pi / 4) - blob).max() < 1e-3


def test_integrated_taps_and_jacobian():
    taps = reslicing.integrated_taps(6.0, 2.0)
    x = np.arange(len(taps)) - len(taps) // 2
    s = 3 / np.sqrt(8 * np.log(2))
    assert taps.sum() == pytest.approx(1) and (taps * x * x).sum() == pytest.approx(s * s + 1 / 6, rel=1e-3)
    z, y, xx = np.meshgrid(np.arange(4.0), np.arange(5.0), np.arange(6.0), indexing="ij")
    assert np.allclose(reslicing.jacobian(np.stack([0.5 * xx, 0.1 * y, -0.2 * z])), 1.5 * 1.1 * 0.8)


# --- models --------------------------------------------------------------------------------------------------------------
def test_weighted_fit_and_degrees_of_freedom(spark):
    rng = np.random.default_rng(3)
    x = np.stack([rng.normal(size=40), np.ones(40)], 1)
    y = rng.normal(size=(3, 40))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(y)], "k int, series array<double>")
    plain = glm.ols(rows, x, {"a": (1.0,)}).orderBy("k").collect()
    same = glm.wls(rows, x, np.eye(40), {"a": (1.0,)}).orderBy("k").collect()
    assert np.allclose([r.t_a for r in plain], [r.t_a for r in same])
    v = 0.5 ** np.abs(np.arange(40)[:, None] - np.arange(40)[None, :])
    want = [np.linalg.solve(x.T @ np.linalg.solve(v, x), x.T @ np.linalg.solve(v, u))[0] for u in y]
    assert np.allclose([r.con_a for r in glm.wls(rows, x, v, {"a": (1.0,)}).orderBy("k").collect()], want)
    assert glm.effective_df(x, np.eye(40)) == pytest.approx(38) and glm.effective_df(x, v) < 38


def test_sessions_contrasts_and_informative_samples():
    rng = np.random.default_rng(5)
    a, b = np.ones((3, 1)), rng.normal(size=(2, 2))
    x, names = glm.sessions([(a, ["c"]), (b, ["p", "q"])])
    assert x.shape == (5, 3) and names == ["s1:c", "s2:p", "s2:q"] and not x[3:, 0].any() and not x[:3, 1:].any()
    c = glm.orthogonal_contrasts([[1, 0, 0], [1, 1, 0], [2, 0, 0]], rng.normal(size=(9, 3)))
    assert len(c) == 2
    j = np.concatenate([np.eye(3).repeat(5, 0) * 10, rng.normal(size=(60, 3)) * 0.01])
    keep = glm.informative(j, 0.9)
    assert set(range(15)) <= set(keep.tolist()) and len(keep) < 40


def test_first_level_finds_the_effect_and_repairs_the_design(spark):
    rng = np.random.default_rng(6)
    n = 120
    task = (np.arange(n) // 10 % 2).astype(float)
    drift = np.cos(np.pi * (2 * np.arange(n) + 1) / (2 * n))
    rows = [(k, (100 + (3 * task if k < 5 else 0) + 20 * drift + rng.normal(size=n)).tolist()) for k in range(10)] + [(99, [0.1] * n)]
    df = spark.createDataFrame(rows, "voxel int, series array<double>")
    x = np.stack([task, np.ones(n), 2 * np.ones(n)], 1)
    fit = firstlevel.fit(df, ["voxel"], x, ["task", "constant", "twin"], ["task"], {"on": {"task": 1.0}}, 2.0, 128.0)
    got = {r.voxel: r for r in fit.rows.collect()}
    assert set(got) == set(range(10)) and fit.dropped == ["twin"] and fit.removed == temporal.dct_basis(n, 2.0, 128.0).shape[1]
    assert all(abs(got[k].con_on - 3) < 1 and got[k].p_on < 1e-6 for k in range(5)) and all(abs(got[k].t_on) < 4 for k in range(5, 10))
    with pytest.raises(ValueError):
        firstlevel.fit(df, ["voxel"], x, ["task", "constant", "twin"], ["task"], {"on": {"other": 1.0}}, 2.0, 128.0)


def test_incomplete_beta_for_many_at_once():
    x = np.array([0.0, 0.1, 0.5, 0.9, 1.0])
    assert np.allclose(incomplete_beta(2.0, 3.0, x), 6 * x**2 - 8 * x**3 + 3 * x**4)
    assert np.isnan(t_p(np.array([np.nan, 1.0]), 5))[0] and t_p(np.array([np.inf]), 5)[0] == 0


# --- bookkeeping -----------------------------------------------------------------------------------------------------------
def test_contrast_by_name_or_given(spark):
    columns = spark.createDataFrame([(0, "Sn(1) Task*bf"), (1, "constant")], "col long, name string")
    assert lookup.contrast(columns, [1.0, 0.0], {}) == [1.0, 0.0]
    assert lookup.contrast(columns, [1.0], {"Task": 2.0}) == [2.0, 0.0]
    with pytest.raises(ValueError):
        lookup.contrast(columns, None, {"Rest": 1.0})


def test_motion_needs_the_same_scans(spark):
    m = spark.createDataFrame([(0, 1.0), (1, 2.0)], "t int, tx double")
    assert motion.aligned(m, m.select("t")).count() == 2
    for scans in ([0, 2], [0, 0], [0, 1, 2]):
        with pytest.raises(ValueError):
            motion.aligned(m, spark.createDataFrame([(s,) for s in scans], "t int"))


def test_strict_parity_and_latest(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert {r.k: r.status for r in lookup.parity(a, b, ["k"]).collect()} == {1: "missing", 2: "ok", 3: "extra"}
    with pytest.raises(Exception, match="missing"):
        lookup.parity(a, b, ["k"], strict=True).collect()
    files = spark.createDataFrame([("s", "b", 2), ("s", "a", 2), ("s", "c", 1)], "subject string, path string, modificationTime int")
    assert lookup.latest(files, ["subject"]).first().path == "a"
