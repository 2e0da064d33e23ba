"""Work on many volumes at once, and over larger tables."""

import numpy as np

from voxloom.operators import registration


def _volumes(n=70, size=4, seed=5):
    return np.random.default_rng(seed).normal(size=(n, size, size, size))


def test_many_volumes_are_coregistered_together_as_each_alone():
    v = _volumes()
    got = registration.coregister(v, v[0])
    assert got.shape == (70, 6) and got[1:].any()
    assert np.array_equal(got[:9], [registration.coregister(one, v[0]) for one in v[:9]])
    for p, one in zip(got[:9], v, strict=False):  # information is that of plain histograms
        moved = registration.moved_points(p, registration.grid((4, 4, 4)), np.full(3, 1.5))
        inside = ((moved >= 0) & (moved <= 3)).all(1)
        there = registration.trilinear(one[None], moved)
        want = registration.mutual_information(v[0].ravel()[inside], there[0, inside])
        assert abs(registration.informations(v[:1].reshape(1, -1), there, inside[None])[0] - want) < 1e-12


def test_many_volumes_are_warped_together_as_each_alone():
    v = _volumes(6, 8)
    got = registration.warp(v, v[0])
    assert got.shape == (6, 3, 8, 8, 8) and np.abs(got[1:]).max() > 0.01
    assert np.allclose(got, [registration.warp(one, v[0]) for one in v], atol=1e-12)


def test_fields_are_pulled_with_one_list_of_places_for_all_axes():
    from time import process_time

    rng = np.random.default_rng(3)
    v, u = rng.normal(size=(64, 3, 4, 4, 4)), rng.normal(size=(64, 3, 4, 4, 4))
    points = np.clip(registration.grid((4, 4, 4)) + u.reshape(64, 3, -1).transpose(0, 2, 1), 0, 3)

    def shortest(f):
        spent = []
        for _ in range(15):
            began = process_time()
            f()
            spent.append(process_time() - began)
        return min(spent)

    assert np.allclose(registration.pull(v, u).reshape(64, 3, -1), registration.trilinear_each(v, points), atol=1e-12)
    assert shortest(lambda: registration.pull(v, u)) < 0.7 * shortest(lambda: registration.trilinear_each(v, points))
    flat = rng.normal(size=(2, 3, 1, 5, 6))  # one slice, and a volume that isn't finite leaves the others alone
    at = np.clip(registration.grid((6, 5, 1)) + flat.reshape(2, 3, -1).transpose(0, 2, 1), 0, [5, 4, 0])
    assert np.allclose(registration.pull(flat, flat).reshape(2, 3, -1), registration.trilinear_each(flat, at), atol=1e-12)
    broken = v[:, 0].copy()
    broken[1, 2, 2, 2] = np.nan
    with np.errstate(invalid="ignore"):
        got = registration.warp(broken[:3], v[5, 0])
    assert np.isnan(got[1]).all() and np.allclose(got[[0, 2]], registration.warp(v[[0, 2], 0], v[5, 0]), atol=1e-12)


def test_spline_motion_isnt_bent_by_the_edge():
    from voxloom.operators import spatial
    from voxloom.plans.volume_queries import OFFSETS

    smooth = spatial.smooth((16, 16, 16), 5.0, (1.0, 1.0, 1.0))
    worst = 0.0
    for seed in range(40):
        v = smooth(np.random.default_rng(seed).normal(size=(1, 4096))).reshape(16, 16, 16)
        cuts = [v[z : z + 12, y : y + 12, x : x + 12] / v.std() for x, y, z in OFFSETS]
        known = registration.samples(cuts[0], 1, 0.9, 0)
        for cut, offset in zip(cuts[1:], OFFSETS[1:], strict=True):
            m = registration.composed(registration.splines.coefficients(cut), *known, np.eye(4), 64)
            worst = max(worst, np.abs(m[:3] @ [5.5, 5.5, 5.5, 1] - 5.5 + offset).max())
    assert worst < 0.015  # 0.05 is rounded to another tenth


def test_coregistration_isnt_paid_for_moving_its_bins():
    from voxloom.operators import spatial
    from voxloom.plans.volume_queries import OFFSETS

    smooth = spatial.smooth((16, 16, 16), 5.0, (1.0, 1.0, 1.0))
    for seed, t in ((55, 1), (47, 0), (5, 3)):
        v = smooth(np.random.default_rng(seed).normal(size=(1, 4096))).reshape(16, 16, 16)
        fixed, moving = (v[z : z + 12, y : y + 12, x : x + 12] / v.std() for x, y, z in OFFSETS[[0, t]])
        p = registration.coregister_levels(np.exp(-0.5 * moving), fixed, sep=(2.0, 1.0), bins=32)
        assert np.abs(p[:3] + OFFSETS[t]).max() < 0.15  # half a voxel is rounded to another one


def test_pairs_are_coregistered_together_as_each_alone():
    from time import process_time

    from voxloom.operators import spatial
    from voxloom.plans.volume_queries import OFFSETS

    def shortest(f, times):
        spent = []
        for _ in range(times):
            began = process_time()
            f()
            spent.append(process_time() - began)
        return min(spent)

    smooth = spatial.smooth((16, 16, 16), 5.0, (1.0, 1.0, 1.0))
    v = smooth(np.random.default_rng(2).normal(size=(8, 4096))).reshape(-1, 16, 16, 16)
    cuts = np.stack([v[:, z : z + 12, y : y + 12, x : x + 12] for x, y, z in OFFSETS], 1) / v.std()
    moving, fixed = np.exp(-0.5 * cuts).reshape(-1, 12, 12, 12), np.repeat(cuts[:, 0], 4, axis=0)
    found = []
    spent = shortest(lambda: found.append(registration.coregister_levels(moving, fixed, sep=(2.0, 1.0), bins=32)), 1)
    assert np.abs(found[0][:, :3] + np.tile(OFFSETS, (8, 1))).max() < 0.15
    alone = [registration.coregister_levels(a, b, sep=(2.0, 1.0), bins=32) for a, b in zip(moving[1:4], fixed[1:4], strict=True)]
    assert np.allclose(found[0][1:4], alone, atol=1e-9)
    points = registration.grid((12, 12, 12)) * 0.9 + 0.3  # one after another, a fit took as long as 1,700 of these
    assert spent / 32 < 500 * shortest(lambda: registration.trilinear(moving[:1], points), 25)
    assert registration.coregister_levels(moving[:0], fixed[:0]).shape == (0, 6)


def test_a_dark_corner_doesnt_press_all_values_into_a_few_bins():
    from voxloom.operators import spatial
    from voxloom.plans.volume_queries import OFFSETS

    smooth = spatial.smooth((16, 16, 16), 5.0, (1.0, 1.0, 1.0))
    v = smooth(np.random.default_rng(1010).normal(size=(40, 4096))).reshape(-1, 16, 16, 16)[16]  # its corner is at -10 deviations
    cuts = np.stack([v[z : z + 12, y : y + 12, x : x + 12] for x, y, z in OFFSETS]) / v.std()
    got = registration.coregister_levels(np.exp(-0.5 * cuts), np.repeat(cuts[:1], 4, axis=0), sep=(2.0, 1.0), bins=32)
    assert np.abs(got[:, :3] + OFFSETS).max() < 0.15  # a whole voxel off with bins over the range
    placed = registration.in_bins(np.array([[[[5.0, 1.0, 1.0, 9.0, 1.0]]], [[[2.0] * 5]]]), 9)
    assert np.array_equal(placed.reshape(2, 5), [[6, 2, 2, 8, 2], [4] * 5])


def test_the_information_of_many_pairs_is_that_of_plain_histograms():
    rng, size = np.random.default_rng(4), np.array([1.0, 2.0, 1.5])
    moving, fixed = registration.in_bins(rng.normal(size=(3, 4, 5, 6)), 8), registration.in_bins(rng.normal(size=(3, 5, 4, 6)), 8)
    end = np.array([5, 3, 4]) * size
    points = np.concatenate([rng.uniform(0, end, (60, 3)), [0 * end, end]])
    which, p = np.array([0, 1, 2, 1, 0]), rng.normal(size=(5, 6)) * [0.7, 0.7, 0.7, 0.1, 0.1, 0.1]
    p[0], p[4, 0] = 0, 50
    got = registration.likeness(moving, fixed, points, size, 8, together=150)(which, p)
    spread = np.exp(-0.5 * np.subtract.outer(np.arange(8), np.arange(8)) ** 2.0)
    spread /= spread.sum(0)
    for k, q, g in zip(which, p, got, strict=True):
        at = registration.moved_points(q, points, end / 2) / size
        inside = ((at >= 0) & (at <= [5, 4, 3])).all(1)
        h = np.zeros((8, 8))
        for a, b in zip(registration.trilinear(fixed[k][None], points / size)[0, inside], registration.trilinear(moving[k][None], at)[0, inside], strict=True):
            h += np.outer(np.maximum(0, 1 - np.abs(np.arange(8) - a)), np.maximum(0, 1 - np.abs(np.arange(8) - b)))
        h = spread @ h @ spread.T / max(1, inside.sum())
        entropy = lambda q: -(q[q > 0] * np.log(q[q > 0])).sum()
        want = (entropy(h.sum(0)) + entropy(h.sum(1))) / entropy(h) if inside.sum() >= 15 else -np.inf
        assert g == want or abs(g - want) < 1e-12


def test_sets_are_made_before_they_meet(spark):
    from voxloom.plans import table_queries

    plan = table_queries.set_operations(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_clusters_meet_without_the_driver(spark):
    from voxloom.operators import relational

    rows = spark.range(64).selectExpr("id % 2 t", "cast(id div 16 as int) z", "cast(id div 4 % 4 as int) y", "cast(id % 4 as int) x")
    found = relational.extent(relational.clusters(rows, ["t"]), ["t"], 4)
    assert found.count() == 64 and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_no_round_of_clusters_passes_through_the_driver(spark, monkeypatch):
    from voxloom.operators import relational
    from voxloom.plans import mask_queries

    plans, settled = [], relational.settled

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return settled(df)

    monkeypatch.setattr(relational, "settled", noted)
    found = mask_queries.thresholded_points(spark, "/root/testdata/sf0.001")
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert found.count() and len(plans) >= 4 and not any("Broadcast" in p for p in plans)


def test_long_rows_go_to_a_kernel_in_parts(spark):
    from voxloom.operators import layout

    def kernel(flat):
        assert flat.size <= 1 << 17
        return flat[:, :3] + 1

    rows = spark.range(0, 500, 1, 1).selectExpr("id", "transform(sequence(1, 1000), k -> cast(id * k as double)) a")
    got = {r["id"]: r["a"] for r in layout.map_arrays(rows, "a", kernel).collect()}
    assert got == {k: [k + 1.0, 2 * k + 1.0, 3 * k + 1.0] for k in range(500)}
    assert layout.map_arrays(rows.limit(0), "a", kernel).count() == 0
