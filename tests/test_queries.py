"""Every registered query of the volumetric engine on the smallest tables, against its SQL."""

import importlib
import sys

import duckdb
import numpy as np
import pytest

import __spark_entry__
from voxloom.operators import glm, registration, segment
from voxloom.plans import image_queries, model_queries, registry, series_queries
from voxloom.plans.views import image

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, db, name):
    got = registry.queries()[name](spark, SF).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = db.execute(sql).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    sort = lambda d: d[columns].sort_values(columns).reset_index(drop=True).astype(str)
    assert sort(got).equals(sort(want))


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["voxel", "con_task", "t_task", "p_task"] and df.count() > 0


def test_entry_without_the_optional_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "voxloom.llm", None)
    left = importlib.reload(__spark_entry__)
    assert set(left.queries()) == set(registry.queries()) and set(left.oracle_sql()) <= set(left.queries())
    monkeypatch.undo()
    importlib.reload(__spark_entry__)


def test_registration_queries_run_the_whole_operators(spark):
    volumes = {r["t"]: np.array(r["data"]).reshape(4, 4, 4) for r in image(spark, SF).collect()}
    fixed = image_queries._reference()
    p = {r["t"]: r["p"] for r in image_queries.coreg_mi(spark, SF).collect()}
    shift = {r["t"]: r["mean_shift"] for r in image_queries.svf_warp(spark, SF).collect()}
    assert set(p) == set(shift) == set(volumes)
    for t in sorted(volumes)[:20]:
        assert np.allclose(p[t], registration.coregister(volumes[t], fixed), atol=1e-5)
        assert abs(shift[t] - np.abs(registration.warp(volumes[t], fixed)).mean()) < 1e-5


def test_mixture_query_leaves_the_iterations_to_the_operator(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(segment, "mixture", lambda *args, **options: asked.append((args[1:], options)) or [(1.0, 0.0, 1.0)])
    assert model_queries.mixture_classes(spark, SF).count() == 1 and asked == [(("l_quantity", 3), {})]


def test_design_follows_the_events(spark):
    x = series_queries.design_matrix(spark, SF).toPandas().pivot(index="scan", columns="name", values="value")
    events, n = series_queries._onsets(spark, SF)
    onsets = [r["onset"] for r in events.collect()]
    assert len(x) == n and np.allclose(x["Task"], glm.task_regressor(onsets, [1.5] * len(onsets), n, 2.0), atol=1e-5) and x["Task"].std() > 0


def test_warp_goes_from_coarse_to_fine():
    z, y, x = np.meshgrid(*[np.arange(16.0)] * 3, indexing="ij")
    at = lambda cx: np.exp(-((x - cx) ** 2 + (y - 7.5) ** 2 + (z - 7.5) ** 2) / 8)
    fixed, moving = at(5.0), at(10.0)
    left = lambda u: ((registration.pull(moving[None], u)[0] - fixed) ** 2).mean()
    assert left(registration.warp(moving, fixed)) < left(registration.warp(moving, fixed, coarse=()))
    even = np.ones((1, 16, 16, 16))
    assert np.allclose(registration.refined(registration.pooled(even, 4), 4, (16, 16, 16)), even)
