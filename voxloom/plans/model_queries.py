"""Queries of statistical models: least squares, contrasts, multiple comparisons, classes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions.scalar import erf_sql, normal_p
from voxloom.operators import firstlevel, glm, relational, segment, temporal
from voxloom.plans.series_queries import BASIS_SQL, CUTOFF, RHO_SQL, TASK_SQL, TR, _onsets
from voxloom.plans.views import BOLD_SQL, IMAGE_SQL, bold, image_voxels, table
from voxloom.session import settled

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


_SLOPE = """g AS (SELECT l_suppkey, count(*) AS n, avg(l_extendedprice) AS my, avg(l_quantity) AS mx, var_pop(l_quantity) AS sxx, var_pop(l_extendedprice) AS syy,
  covar_pop(l_extendedprice, l_quantity) AS sxy FROM lineitem GROUP BY l_suppkey),
s AS (SELECT l_suppkey, n, sxy / sxx AS slope, my - sxy / sxx * mx AS intercept,
  sxy / sxx / sqrt(greatest(n * (syy - sxy / sxx * sxy), 1e-12) / (n - 2) / (n * sxx)) AS t FROM g WHERE n > 2 AND sxx > 0)"""


def _slopes(spark: SparkSession, sf_dir: str, x: str = "l_quantity") -> DataFrame:
    return glm.slope(table(spark, sf_dir, "lineitem"), ["l_suppkey"], F.col("l_extendedprice"), F.col(x)).filter(F.col("t").isNotNull())


@query(f"WITH {_SLOPE} SELECT l_suppkey, n, round(slope, 3) AS slope, round(intercept, 2) AS intercept FROM s")
def ols_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slopes(spark, sf_dir).select("l_suppkey", "n", F.round("slope", 3).alias("slope"), F.round("intercept", 2).alias("intercept"))


@query("""WITH g AS (SELECT l_suppkey, count(*) AS n, avg(l_extendedprice) AS my, avg(l_quantity) AS m1, avg(l_discount) AS m2, var_pop(l_quantity) AS s11, var_pop(l_discount) AS s22,
  covar_pop(l_quantity, l_discount) AS s12, covar_pop(l_quantity, l_extendedprice) AS s1y, covar_pop(l_discount, l_extendedprice) AS s2y FROM lineitem GROUP BY l_suppkey),
b AS (SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM g)
SELECT l_suppkey, n, round(b1, 3) AS b1, round(b2, 1) AS b2, round(my - b1 * m1 - b2 * m2, 2) AS b0 FROM b""")
def ols_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = glm.two_regressors(table(spark, sf_dir, "lineitem"), ["l_suppkey"], F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_discount"))
    return got.select("l_suppkey", "n", F.round("b1", 3).alias("b1"), F.round("b2", 1).alias("b2"), F.round("b0", 2).alias("b0"))


@query(f"WITH {_SLOPE} SELECT l_suppkey, round(t, 4) AS t, t > 3 AS over FROM s")
def t_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slopes(spark, sf_dir).select("l_suppkey", F.round("t", 4).alias("t"), (F.col("t") > 3).alias("over"))


_TAX = _SLOPE.replace("l_quantity", "l_tax")
_P = f"{_TAX}, p AS (SELECT l_suppkey, t, 1 - {erf_sql('(abs(t) / sqrt(2.0))')} AS p FROM s)"


def _p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slopes(spark, sf_dir, "l_tax").select("l_suppkey", "t", normal_p(F.col("t")).alias("p"))


@query(f"WITH {_P} SELECT l_suppkey, round(t, 4) AS t, round(p, 6) AS p FROM p")
def p_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p_values(spark, sf_dir).select("l_suppkey", F.round("t", 4).alias("t"), F.round("p", 6).alias("p"))


@query(f"""WITH {_P}, r AS (SELECT *, row_number() OVER (ORDER BY p, l_suppkey) AS rank, count(*) OVER () AS m FROM p),
c AS (SELECT coalesce(max(p), -1) AS cut FROM r WHERE p <= 0.5 * rank / m) SELECT l_suppkey, round(p, 6) AS p, rank, p <= cut AS significant FROM r CROSS JOIN c""")
def fdr_bh(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = glm.fdr(_p_values(spark, sf_dir), "p", "l_suppkey", q=0.5)
    return got.select("l_suppkey", F.round("p", 6).alias("p"), F.col("rank").cast("long").alias("rank"), "significant")


@query(f"WITH {_P} SELECT l_suppkey, round(least(1.0, p * (SELECT count(*) FROM p)), 6) AS p_fwe FROM p")
def fwe_bonferroni(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glm.bonferroni(_p_values(spark, sf_dir), "p").select("l_suppkey", F.round("p_fwe", 6).alias("p_fwe"))


@query(f"WITH {_SLOPE}, u AS ({'WITH ' + _TAX + ' SELECT * FROM s'}) SELECT s.l_suppkey, round(least(s.t, u.t), 4) AS t FROM s JOIN u USING (l_suppkey)")
def conjunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _slopes(spark, sf_dir).select("l_suppkey", "t"), _slopes(spark, sf_dir, "l_tax").select("l_suppkey", F.col("t").alias("u"))
    return a.join(b, "l_suppkey").select("l_suppkey", F.round(glm.conjunction(a, "t", "u"), 4).alias("t"))


@query(f"WITH {_SLOPE}, u AS ({'WITH ' + _TAX + ' SELECT * FROM s'}) SELECT l_suppkey, round(t, 4) AS t, 'inside' AS mask FROM s WHERE l_suppkey IN (SELECT l_suppkey FROM u WHERE t > 0) UNION ALL SELECT l_suppkey, round(t, 4), 'outside' FROM s WHERE l_suppkey NOT IN (SELECT l_suppkey FROM u WHERE t > 0)")
def contrast_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inclusive and exclusive masking of one contrast by another."""
    a, mask = _slopes(spark, sf_dir).select("l_suppkey", F.round("t", 4).alias("t")), _slopes(spark, sf_dir, "l_tax").filter(F.col("t") > 0).select("l_suppkey")
    inside = a.join(mask, "l_suppkey", "left_semi").withColumn("mask", F.lit("inside"))
    return inside.union(a.join(mask, "l_suppkey", "left_anti").withColumn("mask", F.lit("outside")))


@query("""WITH r AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem),
h AS (SELECT l_returnflag, max(n) * 0.7 + 0.5 AS p FROM r GROUP BY l_returnflag)
SELECT l_returnflag, round(max(v) FILTER (k = floor(p)) + (max(p) - floor(max(p))) * (max(v) FILTER (k = least(floor(p) + 1, n)) - max(v) FILTER (k = floor(p))), 4) AS hazen FROM r JOIN h USING (l_returnflag) GROUP BY l_returnflag""")
def percentile_hazen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.hazen(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", 70).select("l_returnflag", F.round("hazen", 4).alias("hazen"))


_CENTRES = (10.0, 25.0, 40.0)
_NEAREST = "CASE WHEN abs(l_quantity - 10) <= abs(l_quantity - 25) AND abs(l_quantity - 10) <= abs(l_quantity - 40) THEN 0 WHEN abs(l_quantity - 25) <= abs(l_quantity - 40) THEN 1 ELSE 2 END"


@query(f"SELECT CAST({_NEAREST} AS INTEGER) AS k, round(avg(l_quantity), 6) AS centre, count(*) AS n FROM lineitem GROUP BY 1")
def kmeans1d_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.kmeans_step(table(spark, sf_dir, "lineitem"), "l_quantity", list(_CENTRES)).select("k", F.round("centre", 6).alias("centre"), "n")


_CLASSES = ((0.3, 10.0, 8.0), (0.4, 25.0, 8.0), (0.3, 40.0, 8.0))
_DENSITY = ", ".join(f"{w} * greatest(exp(-0.5 * ((l_quantity - {m}) / {s}) ** 2) / ({s} * sqrt(2 * pi())), 1e-300) AS j{k}" for k, (w, m, s) in enumerate(_CLASSES))
_SUMS = ", ".join(f"round(sum(j{k} / j), 3) AS w{k}, round(sum(j{k} / j * v), 2) AS x{k}, round(sum(j{k} / j * (v - {m}) ** 2), 1) AS s{k}" for k, (_, m, _s) in enumerate(_CLASSES))


@query(f"WITH d AS (SELECT l_quantity AS v, {_DENSITY} FROM lineitem), t AS (SELECT *, j0 + j1 + j2 AS j FROM d) SELECT round(sum(ln(j)), 2) AS loglik, count(*) AS n, {_SUMS} FROM t")
def em_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = segment.em_sums(table(spark, sf_dir, "lineitem"), "l_quantity", list(_CLASSES))
    digits = {"loglik": 2, "w": 3, "x": 2, "s": 1}
    return got.select(*[F.round(c, digits["loglik" if c == "loglik" else c[0]]).alias(c) if c != "n" else F.col("n") for c in got.columns])


@query(f"""WITH {IMAGE_SQL}, l AS (SELECT t, z, y, x, CAST(v > 0 AS INTEGER) AS label, CASE WHEN v > 0 THEN 0.7 ELSE 0.3 END AS w1 FROM vox),
d(dx, dy, dz) AS (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)),
v AS (SELECT o.t, o.z, o.y, o.x, any_value(o.w1) AS w1, sum(coalesce(n.label, o.label)) AS v1 FROM l o CROSS JOIN d LEFT JOIN l n ON n.t = o.t AND n.z = o.z + d.dz AND n.y = o.y + d.dy AND n.x = o.x + d.dx GROUP BY o.t, o.z, o.y, o.x)
SELECT t, z, y, x, round(w1 * exp(0.1 * v1) / (w1 * exp(0.1 * v1) + (1 - w1) * exp(0.1 * (6 - v1))), 5) AS w1 FROM v""")
def mrf_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = image_voxels(spark, sf_dir).select("t", "z", "y", "x", (F.col("v") > 0).cast("int").alias("label"), F.when(F.col("v") > 0, 0.7).otherwise(0.3).alias("w1"))
    got = segment.neighbour_votes(rows.withColumn("w0", 1 - F.col("w1")), ["t"], "label", 0.1, ["w0", "w1"])
    return got.select("t", "z", "y", "x", F.round("w1", 5).alias("w1"))


_NEAR = "CASE WHEN abs(v - c0) <= abs(v - c1) AND abs(v - c0) <= abs(v - c2) THEN 0 WHEN abs(v - c1) <= abs(v - c2) THEN 1 ELSE 2 END"
_STATE = ", ".join(f"w{k}, m{k}, s{k}" for k in range(3))
_SETTLED = "abs(ll - last) <= 1e-4 * abs(ll)"


def _each(of) -> str:
    return ", ".join(of(k) for k in range(3))


@query(f"""WITH RECURSIVE hist AS MATERIALIZED (SELECT l_quantity AS v, count(*) AS n FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY l_quantity),
km AS (SELECT 0 AS i, min(v) AS c0, (min(v) + max(v)) / 2 AS c1, max(v) AS c2, false AS done FROM hist
  UNION ALL SELECT i + 1, n0, n1, n2, n0 = c0 AND n1 = c1 AND n2 = c2 FROM (SELECT i, c0, c1, c2, {_each(lambda k: f"coalesce(sum(v * n) FILTER (k = {k}) / sum(n) FILTER (k = {k}), c{k}) AS n{k}")}
    FROM (SELECT km.*, v, n, {_NEAR} AS k FROM km CROSS JOIN hist WHERE NOT done AND i < 100) GROUP BY i, c0, c1, c2)),
c AS (SELECT c0, c1, c2 FROM km ORDER BY i DESC LIMIT 1), st AS (SELECT {_NEAR} AS k, v, n FROM c CROSS JOIN hist),
sk AS (SELECT k, sum(n) AS n, sqrt((sum(n * v * v) - sum(n * v) ** 2 / sum(n)) / (sum(n) - 1)) + 1e-3 AS sd FROM st GROUP BY k),
em AS (SELECT 0 AS i, CAST('-inf' AS DOUBLE) AS last, false AS done, {_each(lambda k: f"(SELECT n FROM sk WHERE k = {k}) / (SELECT sum(n) FROM hist) AS w{k}, c{k} AS m{k}, (SELECT sd FROM sk WHERE k = {k}) AS s{k}")} FROM c
  UNION ALL SELECT i + 1, ll, {_SETTLED}, {_each(lambda k: f"CASE WHEN {_SETTLED} THEN w{k} ELSE a{k} / total END, CASE WHEN {_SETTLED} THEN m{k} ELSE x{k} / a{k} END, CASE WHEN {_SETTLED} THEN s{k} ELSE sqrt(greatest(q{k} / a{k}, 0)) + 1e-3 END")}
  FROM (SELECT i, last, {_STATE}, sum(n) AS total, sum(n * ln(j)) AS ll, {_each(lambda k: f"sum(n * j{k} / j) AS a{k}, sum(n * j{k} / j * v) AS x{k}, sum(n * j{k} / j * (v - m{k}) ** 2) AS q{k}")}
    FROM (SELECT *, j0 + j1 + j2 AS j FROM (SELECT em.*, v, n, {_each(lambda k: f"w{k} * greatest(exp(-0.5 * ((v - m{k}) / s{k}) ** 2) / (s{k} * sqrt(2 * pi())), 1e-300) AS j{k}")} FROM em CROSS JOIN hist WHERE NOT done AND i < 100)) GROUP BY i, last, {_STATE})),
f AS (SELECT * FROM em ORDER BY i DESC LIMIT 1), u AS ({" UNION ALL ".join(f"SELECT w{k} AS share, m{k} AS mean, s{k} AS sd FROM f" for k in range(3))})
SELECT CAST(row_number() OVER (ORDER BY mean) - 1 AS INTEGER) AS k, round(share, 5) AS share, round(mean, 4) AS mean, round(sd, 4) AS sd FROM u""")
def mixture_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three classes of all line item quantities by k-means and EM."""
    rows = table(spark, sf_dir, "lineitem").filter(F.col("l_quantity").isNotNull()).select("l_quantity")
    found = segment.mixture(rows, "l_quantity", 3)
    got = spark.createDataFrame([(k, *map(float, c)) for k, c in enumerate(found)], "k int, share double, mean double, sd double")
    return got.select("k", F.round("share", 5).alias("share"), F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"))


_FIRST = f"""{BOLD_SQL}, {BASIS_SQL}, m AS (SELECT voxel, avg(y) AS mean FROM bold GROUP BY voxel), keep AS (SELECT voxel FROM m WHERE mean > 0.5 * (SELECT avg(mean) FROM m WHERE mean > 0)),
o AS (SELECT floor(epoch(ts) / 60) / 60 - (SELECT floor(min(epoch(ts)) / 3600) FROM events) AS s FROM events WHERE {TASK_SQL}),
box AS MATERIALIZED (SELECT scan, count(*) AS hits FROM (SELECT unnest(range(CAST(ceil(s) AS BIGINT), CAST(ceil(s + 1.5) AS BIGINT))) AS scan FROM o) GROUP BY scan),
d AS MATERIALIZED (SELECT scans.scan, CAST(coalesce(hits, 0) AS DOUBLE) AS task FROM scans LEFT JOIN box ON box.scan = scans.scan),
dc AS (SELECT k, sum(task * b) AS c FROM d JOIN b ON b.scan = d.scan GROUP BY k), df AS (SELECT b.scan, sum(c * b) AS f FROM b JOIN dc ON dc.k = b.k GROUP BY b.scan),
yc AS MATERIALIZED (SELECT voxel, k, sum(y * b) AS c FROM bold JOIN keep USING (voxel) JOIN b USING (scan) GROUP BY voxel, k), yf AS (SELECT yc.voxel, b.scan, sum(yc.c * b.b) AS f FROM yc JOIN b USING (k) GROUP BY yc.voxel, b.scan),
y AS MATERIALIZED (SELECT voxel, scan, y - f AS y, lag(y - f) OVER (PARTITION BY voxel ORDER BY scan) AS p FROM bold JOIN yf USING (voxel, scan)),
r AS MATERIALIZED (SELECT greatest(-0.5, least(0.95, median(rho))) AS rho FROM (SELECT sum(y * p) / (sum(p * p) + 2.220446049250313e-16) AS rho FROM y WHERE p IS NOT NULL GROUP BY voxel)),
x AS (SELECT d.scan, task - f AS task, lag(task - f) OVER (ORDER BY d.scan) AS p FROM d JOIN df ON df.scan = d.scan),
wx AS MATERIALIZED (SELECT scan, CASE WHEN p IS NULL THEN task * sqrt(1 - rho * rho) ELSE task - rho * p END AS a, CASE WHEN p IS NULL THEN sqrt(1 - rho * rho) ELSE 1 - rho END AS o FROM x CROSS JOIN r),
wy AS (SELECT voxel, scan, CASE WHEN p IS NULL THEN y * sqrt(1 - rho * rho) ELSE y - rho * p END AS y FROM y CROSS JOIN r),
s AS (SELECT voxel, sum(a * a) AS aa, sum(a * o) AS ao, sum(o * o) AS oo, sum(a * y) AS ay, sum(o * y) AS oy, sum(y * y) AS yy, count(*) - 2 - (SELECT count(DISTINCT k) FROM b) AS df FROM wy JOIN wx USING (scan) GROUP BY voxel),
e AS (SELECT *, (oo * ay - ao * oy) / (aa * oo - ao * ao) AS con, (aa * oy - ao * ay) / (aa * oo - ao * ao) AS c0, oo / (aa * oo - ao * ao) AS v FROM s),
t AS (SELECT voxel, df, con, con / sqrt(greatest(greatest((yy - con * ay - c0 * oy) / df, 1e-12) * v, 1e-12)) AS t FROM e),
q AS (SELECT unnest(range(0, 401)) AS i), g AS (SELECT t.voxel, sum(CASE WHEN i IN (0, 400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * power(cos(atan(abs(t) / sqrt(df)) * i / 400.0), df - 1)) * atan(any_value(abs(t)) / sqrt(any_value(df))) / 1200.0 AS a FROM t CROSS JOIN q GROUP BY t.voxel)"""


@query(f"""WITH {_FIRST} SELECT t.voxel, round(con, 4) + 0 AS con_task, round(t, 4) + 0 AS t_task, round(1 - 2 * g.a * exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(pi()), 5) + 0 AS p_task FROM t JOIN g ON g.voxel = t.voxel""")
def first_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mask, filter, whiten, fit and test: every voxel's hourly series on the response to one event type."""
    rows, n = bold(spark, sf_dir)
    rows = settled(rows)  # read twice: for the mask, and to be filtered
    events, _ = _onsets(spark, sf_dir)
    hits = {r["scan"]: r["hits"] for r in glm.boxcar(spark.range(n).withColumnRenamed("id", "scan"), events).collect()}  # a value per scan
    x = np.stack([np.array([hits.get(k, 0) for k in range(n)], float), np.ones(n)], 1)
    got = firstlevel.fit(rows, ["voxel"], x, ["task", "constant"], ["task"], {"task": {"task": 1.0}}, TR, CUTOFF).rows
    digits = {"con_task": 4, "t_task": 4, "p_task": 5}
    return got.select("voxel", *[(F.round(c, d) + 0).alias(c) for c, d in digits.items()])


@query(f"""WITH {BOLD_SQL}, o AS (SELECT floor(epoch(ts) / 60) / 60 - (SELECT floor(min(epoch(ts)) / 3600) FROM events) AS s FROM events WHERE {TASK_SQL}),
box AS MATERIALIZED (SELECT scan, count(*) AS hits FROM (SELECT unnest(range(CAST(ceil(s) AS BIGINT), CAST(ceil(s + 1.5) AS BIGINT))) AS scan FROM o) GROUP BY scan),
d AS MATERIALIZED (SELECT scans.scan, CAST(coalesce(hits, 0) AS DOUBLE) AS task FROM scans LEFT JOIN box ON box.scan = scans.scan),
s AS (SELECT voxel, count(*) AS n, var_pop(task) AS sxx, var_pop(y) AS syy, covar_pop(task, y) AS sxy FROM bold JOIN d USING (scan) GROUP BY voxel)
SELECT voxel, round(sxy * sxy / sxx / greatest((syy - sxy * sxy / sxx) * n / (n - 2), 1e-12) * n, 4) + 0 AS f FROM s""")
def f_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F of one regressor over a constant."""
    rows, n = bold(spark, sf_dir)
    events, _ = _onsets(spark, sf_dir)
    hits = {r["scan"]: r["hits"] for r in glm.boxcar(spark.range(n).withColumnRenamed("id", "scan"), events).collect()}  # a value per scan
    x = np.stack([np.array([hits.get(k, 0) for k in range(n)], float), np.ones(n)], 1)
    return glm.f_statistic(rows, x, np.array([[1.0, 0.0]])).select("voxel", (F.round("f", 4) + 0).alias("f"))


@query(f"""WITH {_SLOPE}, a AS (SELECT l_suppkey, t, atan(abs(t) / sqrt(6.0)) AS h, atan(abs(t) / sqrt(5.0)) AS o FROM s)
SELECT l_suppkey, round(1 - sin(h) * (1 + cos(h) ** 2 / 2 + 3 * cos(h) ** 4 / 8), 8) + 0 AS p6, round(1 - 2 / pi() * (o + sin(o) * (cos(o) + 2 * cos(o) ** 3 / 3)), 8) + 0 AS p5 FROM a""")
def t_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact tails of t with an even and an odd number of degrees of freedom, where sums of cosines give them, too."""
    import pandas as pd

    from voxloom.functions.scalar import t_p

    def tail(df: int):
        return F.pandas_udf(lambda t: pd.Series(t_p(t.to_numpy(float), df)), "double")

    return _slopes(spark, sf_dir).select("l_suppkey", (F.round(tail(6)("t"), 8) + 0).alias("p6"), (F.round(tail(5)("t"), 8) + 0).alias("p5"))


@query(f"""WITH {BOLD_SQL}, {RHO_SQL}, g AS MATERIALIZED (SELECT greatest(-0.5, least(0.95, median(rho))) AS rho FROM r),
l AS (SELECT voxel, scan, y, lag(y) OVER (PARTITION BY voxel ORDER BY scan) AS p FROM bold),
w AS (SELECT voxel, CASE WHEN p IS NULL THEN y * sqrt(1 - rho * rho) ELSE y - rho * p END AS y, CASE WHEN p IS NULL THEN sqrt(1 - rho * rho) ELSE 1 - rho END AS o FROM l CROSS JOIN g)
SELECT voxel, round(sum(o * y) / sum(o * o), 4) + 0 AS mean FROM w GROUP BY voxel""")
def weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted least squares of a constant under first-order autocorrelation that all voxels share."""
    rows, n = bold(spark, sf_dir)
    rows = settled(rows)
    rho = temporal.global_rho(rows)
    k = np.arange(n)
    v = rho ** np.abs(k[:, None] - k[None, :]) / (1 - rho * rho)
    got = glm.wls(rows, np.ones((n, 1)), v, {"mean": (1.0,)})
    return got.select("voxel", (F.round("con_mean", 4) + 0).alias("mean"))


@query("""WITH l AS (SELECT l_suppkey, round(avg(l_quantity), 4) AS mean, count(*) AS n FROM lineitem GROUP BY l_suppkey) SELECT l_suppkey, mean, n FROM l""")
def stored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as a table that is written and read again."""
    got = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg("l_quantity"), 4).alias("mean"), F.count("*").alias("n"))
    return settled(got)
