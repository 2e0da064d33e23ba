"""Queries over the image view: layouts, geometry, spatial kernels, masks, registration."""

from __future__ import annotations


import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.operators import layout, registration, relational, spatial
from voxloom.plans.views import IMAGE_SQL, SHAPE, image, image_voxels

QUERIES, SQL = {}, {}
AT = ["t", "z", "y", "x"]
AFFINE = np.array([[3.0, 0, 0, -4.5], [0, 3.0, 0, -4.5], [0, 0, 4.0, -6.0], [0, 0, 0, 1]])
FWHM, VOXEL = 6.0, (3.0, 3.0, 4.0)
#: Target coordinates of the resampled grid, in source voxels: half a voxel on along x, a quarter along y.
SHIFT = (0.5, 0.25, 0.0)


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def kernel_voxels(spark: SparkSession, sf_dir: str, kernel, shape=SHAPE, to: str = "v", digits: int = 5) -> DataFrame:
    rows = layout.map_arrays(image(spark, sf_dir), "data", kernel)
    return layout.voxels(rows, shape, value=to).select(*AT, F.round(to, digits).alias(to))


@query(f"WITH {IMAGE_SQL} SELECT t, z, y, x, v FROM vox")
def demosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image_voxels(spark, sf_dir).select(*AT, "v")


@query(f"WITH {IMAGE_SQL} SELECT t - 6 AS t, z, y, x, v FROM vox WHERE t >= 6")
def remove_dummy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.drop_scans(image_voxels(spark, sf_dir), 6).select(*AT, "v")


@query(f"WITH {IMAGE_SQL} SELECT t, z, y, x, 3.0 * x - 4.5 AS wx, 3.0 * y - 4.5 AS wy, 4.0 * z - 6.0 AS wz FROM vox WHERE v > 0.1")
def affine_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = image_voxels(spark, sf_dir).filter(F.col("v") > 0.1)
    world = [sum((F.col(c) * float(AFFINE[k, j]) for j, c in enumerate("xyz")), F.lit(float(AFFINE[k, 3]))).alias(f"w{'xyz'[k]}") for k in range(3)]
    return rows.select(*AT, *world)


@query(f"WITH {IMAGE_SQL} SELECT z, y, x, round(avg(v), 6) AS mean, count(v) AS n FROM vox GROUP BY z, y, x")
def mean_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image_voxels(spark, sf_dir).groupBy("z", "y", "x").agg(F.round(F.avg("v"), 6).alias("mean"), F.count("v").alias("n"))


def _means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image_voxels(spark, sf_dir).groupBy("z", "y", "x").agg(F.avg("v").alias("mean"))


@query(f"WITH {IMAGE_SQL}, m AS (SELECT z, y, x, avg(v) AS mean FROM vox GROUP BY z, y, x) SELECT z, y, x, round(mean, 6) AS mean FROM m WHERE mean > (SELECT quantile_cont(mean, 0.3) FROM m)")
def mask_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.percentile_mask(_means(spark, sf_dir), 30).select("z", "y", "x", F.round("mean", 6).alias("mean"))


@query(f"WITH {IMAGE_SQL}, m AS (SELECT z, y, x, avg(v) AS mean FROM vox GROUP BY z, y, x) SELECT z, y, x, round(mean, 6) AS mean FROM m WHERE mean > 0.5 * (SELECT avg(mean) FROM m WHERE mean > 0)")
def mask_global_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.global_mask(_means(spark, sf_dir), 0.5).select("z", "y", "x", F.round("mean", 6).alias("mean"))


def _taps_sql(axis: int) -> str:
    taps = spatial.gaussian_taps(FWHM, VOXEL[axis])
    r = len(taps) // 2
    return ", ".join(f"({k - r}, {w!r})" for k, w in enumerate(taps.tolist()))


def _smooth_sql(name: str, source: str, axis: int) -> str:
    a = "xyz"[axis]
    rest = [c for c in AT if c != a]
    return f"""k{a}(k, w) AS (VALUES {_taps_sql(axis)}),
{name} AS (SELECT {', '.join('o.' + c for c in AT)}, sum(k.w * s.v) AS v FROM {source} o CROSS JOIN k{a} k
  JOIN {source} s ON {' AND '.join(f's.{c} = o.{c}' for c in rest)} AND s.{a} = least(greatest(o.{a} + k.k, 0), 3) GROUP BY {', '.join('o.' + c for c in AT)})"""


@query(f"WITH {IMAGE_SQL}, {_smooth_sql('sx', 'vox', 0)} SELECT t, z, y, x, round(v, 5) + 0 AS v FROM sx")
def gauss_smooth_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernel_voxels(spark, sf_dir, spatial.smooth(SHAPE, FWHM, VOXEL, "x"))


@query(f"WITH {IMAGE_SQL}, {_smooth_sql('sx', 'vox', 0)}, {_smooth_sql('sy', 'sx', 1)}, {_smooth_sql('sz', 'sy', 2)} SELECT t, z, y, x, round(v, 5) + 0 AS v FROM sz")
def gauss_smooth_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernel_voxels(spark, sf_dir, spatial.smooth(SHAPE, FWHM, VOXEL))


_CORNERS = ", ".join(f"({dx}, {dy}, {(SHIFT[0] if dx else 1 - SHIFT[0]) * (SHIFT[1] if dy else 1 - SHIFT[1])})" for dx in (0, 1) for dy in (0, 1))


@query(f"""WITH {IMAGE_SQL}, c(dx, dy, w) AS (VALUES {_CORNERS})
SELECT o.t, o.z, o.y, o.x, round(CASE WHEN o.x + {SHIFT[0]} > 3 OR o.y + {SHIFT[1]} > 3 THEN 0 ELSE sum(c.w * s.v) END, 5) + 0 AS v
FROM vox o CROSS JOIN c LEFT JOIN vox s ON s.t = o.t AND s.z = o.z AND s.x = o.x + c.dx AND s.y = o.y + c.dy GROUP BY o.t, o.z, o.y, o.x""")
def trilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernel_voxels(spark, sf_dir, spatial.sample_at(SHAPE, spatial.grid(SHAPE) + np.array(SHIFT)))


@query(f"""WITH {IMAGE_SQL}, g AS (SELECT unnest(range(0, 7)) AS i), w AS (SELECT i, i // 2 AS lo, (i % 2) * 0.5 AS f FROM g)
SELECT b.t, b.z, CAST(wy.i AS INTEGER) AS y, CAST(wx.i AS INTEGER) AS x,
  round(sum(b.v * CASE WHEN b.x = wx.lo THEN 1 - wx.f ELSE wx.f END * CASE WHEN b.y = wy.lo THEN 1 - wy.f ELSE wy.f END), 5) + 0 AS v
FROM vox b JOIN w wx ON b.x = wx.lo OR (b.x = wx.lo + 1 AND wx.f > 0) JOIN w wy ON b.y = wy.lo OR (b.y = wy.lo + 1 AND wy.f > 0)
GROUP BY b.t, b.z, wy.i, wx.i""")
def resample_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Onto a grid of half the spacing along x and y, with the same corner."""
    fine = AFFINE @ np.diag([0.5, 0.5, 1, 1])
    return kernel_voxels(spark, sf_dir, spatial.resample(SHAPE, AFFINE, (7, 7, 4), fine), (7, 7, 4))


@query(f"WITH {IMAGE_SQL} SELECT t, z // 2 AS z, y // 2 AS y, x // 2 AS x, round(avg(v), 5) + 0 AS v FROM vox GROUP BY t, z // 2, y // 2, x // 2")
def avg_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernel_voxels(spark, sf_dir, spatial.pool(SHAPE, 2), (2, 2, 2))


@query(f"""WITH {IMAGE_SQL} SELECT o.t, o.z, o.y, o.x, round(sum(n.v - o.v), 5) + 0 AS v FROM vox o
JOIN vox n ON n.t = o.t AND abs(n.x - o.x) + abs(n.y - o.y) + abs(n.z - o.z) = 1 GROUP BY o.t, o.z, o.y, o.x""")
def laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernel_voxels(spark, sf_dir, spatial.laplacian(SHAPE))


@query(f"""WITH {IMAGE_SQL} SELECT o.t, o.z, o.y, o.x, round((h.v - l.v) / (h.x - l.x), 5) + 0 AS v FROM vox o
JOIN vox h ON h.t = o.t AND h.z = o.z AND h.y = o.y AND h.x = least(o.x + 1, 3) JOIN vox l ON l.t = o.t AND l.z = o.z AND l.y = o.y AND l.x = greatest(o.x - 1, 0)""")
def gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernel_voxels(spark, sf_dir, spatial.gradient(SHAPE, "x"))


@query(f"""WITH {IMAGE_SQL}, b AS (SELECT t, z, y, x, v, v > 0.1 AS hit FROM vox)
SELECT t, count(*) FILTER (hit) AS both, count(*) AS either FROM (SELECT t, hit OR x = 0 AS any_, hit AND x > 0 AS hit FROM b) WHERE any_ GROUP BY t""")
def mask_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union and intersection of masks as boolean columns."""
    rows = image_voxels(spark, sf_dir).select("t", "x", (F.col("v") > 0.1).alias("hit"))
    either = rows.filter(F.col("hit") | (F.col("x") == 0))
    return either.groupBy("t").agg(F.count_if(F.col("hit") & (F.col("x") > 0)).alias("both"), F.count("*").alias("either"))


@query(f"WITH {IMAGE_SQL} SELECT t, y AS row_, 3 - x AS col_, v FROM vox WHERE z = 2")
def orthogonal_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One axial plane, mirrored left to right."""
    return image_voxels(spark, sf_dir).filter(F.col("z") == 2).select("t", F.col("y").alias("row_"), (3 - F.col("x")).alias("col_"), "v")


@query(f"WITH {IMAGE_SQL} SELECT t, round(stddev_samp(v), 6) AS sd, min(v) AS low, max(v) AS high, count(v) AS n FROM vox GROUP BY t HAVING stddev_samp(v) > 1e-6")
def volume_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = image_voxels(spark, sf_dir).groupBy("t").agg(F.stddev_samp("v").alias("sd"), F.min("v").alias("low"), F.max("v").alias("high"), F.count("v").alias("n"))
    return got.filter(F.col("sd") > 1e-6).withColumn("sd", F.round("sd", 6))


@query(f"""WITH RECURSIVE {IMAGE_SQL}, h AS (SELECT t, z, y, x, z * 16 + y * 4 + x AS id FROM vox WHERE v > 0.1),
r AS (SELECT t, id, id AS root FROM h UNION SELECT r.t, n.id, r.root FROM r JOIN h o ON o.t = r.t AND o.id = r.id
  JOIN h n ON n.t = o.t AND abs(n.x - o.x) + abs(n.y - o.y) + abs(n.z - o.z) = 1),
l AS (SELECT t, id, min(root) AS cluster FROM r GROUP BY t, id), s AS (SELECT t, cluster, count(*) AS size FROM l GROUP BY t, cluster)
SELECT t, count(*) AS clusters, max(size) AS largest, count(*) FILTER (size >= 4) AS extended FROM s GROUP BY t""")
def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = relational.clusters(image_voxels(spark, sf_dir).filter(F.col("v") > 0.1), ["t"])
    sizes = found.groupBy("t", "cluster").agg(F.count("*").alias("size"))
    return sizes.groupBy("t").agg(F.count("*").alias("clusters"), F.max("size").alias("largest"), F.count_if(F.col("size") >= 4).alias("extended"))


_PAIRS = "p AS (SELECT a.t, a.z, a.y, a.x, CAST(round((least(greatest(a.v, -0.3), 0.3) + 0.3) / 0.6 * 7) AS INTEGER) AS a, CAST(round((least(greatest(b.v, -0.3), 0.3) + 0.3) / 0.6 * 7) AS INTEGER) AS b, a.v AS va, b.v AS vb FROM vox a JOIN vox b ON b.t = a.t + 1 AND b.z = a.z AND b.y = a.y AND b.x = a.x)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scan beside the next one: the volumes meet, not their voxels."""
    rows = image(spark, sf_dir)
    nxt = rows.select((F.col("t") - 1).alias("t"), F.col("data").alias("next"))
    both = rows.join(nxt, "t").select("t", F.arrays_zip("data", "next").alias("data"))
    v = layout.voxels(both, SHAPE)
    lv = lambda c: relational.levels(F.col(c), -0.3, 0.3, 8)
    return v.select(*AT, F.col("v.data").alias("va"), F.col("v.next").alias("vb")).withColumns({"a": lv("va"), "b": lv("vb")})


@query(f"WITH {IMAGE_SQL}, {_PAIRS} SELECT t, a, b, count(*) AS n FROM p GROUP BY t, a, b")
def joint_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.joint_histogram(_pairs(spark, sf_dir), ["t"], "a", "b")


@query(f"""WITH {IMAGE_SQL}, {_PAIRS}, h AS (SELECT t, a, b, count(*) AS n FROM p GROUP BY t, a, b),
ea AS (SELECT t, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM (SELECT t, a, sum(n) AS n FROM h GROUP BY t, a) GROUP BY t),
eb AS (SELECT t, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM (SELECT t, b, sum(n) AS n FROM h GROUP BY t, b) GROUP BY t),
e AS (SELECT t, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM h GROUP BY t)
SELECT t, round(ea.h + eb.h - e.h, 5) AS mi, round((ea.h + eb.h) / e.h, 5) AS nmi, round(2 - 2 * e.h / (ea.h + eb.h), 5) AS ecc FROM ea JOIN eb USING (t) JOIN e USING (t)""")
def mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = relational.information(relational.joint_histogram(_pairs(spark, sf_dir), ["t"], "a", "b"), ["t"], "a", "b")
    return found.select("t", *[F.round(c, 5).alias(c) for c in ("mi", "nmi", "ecc")])


@query(f"""WITH {IMAGE_SQL}, {_PAIRS}, r AS (SELECT t, corr(va, vb) AS r, count(*) AS n FROM p WHERE va <> 0 OR vb <> 0 GROUP BY t)
SELECT t, round(r, 5) AS r, n, r >= 0.2 AS pass FROM r""")
def similarity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = relational.audited(relational.similarity(_pairs(spark, sf_dir), ["t"], "va", "vb"), 0.2)
    return found.select("t", F.round("r", 5).alias("r"), "n", "pass")


@query(f"""WITH {IMAGE_SQL}, {_PAIRS}, r AS (SELECT t, corr(va, vb) AS r FROM p WHERE va <> 0 OR vb <> 0 GROUP BY t)
SELECT t, round(r, 5) AS r FROM r WHERE r < 0.2 ORDER BY t LIMIT 1""")
def first_failing_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = relational.audited(relational.similarity(_pairs(spark, sf_dir), ["t"], "va", "vb"), 0.2).withColumn("gating", F.lit(True))
    return relational.first_failing(found, "t").select("t", F.round("r", 5).alias("r"))


_GRID = " UNION ALL ".join(
    f"SELECT '{a}' AS left_, '{b}' AS right_, round(corr({ea}, {eb}), 5) AS r FROM p"
    for a, ea in (("raw", "va"), ("clipped", "least(greatest(va, -0.1), 0.1)"))
    for b, eb in (("raw", "vb"), ("clipped", "least(greatest(vb, -0.1), 0.1)"))
)


@query(f"WITH {IMAGE_SQL}, {_PAIRS} {_GRID}")
def ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of either side, all four pairings in one pass."""
    p = _pairs(spark, sf_dir)
    clip = lambda c: F.least(F.greatest(F.col(c), F.lit(-0.1)), F.lit(0.1))
    left, right = {"raw": F.col("va"), "clipped": clip("va")}, {"raw": F.col("vb"), "clipped": clip("vb")}
    one = p.agg(*[F.round(F.corr(x, y), 5).alias(f"{a}|{b}") for a, x in left.items() for b, y in right.items()])
    rows = F.array(*[F.struct(F.lit(a).alias("left_"), F.lit(b).alias("right_"), F.col(f"{a}|{b}").alias("r")) for a in left for b in right])
    return one.select(F.explode(rows).alias("s")).select("s.*")


@query(f"""WITH {IMAGE_SQL}, w AS (SELECT t, CAST(floor(z / 2.0) AS INTEGER) AS z, y, x, v FROM vox)
SELECT t, z, y, x, round(sum(v) / (count(*) + 0.001), 5) + 0 AS v FROM w GROUP BY t, z, y, x""")
def push_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scatter onto a grid of half the slices: sums over counts."""
    g = spatial.grid(SHAPE)
    g[:, 2] = np.floor(g[:, 2] / 2)
    return kernel_voxels(spark, sf_dir, spatial.push(SHAPE, g, (4, 4, 2)), (4, 4, 2))


@query()
def realign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of eight scans, each realigned to its mean."""
    runs = image(spark, sf_dir).withColumn("run", F.floor(F.col("t") / 8))
    got = registration.realign(runs, SHAPE, "run", voxel=VOXEL)
    return got.select("run", "t", *[F.round(c, 6).alias(c) for c in ("tx", "ty", "tz", "rx", "ry", "rz")])


def _reference() -> np.ndarray:
    z, y, x = np.meshgrid(*[np.arange(4.0)] * 3, indexing="ij")
    return np.exp(-((x - 1.5) ** 2 + (y - 1.5) ** 2 + (z - 1.5) ** 2) / 4)


@query()
def coreg_mi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every volume against one reference by mutual information."""
    got = registration.per_volume(image(spark, sf_dir), SHAPE, _reference(), registration.coregister, "p")
    return got.select("t", F.transform("p", lambda v: F.round(v, 6)).alias("p"))


@query()
def svf_warp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every volume onto one reference by a stationary velocity field: the mean displacement."""
    got = registration.per_volume(image(spark, sf_dir), SHAPE, _reference(), registration.warp, "u", together=256)
    return got.select("t", F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + F.abs(x)) / F.size("u"), 6).alias("mean_shift"))


@query(f"""WITH {IMAGE_SQL}, g AS (SELECT k, k * 0.75 AS p FROM (SELECT unnest(range(0, 5)) AS k)), q AS (SELECT t, y, x, z, x + y * 0.25 AS px FROM vox WHERE z = 0),
a AS (SELECT q.t, g.k AS z, q.y, q.x, px, p, least(floor(px), 2) AS lx, least(floor(p), 2) AS lz FROM q CROSS JOIN g), c(dx, dz) AS (VALUES (0, 0), (1, 0), (0, 1), (1, 1))
SELECT a.t, CAST(a.z AS INTEGER) AS z, a.y, a.x, round(CASE WHEN px > 3 THEN 0 ELSE sum(s.v * CASE dx WHEN 1 THEN px - lx ELSE 1 - (px - lx) END * CASE dz WHEN 1 THEN p - lz ELSE 1 - (p - lz) END) END, 5) + 0 AS v
FROM a CROSS JOIN c JOIN vox s ON s.t = a.t AND s.y = a.y AND s.z = lz + dz AND s.x = least(lx, 2) + dx GROUP BY a.t, a.z, a.y, a.x, px""")
def normalise_pull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Onto the standard grid through a displacement along x that grows by a quarter voxel a row."""
    shape, affine = registration.standard_grid((-4.5, -4.5, -6.0), (4.5, 4.5, 6.0), 3.0)
    field = np.zeros((3, 4, 4, 4))
    field[0] = 0.25 * np.arange(4.0)[None, :, None]
    rows = layout.map_arrays(image(spark, sf_dir), "data", lambda flat: np.stack([registration.normalise(v, AFFINE, field, AFFINE, shape, affine).ravel() for v in flat.reshape(-1, 4, 4, 4)]))
    return layout.voxels(rows, shape).select(*AT, (F.round("v", 5) + 0).alias("v"))
