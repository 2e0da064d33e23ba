"""Queries of masks, views, resampling and comparison over the image view."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.operators import headers, layout, masks, registration, relational, reslicing, spatial
from voxloom.plans.image_queries import AFFINE, AT, FWHM, VOXEL, _pairs, _smooth_sql, _taps_sql, kernel_voxels
from voxloom.plans.views import IMAGE_SQL, SHAPE, image, image_voxels

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


FINE_SHAPE, FINE = (7, 7, 4), AFFINE @ np.diag([0.5, 0.5, 1, 1])
_BALL = "(2 * x - 3) * (2 * x - 3) + (2 * y - 3) * (2 * y - 3) + (z - 1.5) * (z - 1.5) <= 9"


def _standard_mask(spark: SparkSession) -> DataFrame:
    """A ball on a grid of half the spacing along x and y, as one block row."""
    g = spatial.grid(FINE_SHAPE)
    ball = ((g[:, 0] - 3) ** 2 + (g[:, 1] - 3) ** 2 + (g[:, 2] - 1.5) ** 2 <= 9).astype(float)
    return spark.createDataFrame([(ball.tolist(),)], "data array<double>")


@query(f"WITH {IMAGE_SQL} SELECT t, z, y, x, v FROM vox WHERE {_BALL}")
def standard_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels inside a mask that comes on another grid."""
    keys = masks.on_grid(_standard_mask(spark), FINE_SHAPE, FINE, SHAPE, AFFINE)
    return masks.within(image_voxels(spark, sf_dir), F.broadcast(keys)).select(*AT, "v")


@query(f"""WITH {IMAGE_SQL}, m AS (SELECT z, y, x, avg(v) AS mean FROM vox GROUP BY z, y, x), b AS (SELECT * FROM m WHERE mean > 0.5 * (SELECT avg(mean) FROM m WHERE mean > 0)),
p AS (SELECT * FROM m WHERE mean > 0) SELECT 'brain' AS chain, z, y, x FROM p UNION ALL SELECT 'base', z, y, x FROM b UNION ALL SELECT 'positive', z, y, x FROM p""")
def mask_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The brain mask, else the base mask, else all positive means: with all three, without the first, with the last only."""
    means = image_voxels(spark, sf_dir).groupBy("z", "y", "x").agg(F.avg("v").alias("mean"))
    positive, base, none = means.filter("mean > 0"), relational.global_mask(means), means.filter("mean > 1e9")
    chains = {"brain": (positive, base, none), "base": (none, base, positive), "positive": (none, none, positive)}
    rows = [masks.first_usable(*c).select(F.lit(n).alias("chain"), "z", "y", "x") for n, c in chains.items()]
    return rows[0].union(rows[1]).union(rows[2])


def _runs_of_eight(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = image_voxels(spark, sf_dir).select(F.floor(F.col("t") / 8).alias("run"), (F.col("t") % 8).alias("scan"), "z", "y", "x", "v")
    return rows.groupBy("run", "z", "y", "x").agg(F.transform(F.sort_array(F.collect_list(F.struct("scan", "v"))), lambda s: s["v"]).alias("series"))


@query(f"WITH {IMAGE_SQL} SELECT t // 8 AS run, z, y, x, count(*) AS scans FROM vox GROUP BY t // 8, z, y, x HAVING min(v) > -0.2 AND min(v) < max(v) AND bool_and(v <> 0)")
def analysis_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels that are over a threshold in every scan, never 0 and not constant."""
    rows = _runs_of_eight(spark, sf_dir).filter(masks.analysed(F.col("series"), F.lit(-0.2)))
    return rows.select("run", "z", "y", "x", F.size("series").cast("long").alias("scans"))


def _padded_sql(name: str, source: str, axis: int, taps) -> str:
    a, r = "xyz"[axis], len(taps) // 2
    rest = [c for c in AT if c != a]
    values = ", ".join(f"({k - r}, {w!r})" for k, w in enumerate(taps.tolist()))
    return f"""k{name}(k, w) AS (VALUES {values}),
{name} AS (SELECT {', '.join('o.' + c for c in AT)}, sum(k.w * s.v) AS v FROM {source} o CROSS JOIN k{name} k
  JOIN {source} s ON {' AND '.join(f's.{c} = o.{c}' for c in rest)} AND s.{a} = o.{a} + k.k GROUP BY {', '.join('o.' + c for c in AT)})"""


_ONE = spatial.gaussian_taps(2 * np.sqrt(2 * np.log(2)), 1.0)


@query(f"""WITH {IMAGE_SQL}, l AS (SELECT t, list_sort(list(v)) AS s, count(*) AS n, greatest(1.0, least(count(*), count(*) * 0.2 + 0.5)) AS p FROM vox WHERE v <> 0 GROUP BY t),
c AS (SELECT t, s[CAST(floor(p) AS INTEGER)] + (p - floor(p)) * (s[CAST(least(floor(p) + 1, n) AS INTEGER)] - s[CAST(floor(p) AS INTEGER)]) AS cut FROM l),
m AS (SELECT vox.t, z, y, x, CAST(v > cut AS DOUBLE) AS v FROM vox JOIN c ON c.t = vox.t), {_padded_sql('bx', 'm', 0, _ONE)}, {_padded_sql('by_', 'bx', 1, _ONE)}, {_padded_sql('bz', 'by_', 2, _ONE)}
SELECT t, z, y, x, v > 0.5 AS brain FROM bz""")
def brain_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels over a percentile of the non-zero ones, the mask smoothed and cut at a half."""
    rows = layout.map_arrays(image(spark, sf_dir), "data", masks.brain(SHAPE))
    return layout.voxels(rows, SHAPE).select(*AT, (F.col("v") > 0.5).alias("brain"))


@query(f"WITH {IMAGE_SQL}, p AS (SELECT t, z, y, x, power(greatest(abs(v), abs(v) / 2, v * v), 0.5) AS g FROM vox) SELECT t, z, y, x, round(CASE WHEN g < 0.3 THEN 0 ELSE g * 100 END, 5) AS v FROM p")
def probability_brain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brain weight from three tissue maps."""
    maps = [F.abs("v"), F.abs("v") / 2, F.col("v") * F.col("v")]
    return image_voxels(spark, sf_dir).select(*AT, F.round(masks.tissue_brain(maps, 0.3, 0.5, 100.0), 5).alias("v"))


@query(f"WITH {IMAGE_SQL} SELECT t, z, y, x, CASE WHEN {_BALL} THEN v ELSE 0 END AS v FROM vox")
def outside_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All voxels, 0 outside of the mask."""
    keys = masks.on_grid(_standard_mask(spark), FINE_SHAPE, FINE, SHAPE, AFFINE)
    return masks.filled(image_voxels(spark, sf_dir), F.broadcast(keys), "v").select(*AT, "v")


@query(f"""WITH {IMAGE_SQL} SELECT 'axial' AS plane, t, CAST(3 - y AS INTEGER) AS row_, x AS col_, v FROM vox WHERE z = 1 UNION ALL
SELECT 'coronal', t, z, CAST(3 - x AS INTEGER), v FROM vox WHERE y = 2 UNION ALL SELECT 'sagittal', t, CAST(3 - z AS INTEGER), CAST(3 - y AS INTEGER), v FROM vox WHERE x = 0""")
def view_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three orthogonal planes, mirrored in different ways."""
    v = image_voxels(spark, sf_dir)
    planes = [("axial", 1, (False, True)), ("coronal", 2, (True, False)), ("sagittal", 0, (True, True))]
    rows = [headers.view(v, p, at, SHAPE, m).select(F.lit(p).alias("plane"), "t", F.col("row_").cast("int").alias("row_"), F.col("col_").cast("int").alias("col_"), "v") for p, at, m in planes]
    return rows[0].union(rows[1]).union(rows[2])


@query(f"""WITH {IMAGE_SQL}, p AS (SELECT a.t, a.z, a.y, a.x, a.v AS va, b.v AS vb FROM vox a JOIN vox b ON b.t = a.t + 1 AND b.z = a.z AND b.y = a.y AND b.x = a.x),
q AS (SELECT t, quantile_cont(abs(vb), 0.7) AS q FROM p GROUP BY t), f AS (SELECT p.*, (abs(va) >= q OR abs(vb) >= q) AS hit FROM p JOIN q ON q.t = p.t),
n AS (SELECT t, count(*) FILTER (hit) AS n FROM f GROUP BY t)
SELECT f.t, round(corr(va, vb) FILTER (hit OR n.n < 20), 5) AS r, count(*) FILTER (hit OR n.n < 20) AS n FROM f JOIN n ON n.t = f.t GROUP BY f.t""")
def flow_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of two fields where either is large; of all voxels where that leaves too few."""
    return relational.focused_similarity(_pairs(spark, sf_dir).select("t", "va", "vb"), ["t"], "va", "vb", 70, 20).select("t", F.round("r", 5).alias("r"), "n")


_SHIFTED = "s AS (SELECT t, z, y, x, x + (t % 2) * 0.5 AS p FROM vox), w AS (SELECT s.t, s.z, s.y, s.x, CASE WHEN p <= 3.05 THEN a.v * (1 - (p - floor(p))) + coalesce(b.v, 0) * (p - floor(p)) END AS v FROM s JOIN vox a ON a.t = s.t AND a.z = s.z AND a.y = s.y AND a.x = floor(s.p) LEFT JOIN vox b ON b.t = s.t AND b.z = s.z AND b.y = s.y AND b.x = floor(s.p) + 1)"


def _shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other scan moved by half a voxel; null where it isn't seen."""
    g = spatial.grid(SHAPE)
    even, odd = image(spark, sf_dir).filter("t % 2 = 0"), image(spark, sf_dir).filter("t % 2 = 1")
    moved = layout.map_arrays(odd, "data", reslicing.reslice(SHAPE, g + np.array([0.5, 0, 0]), 1))
    rows = layout.voxels(even.unionByName(moved), SHAPE)
    return rows.withColumn("v", F.when(~F.isnan("v"), F.col("v")))


@query(f"WITH {IMAGE_SQL}, {_SHIFTED} SELECT z, y, x, round(avg(v), 5) + 0 AS mean, count(v) AS n FROM w GROUP BY z, y, x")
def valid_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the scans that see a voxel, and how many do."""
    return _shifted(spark, sf_dir).groupBy("z", "y", "x").agg((F.round(F.avg("v"), 5) + 0).alias("mean"), F.count("v").alias("n"))


@query(f"WITH {IMAGE_SQL}, {_SHIFTED} SELECT w.t, w.z, w.y, w.x, round(v, 5) + 0 AS v FROM w WHERE x + 0.5 <= 3.05")
def common_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resliced scans, only where all of them see the voxel."""
    g = spatial.grid(SHAPE)
    seen = reslicing.common_view([g, g + np.array([0.5, 0, 0])], SHAPE)
    odd = layout.map_arrays(image(spark, sf_dir).filter("t % 2 = 1"), "data", reslicing.reslice(SHAPE, g + np.array([0.5, 0, 0]), 1, seen))
    even = layout.map_arrays(image(spark, sf_dir).filter("t % 2 = 0"), "data", reslicing.reslice(SHAPE, g, 3, seen))
    return layout.voxels(even.unionByName(odd), SHAPE).filter(~F.isnan("v")).select(*AT, (F.round("v", 5) + 0).alias("v"))


@query(f"WITH {IMAGE_SQL}, p AS (SELECT t, z, y, x, x * 1.1 - 0.2 AS px, y * 1.02 + 0.03 AS py FROM vox) SELECT t, z, y, x, px >= -0.05 AND px <= 3.05 AND py >= -0.05 AND py <= 3.05 AS seen FROM p")
def field_of_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = [F.col("x") * 1.1 - 0.2, F.col("y") * 1.02 + 0.03, F.col("z").cast("double")]
    return image_voxels(spark, sf_dir).select(*AT, reslicing.visible(at, SHAPE).alias("seen"))


_INTEGRATED = [reslicing.integrated_taps(FWHM, v) for v in VOXEL]


@query(f"WITH {IMAGE_SQL}, {_padded_sql('ix', 'vox', 0, _INTEGRATED[0])}, {_padded_sql('iy', 'ix', 1, _INTEGRATED[1])}, {_padded_sql('iz', 'iy', 2, _INTEGRATED[2])} SELECT t, z, y, x, round(v, 5) + 0 AS v FROM iz")
def smooth_integrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernel_voxels(spark, sf_dir, reslicing.smooth_integrated(SHAPE, FWHM, VOXEL))


@query(f"""WITH {IMAGE_SQL}, e AS (SELECT t, min(v) AS lo, max(v) AS hi, count(v) AS n FROM vox GROUP BY t), b AS (SELECT vox.*, lo, hi, n, CAST(floor((v - lo) / (hi - lo) * 31) AS INTEGER) AS bin FROM vox JOIN e ON e.t = vox.t),
c AS (SELECT t, bin, n, sum(count(*)) OVER (PARTITION BY t ORDER BY bin) AS upto FROM b GROUP BY t, bin, n), k AS (SELECT t, min(bin) AS cut FROM c WHERE upto >= n * 0.95 GROUP BY t),
s AS (SELECT b.*, lo + (cut + 1) / 31.0 * (hi - lo) AS top FROM b JOIN k ON k.t = b.t)
SELECT t, z, y, x, CAST(least(greatest(round((least(v, top) - lo) / (top - lo) * 255), 0), 255) AS INTEGER) AS level FROM s""")
def byte_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes as bytes, the range cut by a histogram."""
    return reslicing.bytes_levels(image_voxels(spark, sf_dir), ["t"], "v", 32, 0.95).select(*AT, "level")


_UP = "u(i, lo, f) AS (VALUES (0, 0, 0.0), (1, 0, 0.25), (2, 0, 0.75), (3, 0, 1.0))"


@query(f"""WITH {IMAGE_SQL}, {_UP}, p AS (SELECT t, z // 2 AS z, y // 2 AS y, x // 2 AS x, avg(v) AS v FROM vox GROUP BY 1, 2, 3, 4)
SELECT p.t, CAST(c.i AS INTEGER) AS z, CAST(b.i AS INTEGER) AS y, CAST(a.i AS INTEGER) AS x,
  round(sum(p.v * CASE WHEN p.x = 0 THEN 1 - a.f ELSE a.f END * CASE WHEN p.y = 0 THEN 1 - b.f ELSE b.f END * CASE WHEN p.z = 0 THEN 1 - c.f ELSE c.f END), 5) + 0 AS v
FROM p CROSS JOIN u a CROSS JOIN u b CROSS JOIN u c GROUP BY p.t, c.i, b.i, a.i""")
def flow_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Down to half the grid by means, and up again between cell centres."""
    kernel = lambda flat: registration.refined(registration.pooled(flat.reshape(-1, 4, 4, 4), 2), 2, (4, 4, 4)).reshape(len(flat), -1)
    return kernel_voxels(spark, sf_dir, kernel)


@query(f"""WITH {IMAGE_SQL}, d AS (SELECT o.t, o.z, o.y, o.x, o.v, 1 + 0.5 * (h.v - l.v) / (h.x - l.x) AS j FROM vox o
JOIN vox h ON h.t = o.t AND h.z = o.z AND h.y = o.y AND h.x = least(o.x + 1, 3) JOIN vox l ON l.t = o.t AND l.z = o.z AND l.y = o.y AND l.x = greatest(o.x - 1, 0))
SELECT t, z, y, x, round(v * j, 5) + 0 AS v FROM d""")
def jacobian_modulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each volume times the volume change of a displacement by half of itself along x."""

    def kernel(flat):
        v = flat.reshape(-1, 4, 4, 4)
        return np.stack([reslicing.modulated(a[None], np.stack([a / 2, 0 * a, 0 * a]))[0].ravel() for a in v])

    return kernel_voxels(spark, sf_dir, kernel)


@query(f"""WITH {IMAGE_SQL}, l AS (SELECT t, list_sort(list(v)) AS s, count(*) AS n, greatest(1.0, least(count(*), count(*) * 0.4 + 0.5)) AS p FROM vox WHERE v > 0 GROUP BY t),
c AS (SELECT t, s[CAST(floor(p) AS INTEGER)] + (p - floor(p)) * (s[CAST(least(floor(p) + 1, n) AS INTEGER)] - s[CAST(floor(p) AS INTEGER)]) AS cut FROM l)
SELECT vox.t, z, y, x, v >= 0.2 AS active, 3.0 * x - 4.5 AS wx, 3.0 * y - 4.5 AS wy, 4.0 * z - 6.0 AS wz FROM vox JOIN c ON c.t = vox.t WHERE v >= cut""")
def surface_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The voxels of a rendering: over the surface level (a percentile of the positive ones), with mm, active or not."""
    rows = image_voxels(spark, sf_dir)
    cuts = relational.percentile(rows.filter("v > 0"), ["t"], "v", 40).withColumnRenamed("percentile", "cut")
    world = [sum((F.col(c) * float(AFFINE[k, j]) for j, c in enumerate("xyz")), F.lit(float(AFFINE[k, 3]))).alias(f"w{'xyz'[k]}") for k in range(3)]
    return rows.join(cuts, "t").filter("v >= cut").select(*AT, (F.col("v") >= 0.2).alias("active"), *world)


@query(f"WITH {IMAGE_SQL} SELECT t, CASE t % 4 WHEN 0 THEN 'gm' ELSE 'wm' END AS tissue, round(sum(v), 5) AS total FROM vox WHERE t % 4 IN (0, 1) GROUP BY t")
def template_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two tissue volumes of every template of four volumes, picked by their place."""
    names = F.create_map(F.lit(0), F.lit("gm"), F.lit(1), F.lit("wm"))
    rows = image(spark, sf_dir).withColumn("tissue", names[(F.col("t") % 4).cast("int")]).filter(F.col("tissue").isNotNull())
    return rows.select("t", "tissue", F.round(F.aggregate("data", F.lit(0.0), lambda a, v: a + v), 5).alias("total"))


@query(f"WITH {IMAGE_SQL} SELECT t, z, y, x, v FROM vox WHERE t < 20 AND x IN (0, 3)")
def cropped_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty scans, two sides only."""
    return image_voxels(spark, sf_dir).filter((F.col("t") < 20) & F.col("x").isin(0, 3)).select(*AT, "v")


_LEVELS = """lq AS (SELECT t, list_sort(list(v)) AS s, count(*) AS n, count(*) * 0.01 + 0.5 AS a, count(*) * 0.99 + 0.5 AS b FROM vox GROUP BY t),
lc AS (SELECT t, s[CAST(floor(greatest(a, 1)) AS INTEGER)] + (greatest(a, 1) - floor(greatest(a, 1))) * (s[CAST(least(floor(greatest(a, 1)) + 1, n) AS INTEGER)] - s[CAST(floor(greatest(a, 1)) AS INTEGER)]) AS lo,
  s[CAST(floor(least(b, n)) AS INTEGER)] + (least(b, n) - floor(least(b, n))) * (s[CAST(least(floor(least(b, n)) + 1, n) AS INTEGER)] - s[CAST(floor(least(b, n)) AS INTEGER)]) AS hi FROM lq)"""


@query(f"WITH {IMAGE_SQL}, {_LEVELS} SELECT vox.t, z, y, x, CAST(round((least(greatest(v, lo), hi) - lo) / (hi - lo) * 63) AS INTEGER) AS level FROM vox JOIN lc ON lc.t = vox.t")
def intensity_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 levels between the first and the last percentile of each volume."""
    rows = image_voxels(spark, sf_dir)
    at = lambda p, n: relational.percentile(rows.select("t", "v"), ["t"], "v", p).withColumnRenamed("percentile", n)
    v = F.round((F.least(F.greatest("v", "lo"), F.col("hi")) - F.col("lo")) / (F.col("hi") - F.col("lo")) * 63)
    return rows.join(at(1, "lo"), "t").join(at(99, "hi"), "t").select(*AT, v.cast("int").alias("level"))


_PAIR = "p AS (SELECT a.t, CAST(round((least(greatest(a.v, -0.3), 0.3) + 0.3) / 0.6 * 7) AS INTEGER) AS a, CAST(round((least(greatest(b.v, -0.3), 0.3) + 0.3) / 0.6 * 7) AS INTEGER) AS b FROM vox a JOIN vox b ON b.t = a.t + 1 AND b.z = a.z AND b.y = a.y AND b.x = a.x)"
_ENTROPY = "(ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(2)"


@query(f"""WITH {IMAGE_SQL}, {_PAIR}, h AS (SELECT t, a, b, count(*) AS n FROM p GROUP BY t, a, b), k(d, w) AS (VALUES (-1, 0.25), (0, 0.5), (1, 0.25)),
s AS (SELECT t, a + i.d AS a, b + j.d AS b, sum(n * i.w * j.w) AS n FROM h CROSS JOIN k i CROSS JOIN k j WHERE a + i.d BETWEEN 0 AND 7 AND b + j.d BETWEEN 0 AND 7 GROUP BY 1, 2, 3),
ea AS (SELECT t, {_ENTROPY} AS h FROM (SELECT t, a, sum(n) AS n FROM s GROUP BY t, a) GROUP BY t), eb AS (SELECT t, {_ENTROPY} AS h FROM (SELECT t, b, sum(n) AS n FROM s GROUP BY t, b) GROUP BY t),
e AS (SELECT t, {_ENTROPY} AS h, (sum(n * a * b) / sum(n) - sum(n * a) / sum(n) * sum(n * b) / sum(n)) / sqrt((sum(n * a * a) / sum(n) - (sum(n * a) / sum(n)) ** 2) * (sum(n * b * b) / sum(n) - (sum(n * b) / sum(n)) ** 2)) AS ncc FROM s GROUP BY t)
SELECT t, round(ea.h + eb.h - e.h, 5) AS mi, round((ea.h + eb.h) / e.h, 5) AS nmi, round(2 - 2 * e.h / (ea.h + eb.h), 5) AS ecc, round(ncc, 5) AS ncc FROM ea JOIN eb USING (t) JOIN e USING (t)""")
def smoothed_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of neighbouring scans from a smoothed joint histogram, in bits."""
    h = relational.smoothed_histogram(relational.joint_histogram(_pairs(spark, sf_dir), ["t"], "a", "b"), ["t"], "a", "b", (0.25, 0.5, 0.25), 8)
    found = relational.information(h, ["t"], "a", "b", base=2.0)
    return found.select("t", *[F.round(c, 5).alias(c) for c in ("mi", "nmi", "ecc", "ncc")])


@query(f"""WITH {IMAGE_SQL}, q AS (SELECT *, x * 0.75 AS px, z * 0.5 + 0.125 AS pz FROM vox), c(dx, dz) AS (VALUES (0, 0), (1, 0), (0, 1), (1, 1)),
s AS (SELECT t, CAST(floor(pz) + dz AS INTEGER) AS z, y, CAST(floor(px) + dx AS INTEGER) AS x, v, CASE dx WHEN 1 THEN px - floor(px) ELSE 1 - (px - floor(px)) END * CASE dz WHEN 1 THEN pz - floor(pz) ELSE 1 - (pz - floor(pz)) END AS w FROM q CROSS JOIN c)
SELECT t, z, y, x, round(sum(w * v) / (sum(w) + 0.001), 5) + 0 AS v FROM s WHERE x BETWEEN 0 AND 3 AND z BETWEEN 0 AND 1 GROUP BY t, z, y, x""")
def push_fractional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scatter between the cells of a coarser grid: shares of each voxel to the cells around it."""
    g = spatial.grid(SHAPE) * np.array([0.75, 1, 0.5]) + np.array([0, 0, 0.125])
    return kernel_voxels(spark, sf_dir, spatial.push(SHAPE, g, (4, 4, 2)), (4, 4, 2))


@query(f"""WITH {IMAGE_SQL}, g AS (SELECT o.t, o.z, o.y, o.x, (h.v - l.v) / (h.y - l.y) AS gy, (u.v - d.v) / (u.z - d.z) AS gz FROM vox o
JOIN vox h ON h.t = o.t AND h.z = o.z AND h.x = o.x AND h.y = least(o.y + 1, 3) JOIN vox l ON l.t = o.t AND l.z = o.z AND l.x = o.x AND l.y = greatest(o.y - 1, 0)
JOIN vox u ON u.t = o.t AND u.y = o.y AND u.x = o.x AND u.z = least(o.z + 1, 3) JOIN vox d ON d.t = o.t AND d.y = o.y AND d.x = o.x AND d.z = greatest(o.z - 1, 0))
SELECT t, z, y, x, round(gy, 5) + 0 AS gy, round(gz, 5) + 0 AS gz FROM g""")
def gradient_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slopes along y and z of every voxel."""
    rows = image(spark, sf_dir)
    rows = layout.map_arrays(layout.map_arrays(rows, "data", spatial.gradient(SHAPE, "y"), "gy"), "data", spatial.gradient(SHAPE, "z"), "gz")
    both = layout.voxels(rows.select("t", F.arrays_zip("gy", "gz").alias("g")), SHAPE, "g", "s")
    return both.select(*AT, (F.round("s.gy", 5) + 0).alias("gy"), (F.round("s.gz", 5) + 0).alias("gz"))


@query(f"""WITH RECURSIVE {IMAGE_SQL}, h AS (SELECT t, z, y, x, v, z * 16 + y * 4 + x AS id FROM vox WHERE v > 0.1),
r AS (SELECT t, id, id AS root FROM h UNION SELECT r.t, n.id, r.root FROM r JOIN h o ON o.t = r.t AND o.id = r.id
  JOIN h n ON n.t = o.t AND abs(n.x - o.x) + abs(n.y - o.y) + abs(n.z - o.z) = 1),
l AS (SELECT t, id, min(root) AS cluster FROM r GROUP BY t, id), s AS (SELECT t, cluster FROM l GROUP BY t, cluster HAVING count(*) >= 4)
SELECT h.t, h.z, h.y, h.x, h.v, 3.0 * h.x - 4.5 AS wx, 3.0 * h.y - 4.5 AS wy, 4.0 * h.z - 6.0 AS wz FROM h JOIN l ON l.t = h.t AND l.id = h.id JOIN s ON s.t = l.t AND s.cluster = l.cluster""")
def thresholded_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map over its height and extent thresholds, as points with mm."""
    found = relational.extent(relational.clusters(image_voxels(spark, sf_dir).filter(F.col("v") > 0.1), ["t"]), ["t"], 4)
    world = [sum((F.col(c) * float(AFFINE[k, j]) for j, c in enumerate("xyz")), F.lit(float(AFFINE[k, 3]))).alias(f"w{'xyz'[k]}") for k in range(3)]
    return found.select(*AT, "v", *world)
