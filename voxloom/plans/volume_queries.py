"""Queries of estimated noise, frames and private headers, tolerance groups, known motion and surfaces."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.operators import bias, glm, layout, matching, registration, scaling, spatial, surface
from voxloom.plans.series_queries import _short
from voxloom.plans.views import IMAGE_SQL, SHAPE, image, image_voxels, table
from voxloom.session import settled
from voxloom.sources import dicom, dicom_frames

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


# --- noise covariance and smoothness --------------------------------------------------------------------------------------
SHORT_SQL = """s AS (SELECT t // 16 AS run, z, y, x, t % 16 AS scan, v FROM vox),
short AS MATERIALIZED (SELECT k.run, k.z, k.y, k.x, n.n AS scan, coalesce(s.v, 0) AS v FROM (SELECT DISTINCT run, z, y, x FROM s) k CROSS JOIN (SELECT unnest(range(0, 16)) AS n) n
  LEFT JOIN s ON s.run = k.run AND s.z = k.z AND s.y = k.y AND s.x = k.x AND s.scan = n.n)"""


def _waves() -> np.ndarray:
    """The cosine basis of sixteen scans, constant first."""
    k = np.arange(16)
    b = np.sqrt(2 / 16) * np.cos(np.pi * np.outer(2 * k + 1, k) / 32)
    b[:, 0] = 0.25
    return b


@query(f"""WITH {IMAGE_SQL}, {SHORT_SQL}, c AS MATERIALIZED (
  SELECT run, z, y, x, k.k, sum(v * CASE WHEN k.k = 0 THEN 0.25 ELSE sqrt(2.0 / 16) * cos(pi() * (2 * scan + 1) * k.k / 32) END) AS c
  FROM short CROSS JOIN (SELECT unnest(range(0, 16)) AS k) k GROUP BY run, z, y, x, k.k),
h AS (SELECT avg(c * c) FILTER (k IN (1, 3)) AS low, avg(c * c) FILTER (k > 3) AS high FROM c),
r AS (SELECT run, z, y, x, sum(CASE WHEN k = 2 THEN c END) AS b, sum(CASE WHEN k IN (1, 3) THEN c * c / low WHEN k > 3 THEN c * c / high END) / 14 AS s, any_value(high) AS high FROM c CROSS JOIN h GROUP BY run, z, y, x)
SELECT run, z, y, x, round(b, 6) + 0 AS con, round(b / sqrt(high * s), 4) + 0 AS t FROM r""")
def reml_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t of a slow wave under a noise covariance estimated from all voxels: white noise, and more of it in two slow waves. As
    design and components are orthogonal here, the estimate has a closed form."""
    waves, rows = _waves(), settled(_short(spark, sf_dir))
    got = glm.reml(rows, waves[:, [0, 2]], [np.eye(16), waves[:, [1, 3]] @ waves[:, [1, 3]].T], {"wave": (0.0, 1.0)})
    return got.select("run", "z", "y", "x", (F.round("con_wave", 6) + 0).alias("con"), (F.round("t_wave", 4) + 0).alias("t"))


SMOOTH_SQL = f"""WITH {IMAGE_SQL}, {SHORT_SQL}, m AS (SELECT *, v - avg(v) OVER (PARTITION BY run, z, y, x) AS d FROM short),
u AS MATERIALIZED (SELECT run, z, y, x, scan, d / sqrt(sum(d * d) OVER (PARTITION BY run, z, y, x) / 15) AS u FROM m),
p AS (SELECT 'x' AS axis, a.run, a.z, a.y, a.x, sum((b.u - a.u) ** 2) / 15 AS d2 FROM u a JOIN u b ON a.run = b.run AND a.scan = b.scan AND a.z = b.z AND a.y = b.y AND b.x = a.x + 1 GROUP BY a.run, a.z, a.y, a.x
  UNION ALL SELECT 'y', a.run, a.z, a.y, a.x, sum((b.u - a.u) ** 2) / 15 FROM u a JOIN u b ON a.run = b.run AND a.scan = b.scan AND a.z = b.z AND b.y = a.y + 1 AND a.x = b.x GROUP BY a.run, a.z, a.y, a.x
  UNION ALL SELECT 'z', a.run, a.z, a.y, a.x, sum((b.u - a.u) ** 2) / 15 FROM u a JOIN u b ON a.run = b.run AND a.scan = b.scan AND b.z = a.z + 1 AND a.y = b.y AND a.x = b.x GROUP BY a.run, a.z, a.y, a.x),
f AS (SELECT run, axis, count(*) AS pairs, sqrt(4 * ln(2) / avg(d2)) AS fwhm FROM p GROUP BY run, axis)"""


def _smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    centred = layout.map_arrays(_short(spark, sf_dir), "series", lambda y: y - y.mean(1, keepdims=True))
    return glm.smoothness(settled(centred), ["run"], 16, 15)


@query(f"{SMOOTH_SQL} SELECT run, axis, pairs, round(fwhm, 6) AS fwhm FROM f")
def field_smoothness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widths of the noise of each run along the axes, in voxels."""
    return _smooth(spark, sf_dir).select("run", "axis", "pairs", F.round("fwhm", 6).alias("fwhm"))


@query(f"{SMOOTH_SQL} SELECT run, CAST(64 AS BIGINT) AS voxels, round(64 / product(fwhm), 6) AS resels FROM f GROUP BY run")
def field_resels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolution elements of each run."""
    sizes = _short(spark, sf_dir).groupBy("run").agg(F.count("*").alias("voxels"))
    return glm.resels(_smooth(spark, sf_dir), ["run"], sizes).select("run", "voxels", F.round("resels", 6).alias("resels"))


@query(f"""WITH {IMAGE_SQL}, w(i, j, k, norm) AS (VALUES (0, 0, 1, 32), (0, 1, 0, 32), (0, 1, 1, 16), (1, 0, 0, 32), (1, 0, 1, 16), (1, 1, 0, 16), (1, 1, 1, 8)),
c AS (SELECT t, i, j, k, sum(v * cos(pi() * (2 * x + 1) * i / 8) * cos(pi() * (2 * y + 1) * j / 8) * cos(pi() * (2 * z + 1) * k / 8)) / any_value(norm + 0.001 * 152 / 7) AS c FROM vox CROSS JOIN w GROUP BY t, i, j, k)
SELECT vox.t, z, y, x, round(v - sum(c * cos(pi() * (2 * x + 1) * i / 8) * cos(pi() * (2 * y + 1) * j / 8) * cos(pi() * (2 * z + 1) * k / 8)), 6) + 0 AS v FROM vox JOIN c ON c.t = vox.t GROUP BY vox.t, z, y, x, v""")
def bias_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes (as logarithms) without their smooth field; with one class the fit has a closed form."""
    rows = image_voxels(spark, sf_dir).withColumn("v", F.exp("v"))
    got = bias.corrected(rows, "t", SHAPE, bias.bias_field(rows, "t", SHAPE, classes=1, order=2, rounds=1), order=2)
    return got.select("t", "z", "y", "x", (F.round(F.log("v"), 6) + 0).alias("v"))


# --- files ----------------------------------------------------------------------------------------------------------------
def _files(spark: SparkSession, sf_dir: str, encode) -> DataFrame:
    """(path, content): ``encode(id, values)`` for each embedding of 64 values."""
    rows = table(spark, sf_dir, "embeddings").filter(F.size("embedding") == 64).select("vec_id", "embedding")

    def run(batches):
        for b in batches:
            ids, values = b.column("vec_id").to_pylist(), np.round(layout.matrix(b.column("embedding")).astype(np.float32).astype(float) * 8000)
            yield pa.RecordBatch.from_arrays([pa.array([f"/f/{k}.dcm" for k in ids]), pa.array([encode(k, v) for k, v in zip(ids, values, strict=True)], pa.binary())], ["path", "content"])

    return rows.mapInArrow(run, "path string, content binary")


def _id():
    return F.regexp_extract("path", r"(\d+)\.dcm$", 1).cast("long").alias("vec_id")


@query("""WITH e AS (SELECT vec_id, unnest(embedding) AS v, unnest(range(0, 64)) AS i FROM embeddings WHERE len(embedding) = 64),
f AS (SELECT vec_id, CASE WHEN vec_id % 2 = 1 AND i >= 32 THEN '2' ELSE '1' END AS stack, (i // 16 * 3) % 4 AS place, 3 - i % 16 // 4 AS y, i % 4 AS x, round(CAST(v AS DOUBLE) * 8000) * CASE WHEN i // 16 % 2 = 0 THEN 0.5 ELSE 1 END AS v FROM e)
SELECT vec_id, stack, CAST(dense_rank() OVER (PARTITION BY vec_id, stack ORDER BY place) - 1 AS INTEGER) AS z, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, v + 0 AS v FROM f""")
def multiframe_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of four frames in mixed order, with places, slopes and stacks of their own, from bytes to volumes."""

    def encode(k, v):
        return dicom_frames.encoded_frames(v.reshape(4, 4, 4), [(0, 0, 3 * f % 4) for f in range(4)], (1, 0, 0, 0, 1, 0), f"1.{k}", ["2" if k % 2 and f > 1 else "1" for f in range(4)], [1] * 4, [0.5, 1.0, 0.5, 1.0], k % 3 == 0)

    found = dicom_frames.volumes(settled(dicom_frames.frames(_files(spark, sf_dir, encode))))
    long = found.select(_id(), "stack", F.posexplode("data").alias("k", "v"))
    at = lambda c: F.floor(c).cast("int")
    return long.select("vec_id", "stack", at(F.col("k") / 16).alias("z"), at(F.col("k") / 4 % 4).alias("y"), (F.col("k") % 4).alias("x"), (F.col("v") + 0).alias("v"))


@query(f"WITH {IMAGE_SQL} SELECT t AS vec_id, t % 2 = 1 AS backwards, CAST(CASE WHEN t % 2 = 1 THEN 3 - z ELSE z END AS INTEGER) AS z, y, x, round(v * 8000) + 0 AS v FROM vox")
def mosaic_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mosaics whose private header says in which order their slices lie."""

    def encode(k, v):
        private = dicom_frames.encoded_private({"NumberOfImagesInMosaic": ["4"], "SliceNormalVector": ["0.0", "0.0", "-1.0" if k % 2 else "1.0"]})
        tags = {0x00080008: (b"CS", b"ORIGINAL\\MOSAIC"), 0x0020000E: (b"UI", b"1.2.%d" % (k // 40)), 0x00200013: (b"IS", b"%d" % k), 0x00200037: (b"DS", b"1\\0\\0\\0\\1\\0"), 0x00291010: (b"OB", private)}
        return dicom.encode(v.reshape(8, 8), tags)

    files = settled(_files(spark, sf_dir, encode))
    got = dicom_frames.in_order(dicom.mosaic_series(dicom.headers(files), 4, 4), dicom_frames.private_headers(files), 16, 4)
    return layout.voxels(got.select(_id(), "backwards", "data"), SHAPE).select("vec_id", "backwards", "z", "y", "x", (F.col("v") + 0).alias("v"))


@query("""WITH RECURSIVE p AS (SELECT p_brand, p_partkey, p_size / 10.0 AS a, CAST(p_retailprice AS DOUBLE) / 100 AS b, (p_size % 3) / 10.0 AS c, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part),
g AS (SELECT p_brand, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS p_partkey, CAST(NULL AS BIGINT) AS leader, CAST([] AS STRUCT(k BIGINT, a DOUBLE, b DOUBLE, c DOUBLE)[]) AS leaders FROM (SELECT DISTINCT p_brand FROM p)
  UNION ALL SELECT g.p_brand, p.n, p.p_partkey, coalesce(m.found[1].k, p.p_partkey), CASE WHEN len(m.found) = 0 THEN list_append(g.leaders, {'k': p.p_partkey, 'a': CAST(p.a AS DOUBLE), 'b': p.b, 'c': CAST(p.c AS DOUBLE)}) ELSE g.leaders END
  FROM g JOIN p ON p.p_brand = g.p_brand AND p.n = g.n + 1, LATERAL (SELECT list_filter(g.leaders, lambda l: abs(l.a - p.a) < 0.75 AND abs(l.b - p.b) < 0.75 AND abs(l.c - p.c) < 0.15) AS found) m)
SELECT p_partkey, leader FROM g WHERE n > 0""")
def first_match_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of a brand in the order of their keys, each with the first one before it that it agrees with."""
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.array(F.col("p_size") / 10, F.col("p_retailprice").cast("double") / 100).alias("place"), F.array(F.col("p_size") % 3 / 10).alias("turn"))
    found = matching.leaders(rows, ["p_brand"], ["p_partkey"], ["place", "turn"], [0.75, 0.15])
    return found.select("p_partkey", F.col("leader.p_partkey").alias("leader"))


@query(f"""WITH {IMAGE_SQL}, r AS (SELECT t, z, y * 4 + x AS k, round(v * 8000) AS raw, CASE WHEN t % 4 = 0 THEN 0.5 ELSE 0.5 * (1 + z % 3) END AS slope, CASE WHEN t % 4 = 0 THEN 3 ELSE z * 2.5 END AS shift FROM vox),
q AS (SELECT *, raw * slope + shift AS real, min(raw * slope + shift) OVER (PARTITION BY t) AS low, (max(raw * slope + shift) OVER (PARTITION BY t) - min(raw * slope + shift) OVER (PARTITION BY t)) / 255 AS scale FROM r)
SELECT t, CAST(z AS INTEGER) AS z, CAST(k AS INTEGER) AS k, CAST(CASE WHEN t % 4 = 0 THEN raw ELSE greatest(0, least(255, floor((real - low) / scale + (k * 0.6180339887498949 + z * 0.7548776662466927) % 1))) - 128 END AS BIGINT) AS stored,
  round(CASE WHEN t % 4 = 0 THEN 0.5 ELSE scale END, 6) AS scale, round(CASE WHEN t % 4 = 0 THEN 3 ELSE low + 128 * scale END, 6) + 0 AS offset FROM q""")
def one_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes whose slices have slopes of their own, stored in eight bits with one scale each."""
    same, z = F.col("t") % 4 == 0, F.col("z")
    cut = F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.struct(k.alias("z"), F.transform(F.slice("data", k * 16 + 1, 16), lambda v: F.round(v * 8000)).alias("raw"))))
    slices = image(spark, sf_dir).select("t", cut.alias("s")).select("t", "s.*")
    slices = slices.withColumns({"slope": F.when(same, 0.5).otherwise(0.5 * (1 + z % 3)), "intercept": F.when(same, 3.0).otherwise(z * 2.5)})
    got = scaling.one_scale(slices, ["t"], "z", bits=8)
    return got.select("t", "z", F.posexplode("stored").alias("k", "stored"), F.round("scale", 6).alias("scale"), (F.round("offset", 6) + 0).alias("offset"))


# --- known motion ---------------------------------------------------------------------------------------------------------
EDGE, CUT = 16, 12
#: Where the four cuts of each volume begin.
OFFSETS = np.array([(k & 1, k >> 1 & 1, (k + 1) >> 1 & 1) for k in range(4)])
KNOWN_SQL = "WITH g AS (SELECT vec_id // 64 AS volume FROM embeddings WHERE len(embedding) = 64 GROUP BY 1 HAVING count(*) = 64)"


def _cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(volume, t, data): smoothed volumes of sixteen voxels along each axis, out of 64 embeddings each, cut four times; the cuts are one
    voxel apart along some axes."""
    rows = table(spark, sf_dir, "embeddings").filter(F.size("embedding") == 64)
    parts = rows.groupBy(F.floor(F.col("vec_id") / 64).alias("volume")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("s")).filter(F.size("s") == 64)
    whole = parts.select("volume", F.flatten(F.col("s.embedding")).cast("array<double>").alias("data"))
    smooth = spatial.smooth((EDGE, EDGE, EDGE), 5.0, (1.0, 1.0, 1.0))

    def cut(flat):
        v = smooth(flat).reshape(-1, EDGE, EDGE, EDGE)
        v = v / np.maximum(v.std((1, 2, 3), keepdims=True), 1e-12)
        return np.stack([v[:, z : z + CUT, y : y + CUT, x : x + CUT].reshape(len(v), -1) for x, y, z in OFFSETS], 1).reshape(len(v), -1)

    four = layout.map_arrays(whole, "data", cut)
    return four.select("volume", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.slice("data", k * CUT**3 + 1, CUT**3))).alias("t", "data"))


MOTION_SQL = f"{KNOWN_SQL}, t AS (SELECT unnest(range(0, 4)) AS t) SELECT volume, CAST(t AS INTEGER) AS t, CAST(-(t & 1) AS DOUBLE) AS tx, CAST(-((t >> 1) & 1) AS DOUBLE) AS ty, CAST(-(((t + 1) >> 1) & 1) AS DOUBLE) AS tz, CAST(0 AS DOUBLE) AS turn FROM g CROSS JOIN t"


def _motion(found: DataFrame) -> DataFrame:
    near = lambda c: F.round(c, 1) + 0
    return found.select("volume", "t", *[near(c).alias(c) for c in ("tx", "ty", "tz")], near(F.abs("rx") + F.abs("ry") + F.abs("rz")).alias("turn"))


@query(MOTION_SQL)
def realign_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Motion between cuts of one volume, trilinear; the true one is known."""
    return _motion(registration.realign(_cuts(spark, sf_dir), (CUT, CUT, CUT), "volume", passes=1))


@query(MOTION_SQL)
def realign_splines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through cubic splines, with the target's Jacobian and its informative samples only."""
    return _motion(registration.realign_splines(_cuts(spark, sf_dir), (CUT, CUT, CUT), "volume", passes=1))


@query(MOTION_SQL)
def coreg_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts in another contrast against the first one, by normalised mutual information at two distances; to the nearest voxel."""
    cuts = settled(_cuts(spark, sf_dir))
    first = cuts.filter("t = 0").select("volume", F.col("data").alias("fixed"))
    both = cuts.join(first, "volume").select("volume", "t", F.concat("fixed", "data").alias("data"))

    def fit(flat):
        fixed, moving = np.moveaxis(flat.reshape(-1, 2, CUT, CUT, CUT), 1, 0)
        return registration.coregister_levels(np.exp(-0.5 * moving), fixed, sep=(2.0, 1.0), bins=32)

    got = layout.map_arrays(registration.dealt(both), "data", fit, "p", values=1 << 19)
    near = lambda k: F.round(F.col("p")[k], 0) + 0
    return got.select("volume", "t", near(0).alias("tx"), near(1).alias("ty"), near(2).alias("tz"), (F.round(F.abs(F.col("p")[3]) + F.abs(F.col("p")[4]) + F.abs(F.col("p")[5]), 0) + 0).alias("turn"))


# --- surfaces -------------------------------------------------------------------------------------------------------------
LEVEL = 0.05
_TETRA = ", ".join(f"[{', '.join(str(c) for c in t)}]" for t in surface.TETRAHEDRA)


@query(f"""WITH {IMAGE_SQL}, o AS (SELECT k, k & 1 AS dx, (k >> 1) & 1 AS dy, k >> 2 AS dz FROM (SELECT unnest(range(0, 8)) AS k)),
c AS (SELECT t, x - dx AS cx, y - dy AS cy, z - dz AS cz, list({{'x': x, 'y': y, 'z': z, 'v': v}} ORDER BY k) AS c FROM vox CROSS JOIN o GROUP BY 1, 2, 3, 4 HAVING count(*) = 8),
k AS (SELECT t, c, unnest([{_TETRA}]) AS k FROM c),
s AS (SELECT t, list_filter(list_transform(k, lambda i: c[i + 1]), lambda p: p.v >= {LEVEL}) AS i, list_filter(list_transform(k, lambda i: c[i + 1]), lambda p: p.v < {LEVEL}) AS o FROM k),
e AS (SELECT t, CASE len(i) WHEN 1 THEN [[i[1], o[1]], [i[1], o[2]], [i[1], o[3]]] WHEN 3 THEN [[i[1], o[1]], [i[2], o[1]], [i[3], o[1]]] ELSE [[i[1], o[1]], [i[1], o[2]], [i[2], o[2]], [i[2], o[1]]] END AS e FROM s WHERE len(i) BETWEEN 1 AND 3),
p AS (SELECT t, list_transform(e, lambda q: {{'x': q[1].x + ({LEVEL} - q[1].v) / (q[2].v - q[1].v) * (q[2].x - q[1].x), 'y': q[1].y + ({LEVEL} - q[1].v) / (q[2].v - q[1].v) * (q[2].y - q[1].y),
  'z': q[1].z + ({LEVEL} - q[1].v) / (q[2].v - q[1].v) * (q[2].z - q[1].z)}}) AS p FROM e),
f AS (SELECT t, unnest(CASE len(p) WHEN 3 THEN [[p[1], p[2], p[3]]] ELSE [[p[1], p[2], p[3]], [p[1], p[3], p[4]]] END) AS f FROM p),
d AS (SELECT t, f[2].x - f[1].x AS ax, f[2].y - f[1].y AS ay, f[2].z - f[1].z AS az, f[3].x - f[1].x AS bx, f[3].y - f[1].y AS by_, f[3].z - f[1].z AS bz FROM f)
SELECT t, count(*) AS triangles, round(sum(sqrt((ay * bz - az * by_) ** 2 + (az * bx - ax * bz) ** 2 + (ax * by_ - ay * bx) ** 2) / 2), 5) AS area FROM d GROUP BY t""")
def surface_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surface of each volume at a level: its triangles and their area, in voxels."""
    found = surface.triangles(image_voxels(spark, sf_dir), ["t"], LEVEL)
    return found.groupBy("t").agg(F.count("*").alias("triangles"), F.round(F.sum(surface.area(F.col("corners"))), 5).alias("area"))
