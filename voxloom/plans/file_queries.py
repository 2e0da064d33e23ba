"""Queries that write files or tables and read them again, and fits whose results have a closed form."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.operators import glm, headers, layout, registration, segment, spatial
from voxloom.plans.image_queries import AT, kernel_voxels
from voxloom.plans.header_queries import _affine_rows, _entries_sql
from voxloom.plans.views import BOLD_SQL, IMAGE_SQL, SHAPE, bold, image, table
from voxloom.session import scratch
from voxloom.sources import dicom, motion, nifti

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


@query(f"WITH {IMAGE_SQL} SELECT t // 8 AS image, CAST(t % 8 AS INTEGER) AS t, z, y, x, round(round((v - 0.5) / 0.001) * 0.001 + 0.5, 4) + 0 AS v FROM vox WHERE t // 8 IN (SELECT t // 8 FROM vox GROUP BY t // 8 HAVING count(*) = 512)")
def nifti_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of eight volumes as 16-bit files with a scale, decoded again."""
    rows = image(spark, sf_dir).select(F.floor(F.col("t") / 8).alias("image"), (F.col("t") % 8).alias("t"), "data")
    whole = rows.groupBy("image").count().filter("count = 8").select("image")

    def files(group: pa.Table) -> pa.Table:
        group = group.sort_by("t")
        name = group.column("image")[0].as_py()
        raw = nifti.encode(layout.matrix(group.column("data")), SHAPE, np.eye(4), datatype=4, slope=0.001, inter=0.5)
        return pa.table({"path": [str(name)], "content": pa.array([raw], pa.binary())})

    found = nifti.decoded(rows.join(whole, "image", "left_semi").groupBy("image").applyInArrow(files, "path string, content binary"))
    return layout.voxels(found.select(F.col("image_id").cast("long").alias("image"), "t", "data"), SHAPE).select("image", "t", "z", "y", "x", (F.round("v", 4) + 0).alias("v"))


_Q = ["0.1 * s / 50", "-0.2", "0.3"]
_A = f"sqrt(1 - ({_Q[0]}) ** 2 - 0.04 - 0.09)"


def _quaternion_sql() -> list[list[str]]:
    b, c, d, a = f"({_Q[0]})", "(-0.2)", "0.3", _A
    return [
        [f"({a}*{a} + {b}*{b} - {c}*{c} - {d}*{d}) * 2", f"2*({b}*{c} - {a}*{d}) * 3", f"-2*({b}*{d} + {a}*{c}) * 4", "-s"],
        [f"2*({b}*{c} + {a}*{d}) * 2", f"({a}*{a} + {c}*{c} - {b}*{b} - {d}*{d}) * 3", f"-2*({c}*{d} - {a}*{b}) * 4", "5"],
        [f"2*({b}*{d} - {a}*{c}) * 2", f"2*({c}*{d} + {a}*{b}) * 3", f"-({a}*{a} + {d}*{d} - {b}*{b} - {c}*{c}) * 4", "0.5"],
    ]


@query("WITH h AS (SELECT p_partkey, p_size AS s FROM part) " + _entries_sql(_quaternion_sql(), "h", "p_partkey").replace(", 6) + 0", ", 3) + 0"))
def quaternion_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers with a quaternion, from their bytes to affines."""
    import struct

    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size")

    def affines(batches):
        for b in batches:
            out = []
            for size in b.column("p_size").to_pylist():
                raw = bytearray(nifti.encode(np.zeros(1), (1, 1, 1), np.eye(4)))
                struct.pack_into("<2h", raw, 252, 1, 0)
                struct.pack_into("<4f", raw, 76, -1.0, 2.0, 3.0, 4.0)
                struct.pack_into("<6f", raw, 256, 0.1 * size / 50, -0.2, 0.3, -size, 5.0, 0.5)
                out.append(nifti.affine_of(nifti.header(bytes(raw))).ravel())
            yield pa.RecordBatch.from_arrays([b.column("p_partkey"), layout.lists(np.array(out).reshape(-1, 16))], ["key", "affine"])

    found = rows.mapInArrow(affines, "key long, affine array<double>").withColumnRenamed("key", "p_partkey")
    return _affine_rows(found, "p_partkey", F.col("affine")).withColumn("v", F.round("v", 3) + 0)


@query("""SELECT o_custkey % 20 AS subject, CAST(row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey) - 1 AS INTEGER) AS t, round(o_totalprice / 7, 4) AS tx, round(-o_totalprice / 11, 4) AS rz FROM orders""")
def motion_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Motion of all subjects as text files, read again."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(F.col("o_custkey") % 20).orderBy("o_orderkey")
    price, zero = F.col("o_totalprice"), F.lit(0.0)
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("subject"), (F.row_number().over(w) - 1).alias("t"), (price / 7).alias("tx"), *[zero.alias(n) for n in ("ty", "tz", "rx", "ry")], (-price / 11).alias("rz"))
    path = scratch(spark)
    motion.write(rows, path)
    found = motion.read(spark, path)
    return found.select(F.col("subject").cast("long").alias("subject"), F.col("t").cast("int").alias("t"), F.round("tx", 4).alias("tx"), F.round("rz", 4).alias("rz"))


@query("""WITH e AS (SELECT vec_id, vec_id // 8 AS series, unnest(embedding) AS v, unnest(range(0, 64)) AS i FROM embeddings WHERE len(embedding) = 64),
s AS (SELECT vec_id, row_number() OVER (PARTITION BY vec_id // 8 ORDER BY vec_id DESC) - 1 AS z FROM embeddings WHERE len(embedding) = 64)
SELECT series, CAST(z AS INTEGER) AS z, CAST(7 - i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, round(CAST(v AS DOUBLE) * 8000) + 0 AS v FROM e JOIN s USING (vec_id)""")
def dicom_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of several series as files in any order, stacked by their place along the normal."""
    rows = table(spark, sf_dir, "embeddings").filter(F.size("embedding") == 64).select("vec_id", "embedding")

    def files(batches):
        for b in batches:
            pixels = np.round(layout.matrix(b.column("embedding")).astype(np.float32).astype(float) * 8000).reshape(-1, 8, 8)
            out = []
            for k, p in zip(b.column("vec_id").to_pylist(), pixels, strict=True):
                tags = {0x0020000E: (b"UI", b"1.%d" % (k // 8)), 0x00200032: (b"DS", b"0\\0\\%d" % -k), 0x00200037: (b"DS", b"1\\0\\0\\0\\1\\0"), 0x00280030: (b"DS", b"2\\2")}
                out.append(dicom.encode(p, tags))
            yield pa.RecordBatch.from_arrays([pa.array([f"/t1/{k}" for k in b.column("vec_id").to_pylist()]), pa.array(out, pa.binary())], ["path", "content"])

    found = dicom.stacked(dicom.headers(rows.mapInArrow(files, "path string, content binary")))
    long = found.select(F.substring("series", 3, 20).cast("long").alias("series"), F.posexplode("data").alias("k", "v"))
    at = lambda c: F.floor(c).cast("int")
    return long.select("series", at(F.col("k") / 64).alias("z"), at(F.col("k") / 8 % 8).alias("y"), (F.col("k") % 8).alias("x"), "v")


@query(f"""WITH {IMAGE_SQL}, k AS (SELECT *, CASE WHEN z > t % 4 THEN 0 ELSE v END AS w FROM vox) SELECT t, z, y, x, w AS v FROM k WHERE z <= t % 4""")
def trimmed_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes without their empty slices at the end."""
    inside = F.transform("data", lambda v, k: F.when(F.floor(k / 16) <= F.col("t") % 4, v).otherwise(0.0))
    rows = image(spark, sf_dir).select("t", inside.alias("data"))
    return layout.voxels(rows.select("t", dicom.trimmed(F.col("data"), 16, 4).alias("data")), SHAPE).select(*AT, "v")


@query(f"""WITH {IMAGE_SQL}, w(k, lo, f) AS (VALUES (0, 0, 0.0), (1, 1, 0.0), (2, 1, 0.5), (3, 2, 0.0), (4, 2, 0.5), (5, 3, 0.0))
SELECT a.t, CAST(k AS INTEGER) AS z, a.y, a.x, round(a.v * (1 - f) + coalesce(b.v, 0) * f, 6) + 0 AS v FROM w JOIN vox a ON a.z = w.lo LEFT JOIN vox b ON b.t = a.t AND b.y = a.y AND b.x = a.x AND b.z = w.lo + 1""")
def even_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stacks with slices at 0, 1, 3 and 5 mm, interpolated to every millimetre."""
    return kernel_voxels(spark, sf_dir, dicom.evenly_spaced([0.0, 1.0, 3.0, 5.0]), (4, 4, 6), digits=6).withColumn("v", F.col("v") + 0)


@query(f"""WITH {IMAGE_SQL}, p AS (SELECT t, z, y, x, least(x + 0.5, 3) AS px, greatest(y - 0.25, 0) AS py FROM vox), c(dx, dy) AS (VALUES (0, 0), (1, 0), (0, 1), (1, 1)),
l AS (SELECT *, least(floor(px), 2) AS lx, least(floor(py), 2) AS ly FROM p)
SELECT l.t, l.z, l.y, l.x, round(sum(s.v * CASE dx WHEN 1 THEN px - lx ELSE 1 - (px - lx) END * CASE dy WHEN 1 THEN py - ly ELSE 1 - (py - ly) END), 5) + 0 AS v
FROM l CROSS JOIN c JOIN vox s ON s.t = l.t AND s.z = l.z AND s.x = lx + dx AND s.y = ly + dy GROUP BY l.t, l.z, l.y, l.x""")
def pulled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes at displaced positions, which are kept inside."""
    u = np.zeros((3, 4, 4, 4))
    u[0], u[1] = 0.5, -0.25
    return kernel_voxels(spark, sf_dir, lambda flat: registration.pull(flat.reshape(-1, 4, 4, 4), u).reshape(len(flat), -1))


_SHRUNK = "(power(1 - s / 64, 64) - 1)"


@query(f"""WITH {IMAGE_SQL}, g AS (SELECT t, z, y, x, least(0.4, abs(avg(v) OVER (PARTITION BY t)) * 8) AS s FROM vox)
SELECT t, z, y, x, round({_SHRUNK} * x, 6) + 0 AS ux, round({_SHRUNK} * x + (1 + {_SHRUNK}) * -0.1 * x, 6) + 0 AS both FROM g""")
def integrated_warp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The displacement of a velocity that shrinks x as much as each volume's mean says, by squaring, and after another
    displacement; both have a closed form."""
    x = spatial.grid(SHAPE)[:, 0].reshape(4, 4, 4)

    def kernel(flat):
        out, second = [], np.zeros((3, 4, 4, 4))
        second[0] = -0.1 * x
        for share in np.minimum(0.4, np.abs(flat.mean(1)) * 8):
            v = np.zeros((3, 4, 4, 4))
            v[0] = -share * x
            u = registration.integrate(v, 6)
            out.append(np.concatenate([u[0].ravel(), registration.compose(u, second)[0].ravel()]))
        return np.array(out).reshape(len(flat), 128)

    moved = layout.map_arrays(image(spark, sf_dir), "data", kernel)
    halves = F.arrays_zip(F.slice("data", 1, 64).alias("ux"), F.slice("data", 65, 64).alias("both"))
    return layout.voxels(moved.select("t", halves.alias("data")), SHAPE).select(*AT, (F.round("v.ux", 6) + 0).alias("ux"), (F.round("v.both", 6) + 0).alias("both"))


_RIGID = [
    ["cos(c) * cos(b)", "cos(c) * sin(b) * sin(a) - sin(c) * cos(a)", "cos(c) * sin(b) * cos(a) + sin(c) * sin(a)", "s"],
    ["sin(c) * cos(b)", "sin(c) * sin(b) * sin(a) + cos(c) * cos(a)", "sin(c) * sin(b) * cos(a) - cos(c) * sin(a)", "-2 * s"],
    ["-sin(b)", "cos(b) * sin(a)", "cos(b) * cos(a)", "0.5"],
]


@query("WITH h AS (SELECT p_partkey, p_size AS s, p_size / 100.0 AS a, -p_size / 50.0 AS b, 0.3 AS c FROM part) " + _entries_sql(_RIGID, "h", "p_partkey"))
def rigid_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matrices of rigid motions."""
    s = F.col("p_size")
    return _affine_rows(table(spark, sf_dir, "part"), "p_partkey", headers.rigid([s, -2 * s, F.lit(0.5), s / 100, -s / 50, F.lit(0.3)]))


_NEAR = "CASE WHEN abs(l_quantity - 10) <= abs(l_quantity - 25) AND abs(l_quantity - 10) <= abs(l_quantity - 40) THEN 0 WHEN abs(l_quantity - 25) <= abs(l_quantity - 40) THEN 1 ELSE 2 END"


@query(f"""WITH c AS (SELECT {_NEAR} AS k, avg(l_extendedprice) AS mean, stddev_samp(l_extendedprice) + 0.001 AS sd, count(*) AS n FROM lineitem GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY mean) - 1 AS INTEGER) AS rank, round(mean, 4) AS mean, round(sd, 4) AS sd, round(n / (SELECT count(*) FROM lineitem), 8) AS share FROM c""")
def class_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes by rising mean with their spread and share."""
    from pyspark.sql.window import Window

    lines = table(spark, sf_dir, "lineitem")
    total = lines.count()
    found = lines.groupBy(segment.nearest(F.col("l_quantity"), [10.0, 25.0, 40.0]).alias("k")).agg(F.avg("l_extendedprice").alias("mean"), (F.stddev_samp("l_extendedprice") + 0.001).alias("sd"), F.count("*").alias("n"))
    rank = F.row_number().over(Window.orderBy("mean")) - 1  # a row per class
    return found.select(rank.alias("rank"), F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), F.round(F.col("n") / total, 8).alias("share"))


@query(f"""WITH {BOLD_SQL}, c AS (SELECT voxel, sum(y * scan) / sum(y * y) AS b FROM bold GROUP BY voxel HAVING sum(y * y) > 0)
SELECT voxel, scan, round(scan - b * y, 5) + 0 AS orthogonal FROM bold JOIN c USING (voxel)""")
def orthogonal_regressors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drift less what each user's own course explains, in the tasks that hold the courses."""
    rows, n = bold(spark, sf_dir)
    kernel = lambda flat: np.array([glm.orthogonalised(np.stack([y, np.arange(n, dtype=float)], 1))[:, 1] for y in flat]).reshape(len(flat), n)
    found = layout.map_arrays(rows.filter(F.exists("series", lambda v: v != 0)), "series", kernel)
    return found.select("voxel", F.posexplode("series").alias("scan", "v")).select("voxel", F.col("scan").cast("long").alias("scan"), (F.round("v", 5) + 0).alias("orthogonal"))


@query(f"""WITH {BOLD_SQL}, h AS (SELECT count(*) // 2 AS h FROM scans), m AS (SELECT voxel, CASE WHEN scan < h THEN 0 ELSE 1 END AS session, scan, y FROM bold CROSS JOIN h), c(session, name, col) AS (VALUES (0, 's1:task', 0), (0, 's1:constant', 1), (1, 's2:task', 2), (1, 's2:constant', 3))
SELECT voxel, m.scan, name, round(CASE WHEN m.session <> c.session THEN 0 WHEN col % 2 = 1 THEN 1 ELSE y END, 4) + 0 AS value FROM m CROSS JOIN c""")
def session_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sessions of each user's course side by side in one design."""
    rows, n = bold(spark, sf_dir)
    names = ["s1:task", "s1:constant", "s2:task", "s2:constant"]

    def kernel(flat):
        halves = lambda y: [(np.stack([part, np.ones(len(part))], 1), ["task", "constant"]) for part in (y[: n // 2], y[n // 2 :])]
        return np.array([glm.sessions(halves(y))[0].ravel() for y in flat]).reshape(len(flat), 4 * n)

    found = layout.map_arrays(rows, "series", kernel).select("voxel", F.posexplode("series").alias("k", "v"))
    return found.select("voxel", F.floor(F.col("k") / 4).cast("long").alias("scan"), F.array(*map(F.lit, names))[F.col("k") % 4].alias("name"), (F.round("v", 4) + 0).alias("value"))


@query(f"""WITH {BOLD_SQL}, n AS (SELECT voxel, sum(y) AS st, sum(y * y) AS tt, count(*) AS n FROM bold GROUP BY voxel)
SELECT voxel, scan, round((tt - 2 * y * st + n * y * y) / (n * tt - st * st), 8) + 0 AS leverage FROM bold JOIN n USING (voxel) WHERE n * tt - st * st > 1e-9 * n * tt""")
def sample_leverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much each scan informs a fit of a user's course and a constant."""
    rows, n = bold(spark, sf_dir)
    varied = F.size(F.array_distinct("series")) > 1
    found = layout.map_arrays(rows.filter(varied), "series", lambda flat: np.array([glm.leverage(np.stack([y, np.ones(n)], 1)) for y in flat]).reshape(len(flat), n))
    return found.select("voxel", F.posexplode("series").alias("scan", "v")).select("voxel", F.col("scan").cast("long").alias("scan"), (F.round("v", 8) + 0).alias("leverage"))
