"""Queries over the time-series view."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions.scalar import gamma_pdf
from voxloom.operators import glm, layout, relational, temporal
from voxloom.plans.views import BOLD_SQL, IMAGE_SQL, bold, hours, image_voxels
from voxloom.session import settled

QUERIES, SQL = {}, {}
TR, CUTOFF = 3600.0, 3600.0 * 96


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def long(rows: DataFrame, keys: list[str], digits: int = 4, to: str = "y") -> DataFrame:
    return rows.select(*keys, F.posexplode("series").alias("scan", to)).select(*keys, F.col("scan").cast("long").alias("scan"), F.round(to, digits).alias(to))


@query(f"WITH {BOLD_SQL} SELECT voxel, scan, round(y, 4) + 0 AS y FROM bold")
def voxel_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(bold(spark, sf_dir)[0], ["voxel"])


BASIS_SQL = f"""b AS MATERIALIZED (SELECT s.scan, k.k, sqrt(2.0 / n.n) * cos(pi() * (2 * s.scan + 1) * k.k / (2.0 * n.n)) AS b
  FROM scans s CROSS JOIN (SELECT count(*) AS n FROM scans) n CROSS JOIN (SELECT unnest(range(1, CAST(floor(2 * (SELECT count(*) FROM scans) * {TR} / {CUTOFF} + 1) AS BIGINT))) AS k) k)"""


@query(f"WITH {BOLD_SQL}, {BASIS_SQL} SELECT scan, k, round(b, 6) AS b FROM b")
def dct_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = hours(spark, sf_dir)[1]
    basis = temporal.dct_basis(n, TR, CUTOFF)
    k = spark.range(n).select(F.col("id").alias("scan"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(basis.shape[1]).cast("long"))).alias("k"))
    return k.select("scan", "k", F.round(math.sqrt(2 / n) * F.cos(math.pi * (2 * F.col("scan") + 1) * F.col("k") / (2 * n)), 6).alias("b"))


@query(f"""WITH {BOLD_SQL}, {BASIS_SQL}, y AS MATERIALIZED (SELECT voxel, list(y ORDER BY scan) AS y FROM bold GROUP BY voxel),
w AS MATERIALIZED (SELECT k, list(b ORDER BY scan) AS w FROM b GROUP BY k), r AS MATERIALIZED (SELECT scan, list(b ORDER BY k) AS r FROM b GROUP BY scan),
c AS MATERIALIZED (SELECT voxel, list(list_dot_product(y, w) ORDER BY k) AS c, any_value(y) AS y FROM y CROSS JOIN w GROUP BY voxel)
SELECT voxel, scan, round(y[scan + 1] - list_dot_product(c, r), 4) + 0 AS y FROM c CROSS JOIN r""")
def highpass(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, n = bold(spark, sf_dir)
    return long(layout.map_arrays(rows, "series", temporal.high_pass(n, TR, CUTOFF)), ["voxel"])


RHO_SQL = f"""r AS (SELECT voxel, sum(y * p) / (sum(p * p) + 2.220446049250313e-16) AS rho FROM (
  SELECT voxel, y, lag(y) OVER (PARTITION BY voxel ORDER BY scan) AS p FROM bold) WHERE p IS NOT NULL GROUP BY voxel)"""


@query(f"WITH {BOLD_SQL}, {RHO_SQL} SELECT voxel, round(rho, 6) AS rho FROM r")
def ar1_rho(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bold(spark, sf_dir)[0].select("voxel", F.round(temporal.lag1(F.col("series")), 6).alias("rho"))


@query(f"""WITH {BOLD_SQL}, {RHO_SQL}, g AS (SELECT greatest(-0.5, least(0.95, median(rho))) AS rho FROM r),
l AS (SELECT voxel, scan, y, lag(y) OVER (PARTITION BY voxel ORDER BY scan) AS p FROM bold)
SELECT voxel, scan, round(CASE WHEN p IS NULL THEN y * sqrt(1 - rho * rho) ELSE y - rho * p END, 4) + 0 AS y FROM l CROSS JOIN g""")
def ar1_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = settled(bold(spark, sf_dir)[0])  # read twice: for the autocorrelation, and to be whitened
    return long(rows.select("voxel", temporal.whiten(F.col("series"), temporal.global_rho(rows)).alias("series")), ["voxel"])


def _short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image voxels as series of sixteen scans."""
    rows = image_voxels(spark, sf_dir).select(F.floor(F.col("t") / 16).alias("run"), "z", "y", "x", (F.col("t") % 16).alias("scan"), "v")
    return layout.series(rows, ["run", "z", "y", "x"], "scan", F.col("v"), 16)


@query(f"""WITH {IMAGE_SQL}, s AS (SELECT t // 16 AS run, z, y, x, t % 16 AS scan, v FROM vox),
full_ AS (SELECT k.run, k.z, k.y, k.x, n.n AS scan, coalesce(s.v, 0) AS v FROM (SELECT DISTINCT run, z, y, x FROM s) k CROSS JOIN (SELECT unnest(range(0, 16)) AS n) n
  LEFT JOIN s ON s.run = k.run AND s.z = k.z AND s.y = k.y AND s.x = k.x AND s.scan = n.n),
f AS (SELECT run, z, y, x, q.q, sum(v * cos(2 * pi() * q.q * scan / 16)) AS re, -sum(v * sin(2 * pi() * q.q * scan / 16)) AS im
  FROM full_ CROSS JOIN (SELECT unnest(range(0, 9)) AS q) q GROUP BY run, z, y, x, q.q)
SELECT run, z, y, x, n.n AS scan, round(sum(CASE WHEN q = 0 THEN 1 WHEN q = 8 THEN 1 ELSE 2 END / 16.0 *
  CASE WHEN q = 8 THEN re * cos(2 * pi() * q * 0.15) * cos(pi() * n.n) ELSE re * cos(2 * pi() * q * (n.n - 2.4) / 16) - im * sin(2 * pi() * q * (n.n - 2.4) / 16) END), 4) + 0 AS v
FROM f CROSS JOIN (SELECT unnest(range(0, 16)) AS n) n GROUP BY run, z, y, x, n.n""")
def fourier_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every series 2.4 scans later."""
    moved = layout.map_arrays(_short(spark, sf_dir), "series", temporal.fourier_shift(2.4, 1.0))
    return long(moved, ["run", "z", "y", "x"], to="v")


TASK_SQL = "event_type = (SELECT min(event_type) FROM events)"


def _onsets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """One event type: onset in hours with a duration of 1.5 hours."""
    rows, n = hours(spark, sf_dir)
    first = rows.agg(F.min("event_type")).first()[0]
    origin = F.lit(rows.agg(F.min(F.unix_seconds(F.col("ts").cast("timestamp")))).first()[0] // 3600)
    onset = (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000) / 60 - origin).alias("onset")
    return rows.filter(F.col("event_type") == first).select(onset, F.lit(1.5).alias("duration")), n


@query(f"""WITH {BOLD_SQL}, o AS (SELECT floor(epoch(ts) / 60) / 60 - (SELECT floor(min(epoch(ts)) / 3600) FROM events) AS s FROM events WHERE {TASK_SQL})
SELECT scans.scan, count(o.s) AS hits FROM scans LEFT JOIN o ON scans.scan >= o.s AND scans.scan < o.s + 1.5 GROUP BY scans.scan""")
def boxcar_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, n = _onsets(spark, sf_dir)
    return glm.boxcar(spark.range(n).withColumnRenamed("id", "scan"), events)


@query("""WITH t AS (SELECT i, i * 0.125 AS t FROM (SELECT unnest(range(0, 257)) AS i)),
h AS (SELECT i, t, CASE WHEN t > 0 THEN t ** 5 * exp(-t) / gamma(6) - t ** 15 * exp(-t) / gamma(16) / 6 ELSE 0 END AS h FROM t)
SELECT i, t, round(h / (SELECT max(h) FROM h), 6) AS h FROM h""")
def hrf_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.range(257).select(F.col("id").alias("i"), (F.col("id") * 0.125).alias("t"))
    h = t.select("i", "t", (gamma_pdf(F.col("t"), 6) - gamma_pdf(F.col("t"), 16) / 6).alias("h"))
    top = h.agg(F.max("h")).first()[0]
    return h.select("i", "t", F.round(F.col("h") / top, 6).alias("h"))


@query(f"""WITH {BOLD_SQL}, o AS (SELECT floor(epoch(ts) / 60) / 60 - (SELECT floor(min(epoch(ts)) / 3600) FROM events) AS s FROM events WHERE {TASK_SQL}),
box AS MATERIALIZED (SELECT m, count(*) AS hits FROM (SELECT unnest(range(CAST(ceil(s * 16) AS BIGINT), CAST(ceil((s + 1.5) * 16) AS BIGINT))) AS m FROM o) GROUP BY m),
ht AS (SELECT i, i * 0.125 AS t FROM (SELECT unnest(range(0, 257)) AS i)), hc AS (SELECT i, CASE WHEN t > 0 THEN t ** 5 * exp(-t) / gamma(6) - t ** 15 * exp(-t) / gamma(16) / 6 ELSE 0 END AS h FROM ht),
h AS MATERIALIZED (SELECT i, h / (SELECT max(h) FROM hc) AS h FROM hc), n AS MATERIALIZED (SELECT count(*) AS n FROM scans),
task AS (SELECT s.scan, coalesce(sum(h.h * box.hits), 0) * 0.125 AS v FROM scans s CROSS JOIN h LEFT JOIN box ON box.m = s.scan * 16 + 7 - h.i GROUP BY s.scan)
SELECT CAST(scan AS INTEGER) AS scan, 0 AS col, 'Task' AS name, round(v, 6) + 0 AS value FROM task UNION ALL SELECT CAST(scan AS INTEGER), 1, 'constant', 1.0 FROM scans
UNION ALL SELECT CAST(s.scan AS INTEGER), CAST(1 + k.k AS INTEGER), 'drift' || k.k, round(sqrt(2.0 / n.n) * cos(pi() * (2 * s.scan + 1) * k.k / (2.0 * n.n)), 6) + 0 FROM scans s CROSS JOIN n
  CROSS JOIN (SELECT unnest(range(1, CAST(floor(2 * (SELECT n FROM n) * 2.0 / 128 + 1) AS BIGINT))) AS k) k""")
def design_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the design of one event type over all hours, as (scan, col, name, value). An hour stands for a scan of
    2 s, as a response is over long before an hour of true time."""
    events, n = _onsets(spark, sf_dir)
    micro = events.select((F.col("onset") * glm.MICRO).alias("onset"), (F.col("duration") * glm.MICRO).alias("duration"))
    rows = glm.boxcar(spark.range(n * glm.MICRO).withColumnRenamed("id", "scan"), micro).filter("hits > 0").collect()  # a value per step
    box = np.zeros(n * glm.MICRO)
    box[[r["scan"] for r in rows]] = [r["hits"] for r in rows]
    x, names = glm.design({}, n, 2.0, cutoff=128.0)
    x, names = np.column_stack([glm.convolved(box, n, 2.0), x]), ["Task", *names]
    rows = [(int(s), int(c), names[c], float(np.round(x[s, c], 6)) + 0.0) for s in range(x.shape[0]) for c in range(x.shape[1])]
    return spark.createDataFrame(rows, "scan int, col int, name string, value double")


@query("""WITH e AS (SELECT event_id, minute(ts) AS m FROM events WHERE ts IS NOT NULL), p(k, p) AS (VALUES (0, 0.0), (1, 17.5), (2, 35.0), (3, 52.5)),
r AS (SELECT event_id, k, row_number() OVER (PARTITION BY event_id ORDER BY abs(m - p), k) AS n FROM e CROSS JOIN p) SELECT event_id, k FROM r WHERE n = 1""")
def nearest_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxloom.plans.views import table

    rows = table(spark, sf_dir, "events").filter(F.col("ts").isNotNull())
    return rows.select("event_id", relational.nearest_index(F.minute("ts"), (0.0, 17.5, 35.0, 52.5)).alias("k"))


@query("""WITH l AS (SELECT user_id, event_id, event_type, ts, CASE WHEN lag(event_id) OVER w IS NOT NULL AND event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS n
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT user_id, event_type, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS run FROM l) SELECT user_id, run, event_type, count(*) AS n FROM r GROUP BY user_id, run, event_type""")
def changepoint_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxloom.plans.views import table

    rows = relational.runs(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return rows.groupBy("user_id", "run", "event_type").agg(F.count("*").alias("n"))


@query(f"""WITH {BOLD_SQL}, n AS (SELECT count(*) AS n FROM scans) SELECT s.scan, k.k, round(cos(pi() * s.scan * k.k / n.n), 6) + 0 AS b FROM scans s CROSS JOIN n
CROSS JOIN (SELECT unnest(range(1, CAST(floor(2 * (SELECT n FROM n) * {TR} / {CUTOFF} + 1) AS BIGINT))) AS k) k""")
def drift_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift columns without the half-sample offset."""
    n = hours(spark, sf_dir)[1]
    basis = temporal.dct_basis(n, TR, CUTOFF, legacy=True)
    rows = [(s, k + 1, float(round(basis[s, k], 6)) + 0.0) for s in range(n) for k in range(basis.shape[1])]
    return spark.createDataFrame(rows, "scan long, k long, b double")


@query(f"""WITH {IMAGE_SQL}, w AS (SELECT DISTINCT t // 16 AS run FROM vox GROUP BY t // 16 HAVING count(DISTINCT t) = 16), s AS (SELECT t // 16 AS run, z, y, x, t % 16 AS scan, v FROM vox WHERE t // 16 IN (SELECT run FROM w)),
e AS (SELECT run, z, y, x, max(v) FILTER (scan = 0) AS first, max(v) FILTER (scan = 15) AS last FROM s GROUP BY run, z, y, x),
p AS (SELECT * FROM s UNION ALL SELECT run, z, y, x, 15 + j.j, last + (first - last) * j.j / 17.0 FROM e CROSS JOIN (SELECT unnest(range(1, 17)) AS j) j),
f AS (SELECT run, z, y, x, q.q, sum(v * cos(2 * pi() * q.q * scan / 32)) AS re, -sum(v * sin(2 * pi() * q.q * scan / 32)) AS im FROM p CROSS JOIN (SELECT unnest(range(0, 17)) AS q) q GROUP BY run, z, y, x, q.q)
SELECT run, z, y, x, n.n AS scan, round(sum(CASE WHEN q = 0 THEN 1 WHEN q = 16 THEN 1 ELSE 2 END / 32.0 *
  CASE WHEN q = 16 THEN re * cos(pi() * 2.4) * cos(pi() * n.n) ELSE re * cos(2 * pi() * q * (n.n - 2.4) / 32) - im * sin(2 * pi() * q * (n.n - 2.4) / 32) END), 4) + 0 AS v
FROM f CROSS JOIN (SELECT unnest(range(0, 16)) AS n) n GROUP BY run, z, y, x, n.n""")
def fourier_shift_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole series 2.4 scans later, its ends joined by a ramp."""
    rows = image_voxels(spark, sf_dir).select(F.floor(F.col("t") / 16).alias("run"), "z", "y", "x", (F.col("t") % 16).alias("scan"), "v")
    whole = rows.select("run", "scan").distinct().groupBy("run").count().filter("count = 16").select("run")
    moved = layout.map_arrays(layout.series(rows.join(whole, "run", "left_semi"), ["run", "z", "y", "x"], "scan", F.col("v"), 16), "series", temporal.fourier_shift(2.4, 1.0, "ramp"))
    return long(moved, ["run", "z", "y", "x"], to="v")
