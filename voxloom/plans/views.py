"""Volume series read out of the available tables.

``image``: each embedding of 64 values is an 8 x 8 mosaic of four 4 x 4 slices, its id the scan. ``bold``: events per user
and hour, a voxel per user. ``slope``: line items as regression data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.operators import layout

SHAPE = (4, 4, 4)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, data): block rows."""
    rows = table(spark, sf_dir, "embeddings").filter(F.size("embedding") == 64)
    return rows.select(F.col("vec_id").alias("t"), layout.demosaic(F.col("embedding"), 4, 2, 4).alias("data"))


def image_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.voxels(image(spark, sf_dir), SHAPE)


IMAGE_SQL = """vox AS (
  SELECT vec_id AS t, CAST(((i // 8) // 4) * 2 + (i % 8) // 4 AS INTEGER) AS z, CAST(3 - (i // 8) % 4 AS INTEGER) AS y,
    CAST((i % 8) % 4 AS INTEGER) AS x, CAST(e AS DOUBLE) AS v
  FROM (SELECT vec_id, unnest(embedding) AS e, unnest(range(0, 64)) AS i FROM embeddings WHERE len(embedding) = 64)
)"""


def hours(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Events with ``scan``, hours since the first one, and the number of scans."""
    rows = table(spark, sf_dir, "events").filter(F.col("ts").isNotNull())
    first, last = rows.agg(F.min(F.unix_seconds(F.col("ts").cast("timestamp"))), F.max(F.unix_seconds(F.col("ts").cast("timestamp")))).first()
    origin = (first or 0) // 3600
    scan = (F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600) - origin).cast("long")
    return rows.withColumn("scan", scan), int((last or 0) // 3600 - origin + 1)


def bold(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """(voxel, series) and the number of scans."""
    rows, scans = hours(spark, sf_dir)
    rows = rows.filter(F.col("user_id").isNotNull()).select(F.col("user_id").alias("voxel"), "scan", "value")
    return layout.series(rows, ["voxel"], "scan", F.coalesce("value", F.lit(0.0)), scans), scans


BOLD_SQL = """ev AS (
  SELECT *, CAST(floor(epoch(ts) / 3600) - (SELECT floor(min(epoch(ts)) / 3600) FROM events) AS BIGINT) AS scan FROM events WHERE ts IS NOT NULL
), scans AS MATERIALIZED (SELECT unnest(range(0, (SELECT max(scan) + 1 FROM ev))) AS scan),
es AS (SELECT user_id, scan, sum(value) AS y FROM ev GROUP BY user_id, scan),
bold AS MATERIALIZED (
  SELECT u.voxel, s.scan, coalesce(e.y, 0) AS y
  FROM (SELECT DISTINCT user_id AS voxel FROM ev WHERE user_id IS NOT NULL) u CROSS JOIN scans s
  LEFT JOIN es e ON e.user_id = u.voxel AND e.scan = s.scan
)"""
