"""All registered queries of the volumetric engine, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxloom.plans import file_queries, header_queries, image_queries, mask_queries, model_queries, series_queries, table_queries, volume_queries

PARTS = (image_queries, series_queries, model_queries, table_queries, mask_queries, header_queries, file_queries, volume_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for part in PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, fit and test every voxel's series against one task regressor."""
    return model_queries.first_level(spark, sf_dir)
