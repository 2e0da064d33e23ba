"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``; a local one only where that is unset and there is
    one machine only, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/voxloom-scratch"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """``df`` written as Parquet to the shared scratch folder and read again: lineage ends here, and a lost
    executor costs a re-read only."""
    path = scratch_dir(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def trimmed(batches: Iterator) -> Iterator:
    """The batches as they come; at the end a Python worker gives the memory that it has freed back to the machine, as it
    waits for further tasks beside the JVM of its executor."""
    yield from batches
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not a glibc system
        pass


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col(f"`{name.replace('`', '``')}`")


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(modulus))


def bounded_sample(df: DataFrame, keys: list[str], limit: int, seed: int) -> DataFrame:
    """About ``limit`` rows of ``df`` (all, if fewer), picked by a hash of ``keys``: the same rows however the
    table is partitioned. Used only where a model is fitted; ``limit`` is the documented bound."""
    n = df.count()
    if n <= limit:
        return df
    share = int(limit / n * 1_000_000)
    return df.filter(F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) for k in keys]), F.lit(1_000_000)) < share)
