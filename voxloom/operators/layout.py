"""Between the layouts of a volume series. Only block <-> series moves data between tasks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Shape = tuple[int, int, int]  # nx, ny, nz
#: So many input values at most go to a kernel at once, or one row.
VALUES = 1 << 17


def demosaic(mosaic: Column, tile: int, tiles_per_side: int, slices: int) -> Column:
    """A square mosaic of slice tiles (row by row) as volume values, x fastest. Within a tile rows run against y."""
    width = tile * tiles_per_side

    def place(k: Column) -> Column:
        x, y, z = k % tile, F.floor(k / tile) % tile, F.floor(k / (tile * tile))
        return (F.floor(z / tiles_per_side) * tile + tile - 1 - y) * width + z % tiles_per_side * tile + x

    return F.transform(F.sequence(F.lit(0), F.lit(tile * tile * slices - 1)), lambda k: F.get(mosaic, place(k).cast("int")).cast("double"))


def voxels(blocks: DataFrame, shape: Shape, data: str = "data", value: str = "v") -> DataFrame:
    """Block rows as (other columns, z, y, x, value)."""
    nx, ny, _ = shape
    rest = [c for c in blocks.columns if c != data]
    rows = blocks.select(*rest, F.posexplode(data).alias("_k", value))
    k = F.col("_k")
    at = lambda c: F.floor(c).cast("int")
    return rows.select(*rest, at(k / (nx * ny)).alias("z"), at(k / nx % ny).alias("y"), (k % nx).alias("x"), value)


def _dense(entries: str, size: int, missing: Column) -> Column:
    """Sorted (at, value) entries as an array of ``size`` values in one pass: each entry brings the gap before it along."""
    before = lambda k: F.when(k > 0, F.get(F.col(entries), k - 1)["at"]).otherwise(-1)
    parts = F.transform(entries, lambda e, k: F.concat(F.array_repeat(missing, e["at"] - before(k) - 1), F.array(e["value"])))
    rest = F.array_repeat(missing, F.lit(size) - 1 - F.element_at(entries, -1)["at"])
    return F.concat(F.flatten(parts), rest)


def blocks(rows: DataFrame, shape: Shape, by: Sequence[str], value: str = "v") -> DataFrame:
    """Voxel rows as one block per ``by``; missing voxels are null. The group is one volume; a voxel that occurs twice in
    it fails the job."""
    nx, ny, nz = shape
    k = (F.col("x") + nx * (F.col("y") + ny * F.col("z"))).cast("int")
    kind = rows.schema[value].dataType
    packed = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(k.alias("at"), F.col(value).alias("value")))).alias("_e"))
    data = _dense("_e", nx * ny * nz, F.lit(None).cast(kind))
    whole = F.when(F.size(data) == nx * ny * nz, data).otherwise(F.raise_error(F.lit("a voxel lies outside the volume or occurs twice")).cast(data_type(kind)))
    return packed.select(*by, whole.alias("data"))


def data_type(kind: T.DataType) -> T.ArrayType:
    return T.ArrayType(kind)


def series(rows: DataFrame, by: Sequence[str], scan: str, value: Column, scans: int) -> DataFrame:
    """(by, series): one value per scan, 0 where there is none; values of a scan are summed before they are packed. Rows
    beyond the ``scans`` are left out."""
    sums = rows.filter(F.col(scan).between(0, scans - 1)).groupBy(*by, scan).agg(F.sum(value).alias("_v"))
    entry = F.struct(F.col(scan).cast("int").alias("at"), F.coalesce(F.col("_v").cast("double"), F.lit(0.0)).alias("value"))
    packed = sums.groupBy(*by).agg(F.sort_array(F.collect_list(entry)).alias("_e"))
    return packed.select(*by, _dense("_e", scans, F.lit(0.0)).alias("series"))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column without nulls whose rows have one length, as rows x values, from its buffer."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), -1)


def lists(values: np.ndarray) -> pa.Array:
    """Rows x values as a list column."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(values, dtype=float).ravel()))


def map_arrays(df: DataFrame, column: str, kernel: Callable[[np.ndarray], np.ndarray], to: str | None = None, values: int = VALUES) -> DataFrame:
    """``kernel`` on an array column, many rows at once: it gets rows x values and returns as many rows.

    Rows of different lengths go to the kernel apart. A null array or one with a null stays null. Long rows go to it in parts of
    some ``values`` values, so what it makes of a batch doesn't lie in memory as a whole."""
    to = to or column
    names = [c for c in df.columns if c != to]
    schema = T.StructType([*(df.schema[c] for c in names), T.StructField(to, T.ArrayType(T.DoubleType()))])

    def parts(batches):
        for b in batches:
            width = len(b.column(column).flatten()) / max(1, b.num_rows)
            some = int(max(1, values // max(1, width)))
            for k in range(0, max(1, b.num_rows), some):
                yield b.slice(k, some)

    def run(batches):
        for b in parts(batches):
            c = b.column(column)
            size = c.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            flat = c.flatten()
            ends = np.cumsum(np.maximum(size, 0))
            if flat.null_count:
                holes = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
                size = np.where(holes[ends] > holes[ends - np.maximum(size, 0)], -1, size)
            held = flat.to_numpy(zero_copy_only=False).astype(float, copy=False)
            lengths = np.unique(size[size >= 0])
            if len(lengths) == 1 and (size >= 0).all():
                out = lists(np.asarray(kernel(held.reshape(len(size), -1)), float))
            else:
                found: list = [None] * len(size)
                for n in lengths:
                    at = np.flatnonzero(size == n)
                    part = held[(ends[at] - n)[:, None] + np.arange(n)]
                    for k, r in zip(at, np.asarray(kernel(part), float), strict=True):
                        found[k] = r
                out = pa.array(found, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), out], names=[*names, to])

    return df.mapInArrow(run, schema)
