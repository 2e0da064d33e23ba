"""Header geometry as columns: affines are arrays of 16 numbers, row by row, from 0-based voxels to mm."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entry(affine: Column, row: int, col: int) -> Column:
    return F.get(affine, F.lit(4 * row + col))


def affine_column(rows: list[list]) -> Column:
    """Three rows of four numbers or columns, closed by 0 0 0 1."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.array(*[lit(v).cast("double") for r in [*rows, [0, 0, 0, 1]] for v in r])


def default_affine(dim, pixdim) -> np.ndarray:
    """Spacings on the diagonal, the middle of the volume at 0: what a header without an orientation gets."""
    d, n = np.asarray(pixdim, float)[:3], np.asarray(dim, float)[:3]
    out = np.diag([*d, 1.0])
    out[:3, 3] = -d * n / 2
    return out


def analyze_affine(pixdim: list[Column], origin: list[Column]) -> Column:
    """Of an Analyze header: the originator's voxel (from 1) lies at 0 and x runs from right to left; with an originator of
    zeros only the spacings count."""
    dx, dy, dz = pixdim
    ox, oy, oz = origin
    placed = affine_column([[-dx, 0, 0, dx * ox], [0, dy, 0, -dy * (oy - 1)], [0, 0, dz, -dz * (oz - 1)]])
    plain = affine_column([[dx, 0, 0, 0], [0, dy, 0, 0], [0, 0, dz, 0]])
    return F.when((ox == 0) & (oy == 0) & (oz == 0), plain).otherwise(placed)


def product(left: Column | np.ndarray, right: Column | np.ndarray) -> Column:
    """Product of two affines, either of them fixed."""
    at = lambda m, i, j: F.lit(float(m[i][j])) if isinstance(m, np.ndarray) else entry(m, i, j)
    return F.array(*[sum((at(left, i, k) * at(right, k, j) for k in range(1, 4)), at(left, i, 0) * at(right, 0, j)) for i in range(4) for j in range(4)])


def rigid(p: list[Column]) -> Column:
    """The affine of (tx, ty, tz, rx, ry, rz): turns about x, then y, then z, then the shift."""
    tx, ty, tz, rx, ry, rz = p
    cx, sx, cy, sy, cz, sz = F.cos(rx), F.sin(rx), F.cos(ry), F.sin(ry), F.cos(rz), F.sin(rz)
    return affine_column([[cz * cy, cz * sy * sx - sz * cx, cz * sy * cx + sz * sx, tx], [sz * cy, sz * sy * sx + cz * cx, sz * sy * cx - cz * sx, ty], [-sy, cy * sx, cy * cx, tz]])


def with_origin(affine: Column, dim: list[Column], point: list[Column]) -> Column:
    """The affine with another shift, which puts the voxel ``point`` (from 1) at 0 mm; a point outside of the volume is
    replaced by the middle. Voxel values stay as they are."""
    inside = (point[0] >= 1) & (point[0] <= dim[0]) & (point[1] >= 1) & (point[1] <= dim[1]) & (point[2] >= 1) & (point[2] <= dim[2])
    at = [F.when(inside, p).otherwise(F.round(n / 2)) - 1 for p, n in zip(point, dim, strict=True)]
    shift = [-sum((entry(affine, i, j) * at[j] for j in (1, 2)), entry(affine, i, 0) * at[0]) for i in range(3)]
    return affine_column([[entry(affine, i, 0), entry(affine, i, 1), entry(affine, i, 2), shift[i]] for i in range(3)])


def dicom_affine(row: list[Column], col: list[Column], position: list[Column], spacing: list[Column], slices: float, rows: Column, mosaic: tuple[Column, Column] | None = None) -> Column:
    """From direction cosines along rows and columns, position and spacings (between columns, between rows, between slices)
    in the patient's left-posterior-superior axes to voxel -> right-anterior-superior mm.

    ``mosaic``: rows and columns of a mosaic; its position belongs to the corner of the mosaic and moves to that of a
    tile. Voxel rows run against the file's, as the arrays do."""
    normal = [row[1] * col[2] - row[2] * col[1], row[2] * col[0] - row[0] * col[2], row[0] * col[1] - row[1] * col[0]]
    sx, sy, sz = spacing
    start = position
    if mosaic is not None:
        high, wide = mosaic
        start = [p + row[k] * sx * (wide - rows) / 2 + col[k] * sy * (high - rows) / 2 for k, p in enumerate(position)]
    # the last file row is the first voxel row
    start = [p + col[k] * sy * (rows - 1) for k, p in enumerate(start)]
    sign = (-1.0, -1.0, 1.0)
    return affine_column([[sign[k] * row[k] * sx, -sign[k] * col[k] * sy, sign[k] * normal[k] * sz, sign[k] * start[k]] for k in range(3)])


def nearest_axes(affine: Column) -> Column:
    """(order, flips): which voxel axis runs along x, y and z, by the greatest sum of absolute direction cosines, and
    which of them run backwards. Ties go to the order that sorts first."""
    length = [F.sqrt(sum((entry(affine, i, j) ** 2 for i in (1, 2)), entry(affine, 0, j) ** 2)) for j in range(3)]
    cosine = lambda i, j: entry(affine, i, j) / length[j]
    options = []
    for order in itertools.permutations(range(3)):
        fit = sum((F.abs(cosine(i, order[i])) for i in (1, 2)), F.abs(cosine(0, order[0])))
        flips = F.array(*[cosine(i, order[i]) < 0 for i in range(3)])
        options.append(F.struct(F.round(fit, 9).alias("fit"), F.lit(-len(options)).alias("turn"), F.array(*[F.lit(j) for j in order]).alias("order"), flips.alias("flips")))
    best = F.array_max(F.array(*[F.struct(o["fit"], o["turn"]) for o in options]))
    chosen = F.filter(F.array(*options), lambda o: o["turn"] == best["turn"])
    return F.struct(F.get(chosen, F.lit(0))["order"].alias("order"), F.get(chosen, F.lit(0))["flips"].alias("flips"))


def view(rows: DataFrame, plane: str, at: int, size: tuple[int, int, int], mirror: tuple[bool, bool] = (False, False), value: str = "v") -> DataFrame:
    """One plane of every volume as (other columns, row_, col_, value): axial, coronal or sagittal, each axis mirrored on
    demand (n - 1 - i)."""
    fixed, across, down = {"axial": ("z", "x", "y"), "coronal": ("y", "x", "z"), "sagittal": ("x", "y", "z")}[plane]
    n = dict(zip("xyz", size, strict=True))
    index = lambda axis, turn: (n[axis] - 1 - F.col(axis)) if turn else F.col(axis)
    rest = [c for c in rows.columns if c not in ("x", "y", "z", value)]
    return rows.filter(F.col(fixed) == at).select(*rest, index(down, mirror[1]).alias("row_"), index(across, mirror[0]).alias("col_"), value)


def mosaic_tile(rows: Column, cols: Column, images: Column, private: Column, size: Column) -> Column:
    """Whether a slice is a mosaic: its private count of tiles is given, or it is nearly as large as all tiles together."""
    side = F.ceil(F.sqrt(F.greatest(images, F.lit(1))))
    return private.isNotNull() | ((rows >= 0.9 * side * size) & (cols >= 0.9 * side * size) & (images > 1))


def age_group(level: str, columns: dict[str, str], df: DataFrame) -> DataFrame:
    """Headers at a level of anonymity. ``columns`` gives the kind of each protected one: name, date or id. ``none`` keeps
    all; ``basic`` clears names and keeps the year of dates; ``full`` clears dates and ids, too."""
    if level not in ("none", "basic", "full"):
        raise ValueError("the level is none, basic or full")
    out = {}
    for c, kind in columns.items():
        empty = F.lit(None).cast(df.schema[c].dataType)
        if level == "full" or (level == "basic" and kind == "name"):
            out[c] = empty
        elif level == "basic" and kind == "date":
            out[c] = F.trunc(c, "year").cast(df.schema[c].dataType)
    return df.withColumns(out) if out else df
