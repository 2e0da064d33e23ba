"""Triangle surfaces of thresholded volumes by marching tetrahedra, as joins of voxels with their neighbours."""

from __future__ import annotations

import itertools
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The corners of a cell, x fastest, and its six tetrahedra: one for each way from the first corner to the last along edges.
CORNERS = [(k & 1, k >> 1 & 1, k >> 2) for k in range(8)]
TETRAHEDRA = [(0, 1 << p[0], (1 << p[0]) | (1 << p[1]), 7) for p in itertools.permutations(range(3))]


def cells(voxels: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, x, y, z, v): cells between eight voxels with the values at their corners. Each voxel goes to the cells that it is a
    corner of; cells at the edge, with fewer than eight, are left out."""
    places = F.array(*[F.struct(F.lit(k).alias("k"), (F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), (F.col("z") - dz).alias("z")) for k, (dx, dy, dz) in enumerate(CORNERS)])
    spread = voxels.select(*by, F.explode(places).alias("c"), F.col(value).cast("double").alias("_v")).select(*by, "c.*", "_v")
    packed = spread.groupBy(*by, "x", "y", "z").agg(F.sort_array(F.collect_list(F.struct("k", F.col("_v").alias("v")))).alias("_c"))
    full = (F.size("_c") == 8) & F.forall("_c", lambda c: c["v"].isNotNull() & ~F.isnan(c["v"]))
    return packed.filter(full).select(*by, "x", "y", "z", F.transform("_c", lambda c: c["v"]).alias("v"))


def _determinant(t: Sequence[int]) -> int:
    d = [[CORNERS[k][i] - CORNERS[t[0]][i] for i in range(3)] for k in t[1:]]
    return d[0][0] * (d[1][1] * d[2][2] - d[1][2] * d[2][1]) - d[0][1] * (d[1][0] * d[2][2] - d[1][2] * d[2][0]) + d[0][2] * (d[1][0] * d[2][1] - d[1][1] * d[2][0])


def _permutation(p: Sequence[int]) -> int:
    return (-1) ** sum(p[i] > p[j] for i in range(len(p)) for j in range(i + 1, len(p)))


def _cuts(tetra: Sequence[int], inside: Sequence[bool]) -> list[list[tuple[int, int]]]:
    """The triangles of one tetrahedron (none, one or two) as edges between corners, counter-clockwise as seen from below the
    level."""
    above, below = [i for i in range(4) if inside[i]], [i for i in range(4) if not inside[i]]
    if not above or not below:
        return []
    if len(above) == 2:
        (a, b), (c, d) = above, below
        found, even = [[(a, c), (a, d), (b, d)], [(a, c), (b, d), (b, c)]], _permutation((a, b, c, d))
    else:
        lone, rest = (above, below) if len(above) == 1 else (below, above)
        found, even = [[(lone[0], r) for r in rest]], _permutation((lone[0], *rest)) * (1 if len(above) == 1 else -1)
    if even * _determinant(tetra) < 0:
        found = [[t[0], t[2], t[1]] for t in found]
    # both ends in a fixed order, so that all cells that share an edge find the very same point
    return [[tuple(sorted((tetra[i], tetra[j]))) for i, j in t] for t in found]


def _table() -> list[list[list[tuple[int, int]]]]:
    """For each way in which the eight corners can lie above or below the level, the triangles of all six tetrahedra."""
    return [[t for tetra in TETRAHEDRA for t in _cuts(tetra, [mask >> k & 1 for k in tetra])] for mask in range(256)]


def triangles(voxels: DataFrame, by: Sequence[str], level: float, value: str = "v") -> DataFrame:
    """(by, x, y, z, triangle, corners): the surface where ``value`` crosses ``level``, a row a triangle, with the cell that it lies
    in. ``corners``: three points in voxels. Values at the level count as inside.

    Only cells with voxels on both sides are cut. Surfaces are closed but where they leave the volume, because two cells
    that share a face cut it along the same diagonal. Voxels that are missing, null or NaN leave holes."""
    level, v = float(level), F.col("v")
    mask = F.aggregate(F.transform(v, lambda x, k: F.when(x >= level, F.pow(F.lit(2), k)).otherwise(0).cast("int")), F.lit(0), lambda a, b: a + b)
    mixed = cells(voxels, by, value).withColumn("_mask", mask).filter((F.col("_mask") > 0) & (F.col("_mask") < 255))
    places = [F.lit([float(c[k]) for c in CORNERS]) for k in range(3)]

    def point(edge: Column) -> Column:
        a, b = edge[0], edge[1]
        share = (F.lit(level) - v[a]) / (v[b] - v[a])
        return F.array(*[F.col(n) + p[a] + share * (p[b] - p[a]) for n, p in zip(("x", "y", "z"), places, strict=True)])

    edges = F.from_json(F.lit(json.dumps(_table())), "array<array<array<array<int>>>>")[F.col("_mask")]  # folded once
    return mixed.select(*by, "x", "y", "z", v, F.posexplode(edges).alias("triangle", "_edges")).select(*by, "x", "y", "z", "triangle", F.transform("_edges", point).alias("corners"))


def area(corners: Column) -> Column:
    """The area of a triangle in voxels; of a flat one 0."""
    side = lambda k: [corners[k][i] - corners[0][i] for i in range(3)]
    a, b = side(1), side(2)
    cross = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    return F.sqrt(sum((c * c for c in cross), F.lit(0.0))) / 2


def enclosed(corners: Column) -> Column:
    """A triangle's share of the volume inside a closed surface; their sum is the volume."""
    a, b, c = ([corners[k][i] for i in range(3)] for k in range(3))
    return (a[0] * (b[1] * c[2] - b[2] * c[1]) + a[1] * (b[2] * c[0] - b[0] * c[2]) + a[2] * (b[0] * c[1] - b[1] * c[0])) / 6


def mesh(found: DataFrame, by: Sequence[str], digits: int = 6) -> tuple[DataFrame, DataFrame]:
    """Vertices (by, vertex, point) and faces (by, cell, triangle, vertices): points that agree to ``digits`` are one vertex, named
    by its place."""
    name = lambda p: F.array_join(F.transform(p, lambda c: F.format_string(f"%.{digits}f", F.round(c, digits) + 0)), " ")
    faces = found.select(*by, F.struct("x", "y", "z").alias("cell"), "triangle", F.transform("corners", name).alias("vertices"))
    points = found.select(*by, F.explode("corners").alias("point")).select(*by, name(F.col("point")).alias("vertex"), "point")
    return points.groupBy(*by, "vertex").agg(F.min("point").alias("point")), faces
