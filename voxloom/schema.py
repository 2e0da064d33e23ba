"""Table layouts.

A volume series has three: ``block`` (one row per volume, values with x fastest), which keeps spatial kernels free of
shuffles; ``series`` (one row per voxel, values by scan), which does the same for temporal ones; and ``voxel`` (one row
per value) for relational work. Coordinates and scans count from 0; null stands for a value outside the mask.
"""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    return T.StructType.fromDDL(spec)


HEADER = _struct(
    "image_id string, subject string, stage string, parent_image_id string, dim array<int>, pixdim array<float>, datatype int, "
    "scl_slope double, scl_inter double, affine array<double>, descrip string"
)
BLOCK = _struct("image_id string, t int, nx int, ny int, nz int, data array<double>")
SERIES = _struct("image_id string, z int, y int, x int, series array<double>")
VOXEL = _struct("image_id string, t int, z int, y int, x int, v double")
MOTION = _struct("subject string, t int, tx double, ty double, tz double, rx double, ry double, rz double")
EVENTS = _struct("condition string, onset double, duration double, units string")
DESIGN = _struct("scan int, col int, name string, value double")
CONTRAST = _struct("name string, col int, weight double")
STAT_MAP = _struct("name string, z int, y int, x int, con double, t double, p double, df double")
AUDIT = _struct("stage string, status string, metric string, value double, threshold double, pass boolean, gating boolean, note string")
