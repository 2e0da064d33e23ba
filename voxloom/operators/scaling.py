"""One stored scale for volumes whose slices have scales of their own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Steps of the two dithering sequences: powers of the inverse of the number that is one more than its own square or cube.
STEP, SLICE_STEP = 0.6180339887498949, 0.7548776662466927


def one_scale(slices: DataFrame, by: Sequence[str], at: str, raw: str = "raw", slope: str = "slope", intercept: str = "intercept", bits: int = 16, dither: bool = True) -> DataFrame:
    """(by, at, stored, scale, offset): stored whole numbers with one scale and offset for all slices of a volume.

    Where all slices agree in slope and intercept, the numbers stay as they are. Else the volume's range of real values is spread
    over all numbers of ``bits`` bits, from one aggregation of the slices' extremes. Rounding would turn slow changes into
    steps that lie alike in every slice, so values are rounded up or down by a sequence that fills (0, 1) evenly along
    the slice and from slice to slice; their mean stays right, and no value is off by more than one step.

    Defined results: null numbers stay null; a null slope is 1, a null intercept 0; a volume of one value has scale 1."""
    told = slices.withColumns({"_slope": F.coalesce(F.col(slope).cast("double"), F.lit(1.0)), "_shift": F.coalesce(F.col(intercept).cast("double"), F.lit(0.0))})
    real = F.transform(raw, lambda v: v.cast("double") * F.col("_slope") + F.col("_shift"))
    sizes = told.groupBy(*by).agg(
        ((F.min("_slope") == F.max("_slope")) & (F.min("_shift") == F.max("_shift"))).alias("_same"), F.min("_slope").alias("_one"), F.min("_shift").alias("_zero"),
        F.min(F.array_min(F.filter(real, lambda v: v.isNotNull()))).alias("_low"), F.max(F.array_max(F.filter(real, lambda v: v.isNotNull()))).alias("_high"),
    )
    steps = float(2**bits - 1)
    both = told.join(sizes, list(by))
    scale = F.when(F.col("_same"), F.col("_one")).when(F.col("_high") > F.col("_low"), (F.col("_high") - F.col("_low")) / steps).otherwise(1.0)
    lowest = float(2 ** (bits - 1))
    offset = F.when(F.col("_same"), F.col("_zero")).otherwise(F.col("_low") + lowest * F.col("scale"))
    scaled = both.withColumn("scale", scale).withColumn("offset", offset)
    share = lambda k: (k * STEP + F.col(at) * SLICE_STEP) % 1 if dither else F.lit(0.5)
    fresh = F.transform(raw, lambda v, k: F.when(v.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(steps), F.floor((v.cast("double") * F.col("_slope") + F.col("_shift") - F.col("_low")) / F.col("scale") + share(k)))) - lowest))
    stored = F.when(F.col("_same"), F.transform(raw, lambda v: v.cast("long"))).otherwise(F.transform(fresh, lambda v: v.cast("long")))
    return scaled.select(*by, at, stored.alias("stored"), "scale", "offset")
