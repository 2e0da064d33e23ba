"""Groups of rows whose vectors agree within tolerances, the first match winning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.session import settled

#: A coarse cell is so many tolerances wide.
COARSE = 32


def leaders(rows: DataFrame, by: Sequence[str], order: Sequence[str], vectors: Sequence[str], tolerances: Sequence[float], to: str = "leader") -> DataFrame:
    """``rows`` with ``to``, the ``order`` of the row that leads its group.

    Rows are taken in ``order`` within ``by``. A row joins the first leader all of whose numbers in all ``vectors`` differ from its
    own by less than the vector's tolerance; where there is none, it is a leader itself.

    A row leads if no earlier leader matches it. Rows of one fine cell (no wider than the tolerances) all match each other,
    so only its first open row can lead. Those candidates are held against the open rows before them in their coarse cell;
    candidates near an edge go to the cells beyond it, too. A candidate without an earlier match leads, and what it matches
    is settled; then the next round begins. Rounds end after the longest chain of rows that match one by one; each costs
    work in proportion to the open rows, since a coarse cell has few candidates. At last every row takes the first of the
    leaders that match it.

    Defined results: equal rows count once until the end; rows whose vectors are null, hold a null or differ in length from all
    others match nothing, themselves left alone as leaders; rows that agree in ``by`` and ``order`` are one row; NaN matches
    nothing; no rows give none."""
    key = F.struct(*order)
    flat = F.concat(*[F.coalesce(F.col(v).cast("array<double>"), F.array().cast("array<double>")) for v in vectors])
    whole = F.lit(True)
    for v in vectors:
        whole = whole & F.coalesce(F.col(v).isNotNull() & F.forall(F.col(v), lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))), F.lit(False))
    width = F.concat(*[F.array_repeat(F.lit(float(t)), F.coalesce(F.greatest(F.size(v), F.lit(0)), F.lit(0))) for v, t in zip(vectors, tolerances, strict=True)])
    shape = F.array(*[F.coalesce(F.size(v), F.lit(-1)) for v in vectors])
    told = rows.withColumns({"_key": key, "_v": flat, "_tol": width, "_shape": shape, "_whole": whole & (F.size(flat) > 0)})
    good = told.filter("_whole")
    # equal vectors are settled as one: they match whatever one of them matches
    points = settled(good.groupBy(*by, "_shape", "_v", "_tol").agg(F.min("_key").alias("_key")))
    same = [*by, "_shape"]
    cell = lambda scale: F.zip_with("_v", "_tol", lambda v, t: F.floor(v / (t * scale)))
    home = points.withColumn("_cell", cell(COARSE))

    def near(some: DataFrame) -> DataFrame:
        """A copy of each row for every coarse cell within its tolerances."""
        both = F.transform(F.zip_with("_v", "_tol", lambda v, t: F.struct(F.floor((v - t) / (t * COARSE)).alias("a"), F.floor((v + t) / (t * COARSE)).alias("b"))), lambda s: F.array_distinct(F.array(s["a"], s["b"])))
        cells = F.aggregate(both, F.array(F.array().cast("array<bigint>")), lambda all_, s: F.flatten(F.transform(all_, lambda c: F.transform(s, lambda x: F.concat(c, F.array(x))))))
        return some.withColumn("_cell", F.explode(cells))

    def matches(a: Column, b: Column, tol: Column) -> Column:
        return F.forall(F.zip_with(F.zip_with(a, b, lambda x, y: F.abs(x - y)), tol, lambda d, t: d < t), lambda ok: ok)

    def meeting(some: DataFrame, others: DataFrame) -> DataFrame:
        """Rows of ``others`` in the cells of ``some`` that they match."""
        mine = near(some).select(*same, "_cell", F.col("_key").alias("_first"), F.col("_v").alias("_of"))
        return others.join(mine, [*same, "_cell"]).filter(matches(F.col("_v"), F.col("_of"), F.col("_tol")))

    open_, found = home, None
    while True:
        candidates = open_.groupBy(*same, cell(1).alias("_fine")).agg(F.min(F.struct("_key", "_v", "_tol")).alias("_m")).select(*same, "_m.*")
        blocked = meeting(candidates, open_).filter(F.col("_key") < F.col("_first")).select(*by, F.col("_first").alias("_key")).distinct()
        lead = settled(candidates.join(blocked, [*by, "_key"], "left_anti"))
        found = lead if found is None else settled(found.unionByName(lead))
        settled_now = meeting(lead, open_).select(*by, "_key").distinct()
        open_ = settled(open_.join(settled_now, [*by, "_key"], "left_anti"))
        if open_.isEmpty():
            break
    least = meeting(found, home).groupBy(*same, "_v").agg(F.min("_first").alias("_led"))
    led = good.join(least, [*same, "_v"]).withColumn(to, F.col("_led"))
    alone = told.filter(~F.col("_whole")).withColumn(to, F.col("_key"))
    return led.select(*rows.columns, to).unionByName(alone.select(*rows.columns, to))
