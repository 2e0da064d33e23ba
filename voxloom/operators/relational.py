"""Masks, exact percentiles, nearest matches, runs, clusters, histograms and similarity over plain tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxloom.operators.segment import STEPS
from voxloom.session import settled


def drop_scans(rows: DataFrame, n: int, scan: str = "t") -> DataFrame:
    """Without the first ``n`` scans; the rest counts from 0 again."""
    return rows.filter(F.col(scan) >= n).withColumn(scan, F.col(scan) - n)


def percentile_mask(means: DataFrame, percent: float, value: str = "mean") -> DataFrame:
    """Voxels whose mean lies strictly above the percentile."""
    cut = percentile(means, [], value, percent, "linear").first()
    return means.filter(F.col(value) > F.lit(cut["percentile"] if cut else None))


def global_mask(means: DataFrame, fraction: float = 0.5, value: str = "mean") -> DataFrame:
    """Voxels over ``fraction`` (kept within 0 to 1) of the mean of the positive means."""
    level = means.agg(F.avg(F.when(F.col(value) > 0, F.col(value)))).first()[0]
    return means.filter(F.col(value) > F.lit(min(1.0, max(0.0, fraction)) * (level or 0.0)))


def _place(rule: str, percent: float, n: Column) -> Column:
    """The rank, from 1, that a percentile stands at: by the midpoint rule or the linear one."""
    at = n * (percent / 100) + 0.5 if rule == "midpoint" else (n - 1) * (percent / 100) + 1
    return F.least(F.greatest(at, F.lit(1.0)), n.cast("double"))


def _with_state(rows: DataFrame, state: DataFrame, keys: list[str], groups: int) -> DataFrame:
    return rows.join(F.broadcast(state) if groups <= 10_000 else state, keys)


def percentile(rows: DataFrame, by: Sequence[str], value: str, percent: float, rule: str = "midpoint", few: int = 100_000, cuts: int = 1000) -> DataFrame:
    """(by, percentile): exact percentiles of groups of any size, without sorting them; nulls and NaN take no part.

    Every pass cuts a group at approximate quantiles and keeps the stretch around the wanted rank, a few thousandths of its
    rows; counting what lies below keeps the ranks exact. Only the last stretch, ``few`` rows or one value, is ordered."""
    keys = [*by, "_g"]
    rows = rows.select(*by, F.lit(0).alias("_g"), F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    state = rows.groupBy(*keys).agg(F.count("*").alias("_all"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    state = settled(state.withColumns({"_below": F.lit(0).cast("long"), "_inside": F.col("_all")}))
    groups, inside = state.count(), rows
    for turn in range(8):
        if not state.filter((F.col("_inside") > few) & (F.col("_lo") < F.col("_hi"))).limit(1).count():
            break
        found = _with_state(rows, state, keys, groups).filter(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        at = found.groupBy(*keys).agg(F.percentile_approx("_v", [k / cuts for k in range(cuts + 1)], 10 * cuts).alias("_cuts"))
        share = (_place(rule, percent, F.col("_all")) - F.col("_below")) / F.col("_inside") * cuts
        low, high = F.greatest(F.floor(share) - 2, F.lit(0)), F.least(F.ceil(share) + 2, F.lit(cuts))
        asked = state.join(at, keys).select(*keys, "_all", F.get("_cuts", low.cast("int")).alias("_a"), F.get("_cuts", high.cast("int")).alias("_z"), "_lo", "_hi", "_below", "_inside")
        asked = settled(asked)
        counts = _with_state(rows, asked.select(*keys, "_a", "_z"), keys, groups).groupBy(*keys).agg(F.count_if(F.col("_v") < F.col("_a")).alias("_under"), F.count_if(F.col("_v").between(F.col("_a"), F.col("_z"))).alias("_in"))
        place = _place(rule, percent, F.col("_all"))
        # a stretch that misses a wanted rank isn't taken
        good = (F.col("_under") < F.floor(place)) & (F.col("_under") + F.col("_in") >= F.least(F.floor(place) + 1, F.col("_all")))
        new = {"_lo": "_a", "_hi": "_z", "_below": "_under", "_inside": "_in"}
        state = settled(asked.join(counts, keys).select(*keys, "_all", *[F.when(good, F.col(n)).otherwise(F.col(o)).alias(o) for o, n in new.items()]))
    else:
        turn = 8
    if turn:
        inside = _with_state(rows, state.select(*keys, "_lo", "_hi"), keys, groups).filter(F.col("_v").between(F.col("_lo"), F.col("_hi"))).select(*keys, "_v")
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_v"))
    counts = inside.groupBy(*keys, "_v").agg(F.count("*").alias("_n")).withColumn("_upto", upto)
    counts = _with_state(counts, state.select(*keys, "_all", "_below"), keys, groups)
    place = _place(rule, percent, F.col("_all"))
    holds = lambda rank: (F.col("_below") + F.col("_upto") >= rank) & (F.col("_below") + F.col("_upto") - F.col("_n") < rank)
    low, high = F.floor(place), F.least(F.floor(place) + 1, F.col("_all"))
    ends = counts.groupBy(*keys).agg(F.max(F.when(holds(low), F.col("_v"))).alias("_a"), F.max(F.when(holds(high), F.col("_v"))).alias("_z"), F.first(place - low).alias("_f"))
    return ends.select(*by, (F.col("_a") + F.col("_f") * (F.col("_z") - F.col("_a"))).alias("percentile"))


def hazen(rows: DataFrame, by: Sequence[str], value: str, percent: float, buckets: int = 1000) -> DataFrame:
    """(by, hazen): the exact percentile by the midpoint rule, narrowed down by ``buckets`` cuts a pass."""
    return percentile(rows, by, value, percent, cuts=buckets).withColumnRenamed("percentile", "hazen")


def nearest_index(value: Column, points: Sequence[float]) -> Column:
    """Index of the nearest point, ties to the first."""
    return F.array_min(F.array(*[F.struct(F.abs(value - p).alias("d"), F.lit(k).alias("k")) for k, p in enumerate(points)]))["k"]


def runs(rows: DataFrame, by: Sequence[str], order: Sequence[str], *values: str) -> DataFrame:
    """Adds ``run``: numbered from 0, a new one wherever one of ``values`` changes along ``order``."""
    w = Window.partitionBy(*by).orderBy(*order)
    changed = F.lit(False)
    for v in values:
        changed = changed | ~F.col(v).eqNullSafe(F.lag(v).over(w))
    first = F.row_number().over(w) == 1
    return rows.withColumn("_new", F.when(first | ~changed, 0).otherwise(1)).withColumn("run", F.sum("_new").over(w)).drop("_new")


def clusters(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds ``cluster``: the connected component (six neighbours) of each voxel row, named by its least voxel number.

    Labels fall to the least neighbouring label, then jump to their label's label, until nothing changes. Voxels meet by
    sorting: files of labels look small, and a broadcast of them in every round would pass through the driver."""
    at = [*by, "z", "y", "x"]
    code = (F.col("z").cast("long") * 1_000_000 + F.col("y")) * 1_000_000 + F.col("x")
    voxels = settled(rows.select(*at).distinct().withColumn("id", code))
    steps = F.array(*[F.lit((dz * 1_000_000 + dy) * 1_000_000 + dx) for dx, dy, dz in STEPS])
    edges = voxels.select(*by, "id", F.explode(F.transform(steps, lambda s: s + F.col("id"))).alias("to"))
    edges = settled(edges.join(voxels.select(*by, F.col("id").alias("to")).hint("merge"), [*by, "to"]).select(*by, "id", "to"))
    labels = voxels.select(*by, "id", F.col("id").alias("label"))
    while True:
        near = edges.join(labels.select(*by, F.col("id").alias("to"), "label").hint("merge"), [*by, "to"]).groupBy(*by, "id").agg(F.min("label").alias("_near"))
        low = labels.join(near.hint("merge"), [*by, "id"], "left").select(*by, "id", F.col("label").alias("_was"), F.least("label", "_near").alias("_low"))
        jump = labels.select(*by, F.col("id").alias("_low"), F.col("label").alias("_jump"))
        after = settled(low.join(jump.hint("merge"), [*by, "_low"]).select(*by, "id", "_was", F.least("_low", "_jump").alias("label")))
        labels = after.select(*by, "id", "label")
        if not after.filter(F.col("_was") != F.col("label")).limit(1).count():
            break
    named = voxels.join(labels.hint("merge"), [*by, "id"]).select(*at, F.col("label").alias("cluster"))
    return rows.join(named.hint("merge"), at)


def extent(clustered: DataFrame, by: Sequence[str], least: int) -> DataFrame:
    """Voxels of clusters with ``least`` voxels or more."""
    big = clustered.groupBy(*by, "cluster").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).drop("_n")
    return clustered.join(big.hint("merge"), [*by, "cluster"], "left_semi")


def levels(value: Column, low: float, high: float, n: int) -> Column:
    """Clip to [low, high] and number the level from 0 to n - 1."""
    return F.round((F.least(F.greatest(value, F.lit(low)), F.lit(high)) - low) / (high - low if high > low else 1.0) * (n - 1)).cast("int")


def joint_histogram(pairs: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    return pairs.groupBy(*by, a, b).agg(F.count("*").alias("n"))


def smoothed_histogram(histogram: DataFrame, by: Sequence[str], a: str, b: str, taps: Sequence[float], bins: int) -> DataFrame:
    """The histogram with each count spread over its neighbours along both axes; what falls off the ends is lost."""
    r = len(taps) // 2
    steps = F.array(*[F.struct(F.lit(i - r).alias("i"), F.lit(j - r).alias("j"), F.lit(float(u * v)).alias("w")) for i, u in enumerate(taps) for j, v in enumerate(taps)])
    spread = histogram.select(*by, a, b, "n", F.explode(steps).alias("s")).select(*by, (F.col(a) + F.col("s.i")).alias(a), (F.col(b) + F.col("s.j")).alias(b), (F.col("n") * F.col("s.w")).alias("n"))
    return spread.filter(F.col(a).between(0, bins - 1) & F.col(b).between(0, bins - 1)).groupBy(*by, a, b).agg(F.sum("n").alias("n"))


def information(histogram: DataFrame, by: Sequence[str], a: str, b: str, base: float = math.e) -> DataFrame:
    """(by, h_a, h_b, h_ab, mi, nmi, ecc, ncc), in nats unless another base is given. The marginals come from the histogram,
    not from the pairs; ncc is the correlation of the bin numbers."""
    both = settled(histogram)

    def entropy(keys, name):
        n = both.groupBy(*by, *keys).agg(F.sum("n").alias("n")).filter(F.col("n") > 0)
        # H = ln N - sum(n ln n) / N
        return n.groupBy(*by).agg(((F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")) / math.log(base)).alias(name))

    mean = lambda c: F.sum(F.col("n") * c) / F.sum("n")
    x, y = F.col(a), F.col(b)
    vx, vy = mean(x * x) - mean(x) * mean(x), mean(y * y) - mean(y) * mean(y)
    moments = both.groupBy(*by).agg(F.when((vx > 0) & (vy > 0), (mean(x * y) - mean(x) * mean(y)) / F.sqrt(vx * vy)).alias("ncc"))
    h = entropy([a], "h_a").join(entropy([b], "h_b"), list(by)).join(entropy([a, b], "h_ab"), list(by)).join(moments, list(by))
    ha, hb, hab = F.col("h_a"), F.col("h_b"), F.col("h_ab")
    return h.select(*by, "h_a", "h_b", "h_ab", (ha + hb - hab).alias("mi"), F.when(hab > 0, (ha + hb) / hab).alias("nmi"), F.when(ha + hb > 0, 2 - 2 * hab / (ha + hb)).alias("ecc"), "ncc")


def focused_similarity(pairs: DataFrame, by: Sequence[str], a: str, gold: str, percent: float = 70, least: int = 1000) -> DataFrame:
    """(by, r, n): correlation where either side is as large as a percentile of the gold's magnitudes; where that leaves
    under ``least`` pairs, of all of them."""
    cuts = percentile(pairs.select(*by, F.abs(gold).alias("_m")), by, "_m", percent, "linear")
    marked = pairs.join(cuts, list(by)).withColumn("_hit", F.greatest(F.abs(a), F.abs(gold)) >= F.col("percentile"))
    hit = F.col("_hit")
    g = marked.groupBy(*by).agg(F.count_if(hit).alias("_n"), F.corr(F.when(hit, F.col(a)), F.when(hit, F.col(gold))).alias("_r"), F.corr(a, gold).alias("_all"), F.count("*").alias("_rows"))
    few = F.col("_n") < least
    return g.select(*by, F.when(few, F.col("_all")).otherwise(F.col("_r")).alias("r"), F.when(few, F.col("_rows")).otherwise(F.col("_n")).alias("n"))


def similarity(pairs: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    """(by, r, n): Pearson correlation over pairs that are finite and not both 0; null where one side is constant."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    used = pairs.filter(finite(a) & finite(b) & ((F.col(a) != 0) | (F.col(b) != 0)))
    g = used.groupBy(*by).agg(F.corr(a, b).alias("r"), F.count("*").alias("n"), F.stddev_pop(a).alias("_sa"), F.stddev_pop(b).alias("_sb"))
    return g.select(*by, F.when((F.col("_sa") > 0) & (F.col("_sb") > 0), F.col("r")).alias("r"), "n")


def audited(found: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Adds the tri-state ``pass``: null where there is no correlation."""
    return found.withColumn("threshold", F.lit(threshold)).withColumn("pass", F.col("r") >= threshold)


def first_failing(audit: DataFrame, order: str, gating: str = "gating") -> DataFrame:
    """The first gated stage that fails."""
    return audit.filter(F.col(gating) & ~F.col("pass")).orderBy(order).limit(1)


def age_years(study: Column, birth: Column) -> Column:
    """Age to a tenth of a year, for headers whose dates are removed."""
    return F.round(F.datediff(study, birth) * 10 / 365.25) / 10
