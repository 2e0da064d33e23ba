"""Hard negatives: for every anchor and each of its nearest rows of the same label, the best rows of other labels whose
score lies in a share of the positive's.

Both searches are scans of anchors in blocks against rows in blocks. All vectors are turned by one orthogonal matrix, the
eigenvectors of the sum of v v^T over all rows (partial sums in tasks, one small matrix a dimension at the driver). That
leaves inner products as they are and puts most of a vector into its leading components. A scan adds up the products of
the leading components, some at a time. What the rest can add is at most the product of the norms of the rests, and a
slack covers rounding; a row whose possible scores miss all of an anchor's ranges is dropped there. What survives is scored
by integer products of the original vectors, so results are exact.

Every block of anchors meets one block of rows first; the scores found there narrow the ranges of the second wave, which
meets all other blocks.

Defined results: rows whose label, vector or id is null, or whose vector is empty or holds a null, take no part; vectors of
different lengths never meet; repeated rows count once; a row with an anchor's id is the anchor's own and never its partner;
ties go to the smaller id; scores beyond a long are the nearest long; an anchor without positives or without negatives in
range has no rows; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxloom.llm.common import quoted, written
from voxloom.llm.exact import paired

#: Numbers in a block of rows and of anchors, and blocks of anchors that ask one copy of a block of rows.
CELL, BLOCK, TOGETHER = 2**18, 2**15, 32
#: Components that are added up before each look at the bounds, as shares of the dimension; rows that are looked at at once.
LOOKS, STRIP = (1 / 8, 1 / 4, 1 / 2), 512
WINDOW = "array<struct<low:bigint,high:bigint>>"
HIT = "anchor long, low long, high long, id long, score long"
LEAST, MOST = -(2**63), 2**63 - 1


def usable(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(id, label, v, dim): stored, without repeats."""
    good = quoted(key).isNotNull() & quoted(label).isNotNull() & (F.size(quoted(vector)) > 0) & ~F.exists(quoted(vector), lambda x: x.isNull())
    kept = rows.filter(F.coalesce(good, F.lit(False))).select(quoted(key).cast("long").alias("id"), quoted(label).alias("label"), quoted(vector).cast("array<long>").alias("v"))
    return written(kept.dropDuplicates().withColumn("dim", F.size("v")))


def rotations(rows: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vectors an orthogonal matrix whose leading columns carry most of them. The driver gets one
    matrix a length, however many rows there are."""

    def sums(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            dims = b.column("dim").to_numpy()
            flat, ends = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(float), np.cumsum(dims)
            for d in np.unique(dims).tolist():
                v = flat[(ends[dims == d] - d)[:, None] + np.arange(d)]
                held[d] = held.get(d, 0.0) + v.T @ v
        for d, m in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array(list(m), pa.list_(pa.float64()))], ["dim", "row", "m"])

    parts = rows.select("dim", "v").mapInArrow(sums, "dim int, row int, m array<double>")
    cells = parts.select("dim", "row", F.posexplode("m").alias("col", "x")).groupBy("dim", "row", "col").agg(F.sum("x").alias("x"))
    out: dict[int, np.ndarray] = {}
    for r in cells.groupBy("dim", "row").agg(F.transform(F.sort_array(F.collect_list(F.struct("col", "x"))), lambda s: s["x"]).alias("m")).collect():
        out.setdefault(r["dim"], np.zeros((r["dim"], r["dim"])))[r["row"]] = r["m"]
    return {d: np.linalg.eigh(m / (np.abs(m).max() or 1.0))[1][:, ::-1] for d, m in out.items()}


def matrix(v: pa.ListArray) -> np.ndarray:
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)


class Cell:
    """A block of rows: the whole numbers and the turned vectors, longest first."""

    def __init__(self, rows: pa.StructArray, turn: np.ndarray):
        v = matrix(rows.field("v"))
        order = np.argsort(-(v.astype(float) ** 2).sum(1), kind="stable")
        self.ids, self.labels, self.v = rows.field("id").to_numpy()[order], rows.field("label").to_numpy(zero_copy_only=False)[order], v[order]
        self.turned = self.v.astype(float) @ turn


class Asked:
    """A block of anchors, each with ranges [low, high] of scores and the least score that still counts in each."""

    def __init__(self, anchors: pa.StructArray, turn: np.ndarray):
        self.ids, self.labels, self.v = anchors.field("id").to_numpy(), anchors.field("label").to_numpy(zero_copy_only=False), matrix(anchors.field("v"))
        self.turned = self.v.astype(float) @ turn
        ranges = anchors.field("ranges")
        n = ranges.value_lengths().to_numpy()
        self.width = int(n.max(initial=0))
        self.low, self.high, self.floor = np.full((len(n), self.width), MOST), np.full((len(n), self.width), LEAST), np.full((len(n), self.width), MOST)
        at = (np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        flat = ranges.flatten()
        for name in ("low", "high", "floor"):
            getattr(self, name)[at] = flat.field(name).to_numpy()


def scan(asked: Asked, cell: Cell, k: int, same: bool) -> list[np.ndarray]:
    """Hits (anchor's row, range, id, score): up to ``k`` best of each anchor and range in the cell."""
    d = asked.v.shape[1]
    looks = [*sorted({max(1, int(d * s)) for s in LOOKS} - {d}), d]
    floor = asked.floor.copy()
    rest = lambda t, at: np.sqrt((t[:, at:] ** 2).sum(1))
    # errors of the rotation, of the sums and of the norms, each a few times d roundings of |q| |x|
    slack = 64 * d * np.finfo(float).eps
    hits = [np.zeros((0,), np.int64)] * 4
    lo = 0
    while lo < len(cell.ids):
        own = slice(lo, lo + max(k + 1, min(STRIP, lo)))  # short strips first: they give the floors
        lo = own.stop
        rows, cols = np.nonzero((asked.labels[:, None] == cell.labels[None, own]) == same)
        apart = asked.ids[rows] != cell.ids[own][cols]
        rows, cols, x, done, sums = rows[apart], cols[apart], cell.turned[own], 0, None
        whole_q, whole_x = rest(asked.turned, 0), rest(x, 0)
        for at in looks:
            if not len(rows):
                break
            if len(rows) * 4 > len(asked.ids) * len(x):  # still dense: one product of matrices
                more = (asked.turned[:, done:at] @ x[:, done:at].T)[rows, cols]
            else:
                more = np.einsum("ij,ij->i", asked.turned[rows, done:at], x[cols, done:at])
            sums = more if sums is None else sums + more
            spread = rest(asked.turned, at)[rows] * rest(x, at)[cols] * (1 + slack) + slack * whole_q[rows] * whole_x[cols] + 1e-9
            live = np.zeros(len(rows), bool)
            for w in range(asked.width):
                # the ends of ranges as floats may be off by one part in 2^53, which the slack's share of a score covers
                top, bottom = floor[rows, w].astype(float), asked.high[rows, w].astype(float)
                live |= (np.maximum(sums + spread, LEAST) >= top - np.abs(top) * 1e-15) & (np.minimum(sums - spread, MOST) <= bottom + np.abs(bottom) * 1e-15)
            rows, cols, sums, done = rows[live], cols[live], sums[live], at
        if not len(rows):
            continue
        score = paired(asked.v[rows], cell.v[own][cols])
        ids = cell.ids[own][cols]
        for w in range(asked.width):
            good = (score >= floor[rows, w]) & (score <= asked.high[rows, w])
            hits = [np.concatenate(x) for x in zip(hits, (rows[good], np.full(good.sum(), w), ids[good], score[good]), strict=True)]
        hits, last = best(hits, k)
        full, w, _, s = (x[last] for x in hits)  # the k-th of an anchor and range
        floor[full, w] = np.maximum(floor[full, w], s)
    return hits


def best(hits: list[np.ndarray], k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The first ``k`` hits of each anchor and range, and where their k-th ones are."""
    rows, w, ids, score = hits
    order = np.lexsort((ids, ~score, w, rows))  # ~s falls as s rises, for every long
    hits = [x[order] for x in hits]
    rows, w = hits[0], hits[1]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (w[1:] != w[:-1])
    place = np.arange(len(rows)) - np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
    hits = [x[place < k] for x in hits]
    return hits, np.flatnonzero(place[place < k] == k - 1)


def blocks(rows: DataFrame, name: str, of: list[str], size: Column, counts: DataFrame, fields: list[str]) -> DataFrame:
    """``rows`` in blocks of about ``size`` rows: (``of``, ``name``, members, parts). ``counts`` has n by ``of``."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / size)).cast("int")
    cut = rows.join(counts.withColumn("parts", parts).drop("n"), of).withColumn(name, F.pmod(F.xxhash64("id", "v"), F.col("parts")).cast("int"))
    return cut.groupBy(*of, name, "parts").agg(F.collect_list(F.struct(*fields)).alias("members"))


def scanned(pairs: DataFrame, asked: DataFrame, cells: DataFrame, by: list[str], turns: dict[int, np.ndarray], k: int, same: bool) -> DataFrame:
    """Hits of each pair (``by``, block, cell). A cell travels once for up to ``TOGETHER`` blocks."""
    pairs = pairs.withColumn("part", F.floor(F.col("block") / TOGETHER).cast("int"))
    told = pairs.select(*by, "cell", "part").distinct().join(cells.select(*by, "cell", F.col("members").alias("rows")), [*by, "cell"]).withColumn("block", F.lit(-1))
    asks = pairs.join(asked.select(*by, "block", F.col("members").alias("anchors")), [*by, "block"])
    both = told.unionByName(asks, allowMissingColumns=True).repartition(*by, "cell", "part").sortWithinPartitions(*by, "cell", "part", "block")

    def visit(batches: Iterator) -> Iterator:
        cell = None
        for b in (whole.slice(at, 1) for whole in batches for at in range(whole.num_rows)):
            turn = turns[b.column("dim")[0].as_py()]
            if b.column("rows")[0].is_valid:
                cell = Cell(b.column("rows")[0].values, turn)
                continue
            q = Asked(b.column("anchors")[0].values, turn)
            rows, w, ids, score = scan(q, cell, k, same)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (q.ids[rows], q.low[rows, w], q.high[rows, w], ids, score)], ["anchor", "low", "high", "id", "score"])

    return both.select("dim", "rows", "anchors").mapInArrow(visit, HIT)


def first(hits: DataFrame, k: int) -> DataFrame:
    turn = Window.partitionBy("anchor", "low", "high").orderBy(F.col("score").desc(), "id")
    return hits.withColumn("rank", F.row_number().over(turn)).filter(F.col("rank") <= k)


def searched(anchors: DataFrame, rows: DataFrame, by: list[str], turns: dict[int, np.ndarray], k: int, same: bool) -> DataFrame:
    """(anchor, low, high, rank, id, score): the first ``k`` rows of the same label, or of other ones, in each range of
    each anchor. ``by``: what anchors and rows must agree in to meet at all."""
    size = lambda n: F.greatest(F.lit(16), F.floor(F.lit(n) / F.col("dim")))
    counts = rows.groupBy(*by).agg(F.count("*").alias("n"))
    cells = written(blocks(rows, "cell", by, size(CELL), counts, ["id", "label", "v"]))
    asks = anchors.groupBy(*by).agg(F.count("*").alias("n"))
    ranged = anchors.withColumn("ranges", F.transform("ranges", lambda r: F.struct(r["low"].alias("low"), r["high"].alias("high"), r["low"].alias("floor"))))
    plain = written(blocks(ranged, "block", by, size(BLOCK), asks, ["id", "label", "v", "ranges"]))
    most = cells.select(*by, F.col("parts").alias("cells")).distinct()
    met = plain.select(*by, "block").join(most, by).withColumn("home", F.pmod("block", F.col("cells")))
    home = scanned(met.withColumn("cell", F.col("home")), plain, cells, by, turns, k, same)
    hits = written(first(home, k).drop("rank"))
    # the k-th score of a range so far is the least that still counts in it
    kth = first(hits, k).filter(F.col("rank") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("low", "high"), "score"))).alias("kth"))
    floor = lambda r: F.greatest(r["low"], F.try_element_at("kth", F.struct(r["low"], r["high"])))
    told = ranged.join(kth, anchors["id"] == kth["anchor"], "left").withColumn("ranges", F.transform("ranges", lambda r: F.struct(r["low"].alias("low"), r["high"].alias("high"), floor(r).alias("floor"))))
    again = written(blocks(told, "block", by, size(BLOCK), asks, ["id", "label", "v", "ranges"]))
    others = met.withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).filter(F.col("cell") != F.col("home"))
    return first(hits.unionByName(scanned(others, again, cells, by, turns, k, same)), k)


def mine(rows: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "v", label: str = "label", positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row where ``is_anchor`` (in
    terms of id and label) and each of its first ``positives`` rows of the same label, the first ``negatives`` rows of other
    labels with least % <= negative score / positive score <= most %."""
    rows = usable(rows, key, vector, label)
    turns = rotations(rows)
    anchors = rows.filter(is_anchor)
    open_range = F.array(F.struct(F.lit(LEAST).alias("low"), F.lit(MOST).alias("high"))).cast(WINDOW)
    near = written(searched(anchors.withColumn("ranges", open_range), rows, ["dim", "label"], turns, positives, True).select("anchor", F.col("id").alias("positive"), F.col("score").alias("positive_score")))
    # ends of the ranges as whole numbers: decimals hold 100 times any long
    wide = F.col("positive_score").cast("decimal(22,0)")
    low, high = F.ceil(wide * least / 100).cast("long"), F.floor(wide * most / 100).cast("long")
    ranged = near.withColumns({"low": low, "high": high}).filter(F.col("low") <= F.col("high"))
    asked = ranged.groupBy("anchor").agg(F.collect_set(F.struct("low", "high")).cast(WINDOW).alias("ranges"))
    found = searched(anchors.join(asked, anchors["id"] == asked["anchor"]).drop("anchor"), rows, ["dim"], turns, negatives, False)
    both = ranged.join(found, ["anchor", "low", "high"])
    return both.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
