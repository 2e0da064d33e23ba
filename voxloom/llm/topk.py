"""Exact top-k inner-product search with ball trees, shard by shard.

Candidates are dealt into shards of bounded size by space: each goes to the nearest of a bounded sample of them, and a
place that draws more than a shard holds is split. Each shard builds a ball tree (equal vectors are one point there) and is
stored as one row. Queries travel in blocks. A node with centre c and radius r can't score above q.c + |q| r: nodes
are visited by falling bound and dropped once the bound can't beat the query's current k-th score.

The current k-th scores are shared between shards in three waves. Every block first searches one shard. Then the bounds
of all shards' roots are held against the block's k-th scores, blocks of queries against blocks of roots, and only pairs
that may still add something go on: first those with the highest bounds, and the rest after another look at the
scores that these gave. A tree travels to a task once, before up to ``TOGETHER`` blocks that ask it.

Scores are integers: vectors are arrays of long, of any size; a score beyond a long is the nearest long. Defined results: a vector that is null or holds a null takes no part;
vectors of different lengths never meet; ties go to the smaller id; a candidate with the query's id is its own row and is
left out; no candidates, no rows; repeated ids count once for each different vector.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxloom.llm.common import written
from voxloom.llm.exact import products

SHARD, LEAF, BLOCK = 8192, 64, 512
#: Blocks that ask one copy of a tree; shards of the second wave; roots that are held against a block at once.
TOGETHER, NEAREST, ROOTS = 64, 4, 1024
#: Rows that places are taken from, at most; and places.
SAMPLE, PLACES = 4096, 256
LEAST, MOST = -(2**63), 2**63 - 1
HITS = "query long, rank int, id long, score long"


class BallTree:
    """Distinct vectors of one shard. Node k covers ``order[lo[k]:hi[k]]``; its children are 2k+1 and 2k+2."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        order = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[order], vectors[order]
        new = np.ones(len(ids), bool)
        new[1:] = (vectors[1:] != vectors[:-1]).any(1)
        start = np.flatnonzero(new)
        # of equal vectors only the k + 1 smallest ids can be in any answer (one may be the query's own)
        self.ids = [np.unique(g)[: k + 1] for g in np.split(ids, start[1:])]
        self.vectors = vectors[start]
        self.points = self.vectors.astype(np.float64)
        n = len(self.points)
        self.depth = max(0, math.ceil(math.log2(max(1, n / LEAF))))
        size = 2 ** (self.depth + 1) - 1
        self.lo, self.hi = np.zeros(size, int), np.zeros(size, int)
        self.centre, self.radius = np.zeros((size, self.points.shape[1])), np.zeros(size)
        self.order = np.arange(n)
        self.hi[0] = n
        for node in range(size):
            lo, hi = self.lo[node], self.hi[node]
            own = self.points[self.order[lo:hi]]
            if hi > lo:
                self.centre[node] = own.mean(0)
                # a little wider than measured, so rounding never makes a bound too low
                self.radius[node] = math.sqrt(((own - self.centre[node]) ** 2).sum(1).max()) * (1 + 1e-9) + 1e-9
            if 2 * node + 2 < size:
                mid = (lo + hi) // 2
                if hi - lo > 1:
                    far = own[((own - self.centre[node]) ** 2).sum(1).argmax()]
                    other = own[((own - far) ** 2).sum(1).argmax()]
                    self.order[lo:hi] = self.order[lo:hi][np.argsort(own @ (other - far), kind="stable")]
                self.lo[2 * node + 1], self.hi[2 * node + 1] = lo, mid
                self.lo[2 * node + 2], self.hi[2 * node + 2] = mid, hi

    def search(self, ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
        """For each query its k best (score, id) with a score of ``floor`` or more."""
        q = queries.astype(np.float64)
        norm = np.sqrt((q**2).sum(1)) * (1 + 1e-9)
        best: list[list[tuple[int, int]]] = [[] for _ in ids]
        floor = floor.copy()
        # down the tree, level by level: (query, node) survives while its bound reaches the query's floor
        rows, nodes = np.arange(len(ids)), np.zeros(len(ids), int)
        bound = np.full(len(ids), np.inf)
        for _ in range(self.depth):
            rows, nodes = np.repeat(rows, 2), (2 * nodes[:, None] + np.array([1, 2])).ravel()
            bound = np.einsum("ij,ij->i", q[rows], self.centre[nodes]) + norm[rows] * self.radius[nodes]
            bound = np.maximum(bound + np.abs(bound) * 1e-9, LEAST)
            live = (bound >= floor[rows]) & (self.hi[nodes] > self.lo[nodes])
            rows, nodes, bound = rows[live], nodes[live], bound[live]
        # leaves in rounds: each query takes its next best one, queries at one leaf are scored together
        order = np.lexsort((-bound, rows))
        rows, nodes, bound = rows[order], nodes[order], bound[order]
        first = np.searchsorted(rows, np.arange(len(ids)))
        last = np.searchsorted(rows, np.arange(len(ids)), side="right")
        turn, active = 0, np.arange(len(ids))
        while len(active):
            at = first[active] + turn
            active, at = active[at < last[active]], at[at < last[active]]
            still = bound[at] >= floor[active]  # bounds fall, so a query that stops here is done
            active, at = active[still], at[still]
            for leaf in np.unique(nodes[at]):
                here = active[nodes[at] == leaf]
                own = self.order[self.lo[leaf] : self.hi[leaf]]
                scores = products(queries[here], self.vectors[own])
                for r, s in zip(here, scores, strict=True):
                    good = np.flatnonzero(s >= floor[r])
                    if len(good):
                        if len(good) > k + 1:
                            cut = np.partition(s[good], -(k + 1))[-(k + 1)]
                            good = good[s[good] >= cut]
                        found = best[r] + [(int(s[g]), int(i)) for g in good for i in self.ids[own[g]] if i != ids[r]]
                        found.sort(key=lambda x: (-x[0], x[1]))
                        best[r] = found[:k]
                        if len(best[r]) == k:
                            floor[r] = max(floor[r], best[r][-1][0])
            turn += 1
        return best


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    ok = F.col(key).isNotNull() & F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull())
    return rows.filter(ok).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<long>").alias("v"))


def search(candidates: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 20, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query, rank, id, score): each query's ``k`` highest inner products among ``candidates``, ties to the smaller id."""
    points, asked = usable(candidates, key, vector), usable(queries, key, vector)
    sized = points.withColumn("dim", F.size("v")).filter(F.col("dim") > 0)
    places = places_of(sized, shard)
    cut, shards = dealt(sized, places, shard, "shard")
    if not shards:
        return candidates.sparkSession.createDataFrame([], HITS)
    of = F.create_map(*[F.lit(x) for pair in shards.items() for x in pair])

    def build(group: pa.Table) -> pa.Table:
        dim = group.column("dim")[0].as_py()
        tree = BallTree(group.column("id").to_numpy(), _vectors(group.column("v").combine_chunks(), dim), k)
        one = lambda v, kind: pa.array([v], kind)
        return pa.table(
            {
                "dim": one(dim, pa.int32()), "shard": one(group.column("shard")[0].as_py(), pa.int32()), "tree": one(pickle.dumps(tree), pa.binary()),
                "centre": one(tree.centre[0].tolist(), pa.list_(pa.float64())), "radius": one(float(tree.radius[0]), pa.float64()),
            }
        )

    trees = written(cut.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, tree binary, centre array<double>, radius double"))

    told = asked.withColumn("dim", F.size("v")).join(F.broadcast(trees.select("dim").distinct()), "dim")
    blocks, asking = dealt(told, places, block, "block")  # queries near each other ask together
    if not asking:
        return candidates.sparkSession.createDataFrame([], HITS)
    # a block is bounded by construction; its vectors stay together
    blocks = written(blocks.groupBy("dim", "block").agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("q")))
    home = blocks.select("dim", "block", F.pmod("block", of[F.col("dim")]).cast("int").alias("shard"))
    none = blocks.withColumn("floor", F.lit(None).cast("array<struct<query:bigint,score:bigint>>"))
    hits = written(visited(home, none, trees, k))
    if max(shards.values()) > 1:
        done = home
        for most in (NEAREST, None):
            floors = with_floors(blocks, hits, k)
            pairs = written(promising(floors, trees, asking, shards).join(done, ["dim", "block", "shard"], "left_anti"))
            if most is not None:  # the shards of one block
                turn = F.row_number().over(Window.partitionBy("dim", "block").orderBy(F.col("bound").desc(), "shard"))
                pairs = written(pairs.withColumn("_turn", turn).filter(F.col("_turn") <= most).drop("_turn"))
                done = done.union(pairs.select("dim", "block", "shard"))
            hits = hits.unionByName(written(visited(pairs.select("dim", "block", "shard"), floors, trees, k)))
    return best_of(hits, k).select("query", "rank", "id", "score")


def places_of(points: DataFrame, shard: int) -> dict[int, np.ndarray]:
    """For each length of vectors, places: vectors far apart by turns out of a bounded sample (``SAMPLE`` rows a length at most).
    They only decide who lies with whom. The driver gets the sample and a count a length."""
    sizes = {r["dim"]: r["n"] for r in points.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    if not sizes or max(sizes.values()) <= shard:
        return {}
    rate = F.create_map(*[F.lit(x) for d, n in sizes.items() for x in (d, 2 * SAMPLE / n * 1_000_000)])
    some = points.filter(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1_000_000)) < rate[F.col("dim")])
    turn = Window.partitionBy("dim").orderBy(F.xxhash64("id", "v"), "id")
    sample: dict[int, list] = {}
    for r in some.withColumn("_n", F.row_number().over(turn)).filter(F.col("_n") <= SAMPLE).select("dim", "v").collect():
        sample.setdefault(r["dim"], []).append(r["v"])
    return {d: spread(np.array(v, float), min(PLACES, -(-sizes[d] // shard))) for d, v in sample.items()}


def dealt(points: DataFrame, places: dict[int, np.ndarray], most: int, to: str) -> tuple[DataFrame, dict[int, int]]:
    """``points`` with the number of their part in ``to``, and the number of parts of each length of vectors. A place with
    more than ``most`` rows is split by hash, small ones next to each other in the list share a part. The driver gets a
    count a place."""

    def nearest(batches):
        for b in batches:
            dims, out = b.column("dim").to_numpy(), np.zeros(b.num_rows, np.int32)
            for d in np.unique(dims).tolist():
                if d in places and len(places[d]) > 1:
                    at = np.flatnonzero(dims == d)
                    v, c = _vectors(b.column("v").take(pa.array(at)), d).astype(float), places[d]
                    out[at] = ((c**2).sum(1)[None, :] - 2 * v @ c.T).argmin(1)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("id", "v", "dim")), pa.array(out)], ["id", "v", "dim", "place"])

    placed = written(points.select("id", "v", "dim").mapInArrow(nearest, "id long, v array<long>, dim int, place int"))
    rows, ends = [], {}
    for d, place, n in sorted(placed.groupBy("dim", "place").agg(F.count("*").alias("n")).collect()):
        at, filled = ends.get(d, (0, 0))
        if filled and filled + n > most:
            at, filled = at + 1, 0
        parts = max(1, -(-n // most))
        rows.append((d, place, at, parts))
        ends[d] = (at + parts, 0) if n > most else (at, filled + n)
    table = points.sparkSession.createDataFrame(rows, "dim int, place int, first int, parts int")
    own = (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int")  # a row a place at most in the table
    return placed.join(F.broadcast(table), ["dim", "place"]).select("id", "v", "dim", own.alias(to)), {d: at + (filled > 0) for d, (at, filled) in ends.items()}


def spread(sample: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` rows of the sample: each next one is the farthest from those before it."""
    chosen, away = [0], ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < most and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def _vectors(v: pa.ListArray, dim: int) -> np.ndarray:
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), dim)


def best_of(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")  # limited to k per task before the shuffle
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def with_floors(blocks: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """Blocks with ``floor``: the k-th score of each of their queries that has one so far."""
    kth = best_of(hits, k).filter(F.col("rank") == k).select("query", "score")
    floors = kth.join(blocks.select("block", "dim", F.explode("q.id").alias("query")), "query").groupBy("dim", "block").agg(F.collect_list(F.struct("query", "score")).alias("floor"))
    return written(blocks.join(floors, ["dim", "block"], "left"))


def _asked(q: pa.Array, floor: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vectors and floors of one block's queries."""
    ids = q.field("id").to_numpy(zero_copy_only=False)
    v = q.field("v")
    known = dict(zip(floor.field("query").to_pylist(), floor.field("score").to_pylist(), strict=True)) if floor is not None else {}
    return ids, _vectors(v, len(v[0])), np.array([known.get(i, LEAST) for i in ids.tolist()], np.int64)


def _block(column: pa.Array, at: int) -> pa.Array | None:
    return column[at].values if column[at].is_valid else None


def promising(blocks: DataFrame, trees: DataFrame, asking: dict[int, int], shards: dict[int, int]) -> DataFrame:
    """(dim, block, shard, bound): pairs where the bound of the shard's root reaches the floor of one of the block's queries;
    ``bound``: the greatest excess over a floor. Roots come in groups of bounded size, which meet every block."""
    root = F.struct("shard", "centre", "radius")
    roots = trees.groupBy("dim", F.floor(F.col("shard") / ROOTS).cast("int").alias("group")).agg(F.collect_list(root).alias("roots"))
    # every group of roots has a copy for each ``TOGETHER`` blocks, so no key has all blocks
    of = lambda n: F.create_map(*[F.lit(x) for pair in n.items() for x in pair])[F.col("dim")]
    copies, groups = {d: -(-n // TOGETHER) for d, n in asking.items()}, {d: -(-n // ROOTS) for d, n in shards.items() if d in asking}
    roots = roots.filter(F.col("dim").isin(*asking)).withColumn("copy", F.explode(F.sequence(F.lit(0), of(copies) - 1)))
    asked = blocks.withColumn("copy", F.floor(F.col("block") / TOGETHER).cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0), of(groups) - 1)))

    def bounds(batches):
        for b in (whole.slice(at, 1) for whole in batches for at in range(whole.num_rows)):
            dim = b.column("dim")[0].as_py()
            ids, q, floor = _asked(b.column("q")[0].values, _block(b.column("floor"), 0))
            r = b.column("roots")[0].values
            centre, radius, shard = _vectors(r.field("centre"), dim), r.field("radius").to_numpy(), r.field("shard").to_numpy()
            q = q.astype(float)
            bound = q @ centre.T + np.sqrt((q**2).sum(1))[:, None] * (1 + 1e-9) * radius[None, :]
            over = (np.maximum(bound + np.abs(bound) * 1e-9, LEAST) - floor[:, None].astype(float)).max(0)
            good = over >= 0
            n = int(good.sum())
            same = lambda name, b=b, n=n: pa.array([b.column(name)[0].as_py()] * n, pa.int32())
            yield pa.RecordBatch.from_arrays([same("dim"), same("block"), pa.array(shard[good], pa.int32()), pa.array(over[good], pa.float64())], ["dim", "block", "shard", "bound"])

    return asked.join(roots, ["dim", "group", "copy"]).select("dim", "block", "q", "floor", "roots").mapInArrow(bounds, "dim int, block int, shard int, bound double")


def visited(pairs: DataFrame, blocks: DataFrame, trees: DataFrame, k: int) -> DataFrame:
    """Hits of each (dim, block, shard): at most k for each query."""
    pairs = pairs.withColumn("part", F.floor(F.col("block") / TOGETHER).cast("int"))
    told = pairs.select("dim", "shard", "part").distinct().join(trees.select("dim", "shard", "tree"), ["dim", "shard"])
    asked = pairs.join(blocks.select("dim", "block", "q", "floor"), ["dim", "block"])
    both = told.withColumn("block", F.lit(-1)).unionByName(asked, allowMissingColumns=True)
    both = both.repartition("dim", "shard", "part").sortWithinPartitions("dim", "shard", "part", "block")  # the tree first

    def visit(batches):
        tree = None
        for b in (whole.slice(at, 1) for whole in batches for at in range(whole.num_rows)):
            if b.column("tree")[0].is_valid:
                tree = pickle.loads(b.column("tree")[0].as_py())
                continue
            ids, q, floor = _asked(b.column("q")[0].values, _block(b.column("floor"), 0))
            rows = [(int(i), r + 1, c, s) for i, found in zip(ids, tree.search(ids, q, floor, k), strict=True) for r, (s, c) in enumerate(found)]
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["query", "rank", "id", "score"])

    return both.select("tree", "q", "floor").mapInArrow(visit, HITS)
