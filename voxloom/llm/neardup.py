"""Near-duplicate groups by a chosen-path set similarity join.

A document is the set of its distinct word shingles (64-bit hashes); two documents are linked when the Jaccard similarity
of their full sets reaches a threshold, and a group is a connected component of links.

Equal sets become one node first. Every node gets a minwise signature. Independent trees then branch it: at each tree
node a few coordinates are chosen by a hash of that node, and the document goes to the child named by its minwise token
at each of them. Tree nodes of at most ``small`` documents are compared exhaustively. In a larger one every member is
held against one of them, the hub; if most resemble it, branching no longer separates anything: they are linked to
the hub, and only the others are compared with all. Any other large node branches again; one that is left after the last
level is treated like the former. All such comparisons run in cells of bounded size, so no cap drops a pair.

The comparison of a tree node uses set sizes (exact) and signature bits; a pair at the threshold fails these with a
probability under 2e-9, a more similar one less often (``bits_lost`` gives the figure). It yields candidate clusters,
which hold every other linked pair that some tree brought together. Links are then confirmed on full sets and set sizes
alone, bits only put the comparisons in order, and in the same way: small clusters exhaustively; in a large one all members against a few hubs, then those
that are still apart from its main part against all others. Both steps return the links of a spanning forest only, so
a group of n copies costs about n comparisons and rows, not its pairs.

With ``trees`` trees of two coordinates each, all different, a pair of similarity s is missed at the first level with
probability (1 - s)^(2 trees): 1e-10 for six trees and s = 0.85, 4e-9 for s = 0.8.

Defined results: a text that is null or has no words has an empty set and is its own group; with fewer words than a
shingle the whole sequence is one shingle; rows with equal ids are one node; a null id is kept and belongs to no group.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import trimmed, written

#: Minwise hashes in all, and those of which the tokens are kept for branching; of all of them two bits are kept.
COORDINATES, BITS = 64, 128
#: The bits in two planes of two words each.
PLANES = ("s0", "s1", "s2", "s3")
#: Least number of hashes with equal bits: a similarity s gives a share of s + (1 - s) / 4 on average. So many deviations
#: below.
BIT_SLACK = 6.0
#: Members of a large cluster that all others are held against first.
HUBS = 8
#: What a member of a tree node carries into the comparison.
CELL = ("node", "members", "id", "n", *PLANES)
_RNG = np.random.default_rng(20_240_229)
_MULTIPLY = _RNG.integers(1, 2**63, BITS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, BITS, dtype=np.uint64)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _MIX
    return h ^ (h >> np.uint64(29))


class Shingler:
    """Sorted distinct shingle hashes of a text; word hashes are kept in a bounded memo."""

    def __init__(self, words: int, memo: int = 100_000):
        self.words, self.memo, self.known = words, memo, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > self.memo:
            self.known.clear()
        known = self.known
        h = np.array([known[w] if w in known else known.setdefault(w, xxhash.xxh64_intdigest(w)) for w in words], np.uint64)
        width = min(self.words, len(h))
        out = np.full(len(h) - width + 1, width, np.uint64)
        for k in range(width):
            out = _mixed(out + h[k : len(h) - width + 1 + k])
        return np.unique(out)


def signature(shingles: np.ndarray) -> tuple[bytes, tuple[int, ...]]:
    """COORDINATES minwise tokens (4 bytes each), and two bits of each of the BITS hashes as PLANES of signed longs."""
    low = np.full(BITS, np.iinfo(np.uint64).max, np.uint64)
    for s in range(0, len(shingles), 4096):  # blocks keep memory flat for very long texts
        block = shingles[s : s + 4096]
        for f in range(0, BITS, 32):
            part = block[:, None] * _MULTIPLY[None, f : f + 32] + _ADD[None, f : f + 32]
            low[f : f + 32] = np.minimum(low[f : f + 32], part.min(0))
    mixed = _mixed(low)
    bits = np.packbits(np.concatenate([mixed >> np.uint64(40), mixed >> np.uint64(41)]).astype(np.uint8) & 1)
    return (mixed[:COORDINATES] >> np.uint64(32)).astype(np.uint32).tobytes(), tuple(np.frombuffer(bits.tobytes(), np.int64).tolist())


def signatures(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(id, n, same, tokens, PLANES): set size, fingerprint of the full set, signature; one row per document."""

    def run(batches):
        shingler = Shingler(words)
        for b in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            out: list[list] = [[] for _ in range(3 + len(PLANES))]
            for t in b.column(1).to_pylist():
                x = shingler(t)
                tokens, bits = signature(x)
                same = hashlib.blake2b(x.tobytes(), digest_size=16).digest()
                for column, v in zip(out, (len(x), same, tokens, *bits), strict=True):
                    column.append(v)
            kinds = (pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * len(PLANES))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], ["id", "n", "same", "tokens", *PLANES])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(lambda b: trimmed(run(b)), "id long, n long, same binary, tokens binary, " + ", ".join(f"{p} long" for p in PLANES))


def _token(at: Column) -> Column:
    return F.substring(F.col("tokens"), 4 * at + 1, F.lit(4))


def _children(rows: DataFrame, node: Column, branches: int, pick: Column | None = None) -> DataFrame:
    """Each row at ``branches`` children of ``node``, named by the tokens at chosen coordinates: by ``pick``, or by a hash
    of the node."""
    # distinct coordinates: one in each of `branches` equal strips
    strip = COORDINATES // branches
    picks = [F.pmod(F.xxhash64(node, F.lit(j)) if pick is None else pick, F.lit(strip)).cast("int") + j * strip for j in range(branches)]
    names = F.array(*[F.xxhash64(node, p, _token(p)) for p in picks])
    return rows.select(F.explode(names).alias("node"), "id", "n", *PLANES)


def _equal_share(threshold: int) -> float:
    return threshold / 100 + (1 - threshold / 100) / 4


def least_equal_bits(threshold: int) -> int:
    share = _equal_share(threshold)
    return int(BITS * share - BIT_SLACK * (BITS * share * (1 - share)) ** 0.5)


def bits_lost(threshold: int) -> float:
    """Probability that a pair exactly at the threshold has fewer equal bits than asked for."""
    share = _equal_share(threshold)
    return sum(math.comb(BITS, k) * share**k * (1 - share) ** (BITS - k) for k in range(least_equal_bits(threshold)))


def _plausible(threshold: int) -> Column:
    """Of a member and the hub of its node: size filter, exact; and signature bits within BIT_SLACK deviations of what
    the threshold gives."""
    differ = lambda k: F.col(f"s{k}").bitwiseXOR(F.col(f"h{k}"))
    equal = BITS - F.bit_count(differ(0).bitwiseOR(differ(2))) - F.bit_count(differ(1).bitwiseOR(differ(3)))
    sizes = F.least("n", "hn") * 100 >= F.greatest("n", "hn") * threshold
    return sizes & (equal >= least_equal_bits(threshold))


class Forest:
    """Union-find over the rows of one block; keeps the links that joined two trees."""

    def __init__(self, n: int):
        self.up, self.links = list(range(n)), []

    def root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def join(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.links.append((a, b))


def likely_pairs(n: np.ndarray, bits: np.ndarray, threshold: int, least_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a block that pass the size filter and have ``least_bits`` equal bits, likeliest first."""
    if len(n) == 2:
        i, j = np.array([0]), np.array([1])
    else:
        i, j = np.triu_indices(len(n), 1)
    ok = np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * threshold
    i, j = i[ok], j[ok]
    x = bits[i] ^ bits[j]
    differ = np.bitwise_count((x[:, :2] | x[:, 2:]).view(np.uint64)).sum(1, dtype=np.int64)  # of an int64 numpy counts the absolute value's bits
    ok = BITS - differ >= least_bits
    i, j, differ = i[ok], j[ok], differ[ok]
    order = np.argsort(differ, kind="stable")
    return i[order], j[order]


def blocks_of(batches, keys: int):
    """The rows of each run of equal leading key columns, as a pyarrow table. Input is sorted by them."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        if rest is not None:
            t = pa.concat_tables([rest, t])
        if not len(t):
            continue
        new = np.zeros(len(t), bool)
        new[0] = True
        for c in range(keys):
            v = t.column(c).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(new)
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            yield t.slice(s, e - s)
        rest = t.slice(starts[-1]).combine_chunks()
    if rest is not None:
        yield rest


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])


def in_cells(rows: DataFrame, block: int) -> DataFrame:
    """Rows in cells (p, q) of bounded size within their group; ``rows`` has id, members, apart and rest.

    A group of at most ``block`` members is one cell of rows with side 0, to be compared with each other. In a larger
    one the ``rest`` rows that are ``apart`` from the group's main part meet all rows: an apart row is on side 0 of its
    block p for every q, and every row is on side 1 of its block q for every p."""
    small = F.col("members") <= block
    p_of = F.pmod(F.xxhash64("id", F.lit(2)), F.greatest(F.ceil(F.col("rest") / block), F.lit(1))).cast("int")
    q_of = F.pmod(F.xxhash64("id", F.lit(3)), F.ceil(F.col("members") / block)).cast("int")
    up_to = lambda n: F.sequence(F.lit(0), (F.ceil(n / block) - 1).cast("int"))
    cell = lambda p, q, side: F.struct(p.alias("p"), q.alias("q"), F.lit(side).alias("side"))
    zero = F.lit(0)
    as_main = F.transform(up_to(F.col("rest")), lambda p: cell(p, q_of, 1))
    as_apart = F.when(F.col("apart"), F.transform(up_to(F.col("members")), lambda q: cell(p_of, q, 0))).otherwise(F.slice(as_main, 1, 0))
    cells = F.when(small, F.array(cell(zero, zero, 0))).otherwise(F.concat(as_main, as_apart))
    return rows.filter(small | (F.col("rest") > 0)).withColumn("_cell", F.explode(cells)).select("*", "_cell.*").drop("_cell")


def _to_compare(i: np.ndarray, j: np.ndarray, side: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which pairs of a cell's rows are to be compared."""
    return (ids[i] != ids[j]) & ((side[i] != side[j]) if side.any() else True)


def likely_links(leaves: DataFrame, threshold: int, block: int = 512) -> DataFrame:
    """Spanning links (a, b) of likely pairs in each tree node. ``leaves``: node, members, rest, apart, id, n, PLANES."""

    def run(batches):
        found: list[tuple[int, int]] = []
        for t in blocks_of(batches, 3):
            if len(t) > 1:
                ids, side = t.column("id").to_numpy(), t.column("side").to_numpy()
                bits = np.stack([t.column(c).to_numpy() for c in PLANES], 1)
                forest = Forest(len(ids))
                i, j = likely_pairs(t.column("n").to_numpy(), bits, threshold, least_equal_bits(threshold))
                ok = _to_compare(i, j, side, ids)
                for a, b in zip(i[ok].tolist(), j[ok].tolist(), strict=True):
                    forest.join(a, b)
                found += [(int(ids[a]), int(ids[b])) for a, b in forest.links]
            if len(found) > 50_000:
                yield _links(found)
                found = []
        yield _links(found)

    cells = in_cells(leaves, block).select("node", "p", "q", "id", "side", "n", *PLANES)
    return cells.repartition("node", "p", "q").sortWithinPartitions("node", "p", "q", "id", "side").mapInArrow(lambda b: trimmed(run(b)), "a long, b long")


def shared_counts(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs (i, j): by incidence matrices in column slices when there are many."""
    if len(i) < 64:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
    used = np.unique(np.concatenate([i, j]))
    at = np.zeros(len(sets), np.int64)
    at[used] = np.arange(len(used))
    row = np.repeat(np.arange(len(used)), [len(sets[k]) for k in used])
    _, column, count = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True, return_counts=True)
    keep = count[column] > 1  # shingles of one document only add nothing
    row, column = row[keep], column[keep]
    _, column = np.unique(column, return_inverse=True)
    width = int(column.max()) + 1 if len(column) else 0
    out = np.zeros((len(used), len(used)), np.float64)
    for s in range(0, width, 8192):
        part = (column >= s) & (column < s + 8192)
        m = np.zeros((len(used), min(8192, width - s)), np.float32)
        m[row[part], column[part] - s] = 1
        out += m @ m.T
    return out[at[i], at[j]].astype(np.int64)


def _linked(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: int) -> np.ndarray:
    """Whether the pairs (i, j) of full sets reach the threshold."""
    n = np.array([len(x) for x in sets])
    both = shared_counts(sets, i, j)
    return 100 * both >= threshold * (n[i] + n[j] - both)


def _members_with_text(docs: DataFrame, members: DataFrame, key: str, text: str, broadcast_bytes: int = 24_000_000) -> DataFrame:
    """``members`` with their texts: found through the ids, broadcast while they are small, joined by shuffle beyond.

    Rows have whole numbers only, so their number bounds their bytes: 8 a column and about 48 for the row and its key."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    few = members.count() * (8 * len(members.columns) + 48) <= broadcast_bytes
    return rows.join(F.broadcast(members) if few else members, "id")


def linked_to_hubs(docs: DataFrame, large: DataFrame, key: str, text: str, words: int, threshold: int, salt: int = 1024) -> DataFrame:
    """(a, b, cluster, slot): the links between large clusters' members and their hubs, of which each cluster has up
    to HUBS. A cluster's members are dealt out in parts of about ``salt`` rows; every part gets the hubs."""
    slot = F.pmod(F.xxhash64("id", F.lit(4)), F.lit(HUBS)).cast("int")
    hubs = large.groupBy("cluster", slot.alias("slot")).agg(F.min(F.struct("id", "members")).alias("hub")).select("cluster", "slot", "hub.id", "hub.members")
    parts = F.ceil(F.col("members") / salt).cast("int")
    asked = hubs.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    # a hub is a member, too; the slot marks the copy that the others are held against
    own = large.select("cluster", F.lit(None).cast("int").alias("slot"), "id", F.pmod(F.xxhash64("id", F.lit(5)), parts).cast("int").alias("part"))
    rows = _members_with_text(docs, own.unionByName(asked.drop("members")), key, text)
    rows = rows.select("cluster", "part", "slot", "id", "text").repartition("cluster", "part").sortWithinPartitions("cluster", "part", F.col("slot").asc_nulls_last(), "id")

    def run(batches):
        shingler = Shingler(words)
        now, hubs = None, []
        for b in batches:
            out: list[list] = [[], [], [], []]
            for cluster, part, slot, i, t in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if (cluster, part) != now:
                    now, hubs = (cluster, part), []
                own = shingler(t)
                if slot is not None:
                    hubs.append((i, slot, own))
                    continue
                for hub, at, other in hubs:
                    if hub == i or (100 * min(len(own), len(other)) >= threshold * max(len(own), len(other)) and _linked([own, other], np.array([0]), np.array([1]), threshold)[0]):
                        for column, v in zip(out, (hub, i, cluster, at), strict=True):
                            column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], ["a", "b", "cluster", "slot"])

    return rows.mapInArrow(lambda b: trimmed(run(b)), "a long, b long, cluster long, slot int")


def _main_part(masks: np.ndarray, counts: np.ndarray) -> int:
    """The hubs of the largest part of a cluster, as a bit mask; masks are the sets of hubs that members are linked to."""
    parts: list[tuple[int, int]] = []
    for mask, n in zip(masks.tolist(), counts.tolist(), strict=True):
        for other in [p for p in parts if p[0] & mask]:
            parts.remove(other)
            mask, n = mask | other[0], n + other[1]
        parts.append((mask, n))
    return max(parts, key=lambda x: (x[1], x[0]))[0] if parts else 0


def apart_from_main(large: DataFrame, links: DataFrame) -> DataFrame:
    """``large`` with apart (not known to be in its cluster's main part) and rest (how many of the cluster are)."""
    mask = F.bit_or(F.expr("shiftleft(1, slot)")).cast("int")
    masks = written(links.groupBy("cluster", F.col("b").alias("id")).agg(mask.alias("mask")))
    # at most 2^HUBS - 1 different masks in a cluster
    kinds = masks.groupBy("cluster", "mask").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("mask", "n"))).alias("kinds"))

    @F.pandas_udf("int")
    def main(kinds: pd.Series) -> pd.Series:
        return pd.Series([_main_part(np.array([k["mask"] for k in ks]), np.array([k["n"] for k in ks])) for ks in kinds], dtype="int32")

    mains = written(kinds.select("cluster", main("kinds").alias("main")))
    known = masks.join(mains, "cluster").filter(F.col("mask").bitwiseAND(F.col("main")) > 0).select("cluster", "id", F.lit(False).alias("apart"))
    marked = written(large.join(known, ["cluster", "id"], "left").withColumn("apart", F.coalesce("apart", F.lit(True))))
    return marked.join(marked.groupBy("cluster").agg(F.count_if("apart").alias("rest")), "cluster")


def confirmed(docs: DataFrame, members: DataFrame, key: str, text: str, words: int, threshold: int, block: int = 128) -> DataFrame:
    """Spanning links (a, b) of pairs whose full sets reach the threshold, within each cluster.

    ``members``: id, cluster, members, n, PLANES. In a cluster of more than ``block``, every member is first held
    against a few hubs; only members that this leaves apart from the main part are then compared with all others."""
    small = members.filter(F.col("members") <= block)
    small = small.select("*", F.lit(True).alias("apart"), F.col("members").alias("rest"))
    large = members.filter(F.col("members") > block)
    stars = None
    todo = small
    if large.limit(1).count():
        stars = written(linked_to_hubs(docs, large.select("cluster", "id", "members"), key, text, words, threshold))
        todo = small.unionByName(apart_from_main(large, stars).filter(F.col("rest") > 0))

    def run(batches):
        shingler = Shingler(words)
        for t in blocks_of(batches, 3):
            ids, side = t.column("id").to_numpy(), t.column("side").to_numpy()
            n = t.column("n").to_numpy()
            bits = np.stack([t.column(c).to_numpy() for c in PLANES], 1)
            i, j = likely_pairs(n, bits, threshold, 0) if len(ids) > 1 else (np.zeros(0, int), np.zeros(0, int))
            ok = _to_compare(i, j, side, ids)
            i, j = i[ok], j[ok]
            used = np.unique(np.concatenate([i, j]))
            full = [np.zeros(0, np.uint64)] * len(ids)
            for k in used.tolist():
                full[k] = shingler(t.column("text")[k].as_py())
            forest = Forest(len(ids))
            step = 256
            while len(i):  # pairs whose ends have met need no count
                head, (i, j) = (i[:step], j[:step]), (i[step:], j[step:])
                yes = _linked(full, *head, threshold)
                for a, b in zip(head[0][yes].tolist(), head[1][yes].tolist(), strict=True):
                    forest.join(a, b)
                roots = np.array([forest.root(k) for k in range(len(ids))])
                unmet = roots[i] != roots[j]
                i, j = i[unmet], j[unmet]
                step = 8192
            yield _links([(int(ids[a]), int(ids[b])) for a, b in forest.links])

    rows = _members_with_text(docs, written(in_cells(todo, block).select("cluster", "p", "q", "id", "side", "n", *PLANES)), key, text)
    rows = rows.select("cluster", "p", "q", "id", "side", "n", *PLANES, "text").repartition("cluster", "p", "q").sortWithinPartitions("cluster", "p", "q", "id", "side")
    found = rows.mapInArrow(lambda b: trimmed(run(b)), "a long, b long")
    if stars is None:
        return found
    # of the links to hubs those of a spanning forest: a member to its first hub, and hubs that share a member
    of_member = stars.groupBy("b").agg(F.sort_array(F.collect_set("a")).alias("hubs"))
    chain = F.transform(F.sequence(F.lit(1), F.size("hubs") - 1), lambda k: F.struct(F.element_at("hubs", k).alias("a"), F.element_at("hubs", k + 1).alias("b")))
    chains = of_member.select("hubs").distinct().filter(F.size("hubs") > 1).select(F.explode(chain).alias("x")).select("x.a", "x.b")
    return found.union(of_member.select(F.col("hubs")[0].alias("a"), "b")).union(chains)


def components(links: DataFrame) -> DataFrame:
    """(id, label) for every id in ``links`` (a, b): the smallest id of its component.

    In every round each id hooks on to its neighbour of highest degree (ties by a hash of the round) if that comes before
    itself, takes that one's hook in turn, and the links are contracted to what still leads from one label to another:
    a star is done in one round, and any other shape shrinks to a share of itself."""
    ends = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    links = written(links.filter("a != b").select(*ends("a", "b")).distinct())
    labels, turn = None, 0
    while links.limit(1).count():
        turn += 1
        rank = lambda x, degree, turn=turn: F.struct((-F.col(degree)).alias("d"), F.xxhash64(F.lit(turn), x).alias("h"), F.col(x).alias("id"))
        both = links.union(links.select("b", "a")).toDF("id", "to")
        degrees = both.groupBy("to").agg(F.count("*").alias("degree"))
        near = both.join(degrees, "to").groupBy("id").agg(F.min(rank("to", "degree")).alias("low"), F.count("*").alias("own"))
        hook = written(near.select("id", F.least("low", rank("id", "own"))["id"].alias("up")))
        step = written(hook.join(hook.select(F.col("id").alias("up"), F.col("up").alias("label")), "up").select("id", "label"))
        of = lambda end: step.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label"))  # noqa: E731, B023
        links = written(links.join(of("a"), "a").join(of("b"), "b").filter("a_label != b_label").select(*ends("a_label", "b_label")).distinct())
        if labels is not None:
            further = step.select(F.col("id").alias("label"), F.col("label").alias("_next"))
            step = written(labels.join(further, "label", "left").select("id", F.coalesce("_next", "label").alias("label")))
        labels = step
    if labels is None:
        return links.select(F.col("a").alias("id"), F.col("b").alias("label"))
    least = labels.groupBy("label").agg(F.min("id").alias("least"))
    return labels.join(least, "label").select("id", F.least("id", "least").alias("label"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, threshold: int = 80, trees: int = 6, branches: int = 2, small: int = 64, levels: int = 3, node_block: int = 1024, set_block: int = 128) -> DataFrame:
    """(id, n_shingles, component): ``component`` is the smallest id of the document's group. ``threshold`` in percent."""
    all_rows = written(signatures(docs, key, text, words))
    rows = all_rows.filter((F.col("n") > 0) & F.col("id").isNotNull())
    first = F.min(F.struct("id", "n", "tokens", *PLANES)).alias("first")
    classes = written(rows.groupBy("same").agg(first).select("same", "first.*"))

    # the trees, level by level: who is in which node; tokens stay in `classes` and are joined where a node branches
    roots = classes.withColumn("tree", F.explode(F.array(*[F.lit(t) for t in range(trees)])))
    if trees > COORDINATES // branches:
        raise ValueError("more trees than coordinates")
    at = _children(roots, F.xxhash64(F.lit("root"), "tree"), branches, F.col("tree"))
    leaves, stars = [], []
    for level in range(1, levels + 1):
        at = written(at)
        counts = at.groupBy("node").agg(F.count("*").alias("members"), F.min(F.struct(F.xxhash64("id"), "id", "n", *PLANES)).alias("a")).filter(F.col("members") > 1)
        known = written(at.join(counts.select("node", "members", "a.id", "a.n", *(f"a.{p}" for p in PLANES)).withColumnsRenamed({"id": "h", "n": "hn"} | {p: p.replace("s", "h") for p in PLANES}), "node"))
        leaves.append(known.filter(F.col("members") <= small).select(*CELL, F.lit(True).alias("apart"), F.col("members").alias("rest")))
        # every member of a large node is held against one of them, the hub
        marked = written(known.filter(F.col("members") > small).withColumn("apart", ~_plausible(threshold)))
        if not marked.limit(1).count():
            break
        rest = written(marked.groupBy("node").agg(F.count_if("apart").alias("rest"), F.first("members").alias("_all")))
        last = level == levels
        stay = rest.filter(F.lit(last) | (2 * F.col("rest") <= F.col("_all"))).select("node", "rest")
        marked = marked.join(stay, "node", "left")
        stars.append(marked.filter(F.col("rest").isNotNull() & ~F.col("apart") & (F.col("id") != F.col("h"))).select(F.col("h").alias("a"), F.col("id").alias("b")))
        leaves.append(marked.filter(F.col("rest") > 0).select(*CELL, "apart", "rest"))
        if last:
            break
        at = _children(marked.filter(F.col("rest").isNull()).select(F.col("node").alias("up"), "id").join(classes, "id"), F.col("up"), branches)
    likely = _union([likely_links(_union(leaves), threshold, node_block), *stars]).distinct()

    clusters = components(written(likely))
    sizes = clusters.groupBy("label").agg(F.count("*").alias("members"))
    members = clusters.join(sizes, "label").join(classes.select("id", "n", *PLANES), "id")
    members = written(members.select("id", F.col("label").alias("cluster"), "members", "n", *PLANES))
    labels = components(written(confirmed(docs, members, key, text, words, threshold, set_block).distinct()))

    grouped = classes.select("same", F.col("id").alias("first")).join(labels.withColumnRenamed("id", "first"), "first", "left").select("same", F.coalesce("label", "first").alias("label"))
    by_set = rows.select("id", "n", "same").join(grouped, "same").select("id", F.col("n").alias("n_shingles"), F.col("label").alias("component"))
    alone = all_rows.filter((F.col("n") == 0) | F.col("id").isNull()).select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component"))
    return by_set.unionByName(alone)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def kept_one_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows of a group but those with its smallest id."""
    found = near_duplicates(docs, key, text, **options)
    gone = found.filter(F.col("component") < F.col("id")).select(F.col("id").alias(key)).distinct()
    return docs.join(gone, key, "left_anti")
