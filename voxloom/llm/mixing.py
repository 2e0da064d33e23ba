"""Mixing sources to target weights, in DataFrame and SQL functions only.

Temperature mixing: with p the sources' shares of all tokens, source weights are w = p^t / sum p^t. A lower t flattens
the mixture. t is the largest exponent in [0, 1] at which the mixture's entropy reaches a target or, with a repetition
limit, the smallest at which no source is repeated more than so often; it is found by bisection, several halvings per
pass over the small table of sources.

The weights are then realised as block permutations. Each source's documents are dealt by hash into blocks of about
``block_docs`` documents, so that no task holds a whole source. The source's stream is laid out in copies, as many as
its budget asks for, the last one in part; every copy has its blocks, and each block its documents, in a new order. A
document's place in that stream, as a share of the source's budget, gives its place in the mixture. The mixture is read in
steps of ``step_tokens`` tokens, and every step holds each source in its weight.

Defined results: a null source is a source of its own, named null; a text without words counts no tokens, takes no
budget and appears once, at place 0; repeated rows are separate documents; no rows, no mixture; the budget defaults to the
smallest at which every document appears at least once, so nothing is dropped then. Columns named ``mix_...`` as below are
replaced; all others are carried along, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxloom.llm.common import quoted, written

#: Halvings of the exponent's interval in one pass, and passes.
HALVINGS, PASSES = 4, 8
#: Blocks that are summed up in one go.
RUN = 1024
MIX = ("mix_tokens", "mix_copy", "mix_place", "mix_step", "mix_weight")


def uniform(*key: Column) -> Column:
    """A hash of the key as a number from 0 to under 1."""
    return F.shiftrightunsigned(F.xxhash64(*key), 33).cast("double") / float(2**31)


def token_count(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def shares(rows: DataFrame, source: str, tokens: str) -> DataFrame:
    """(source, tokens, docs, share) of the sources that have tokens."""
    sums = written(rows.groupBy(source).agg(F.sum(tokens).alias("tokens"), F.count("*").alias("docs")).filter(F.col("tokens") > 0))
    total = sums.agg(F.sum("tokens")).first()[0] or 1
    return sums.select(F.col(source).alias("source"), "tokens", "docs", (F.col("tokens") / F.lit(float(total))).alias("share"))


def exponent(sources: DataFrame, entropy: float | None = None, repeats: float | None = None) -> float:
    """The exponent t in [0, 1].

    ``entropy``: share of the greatest possible entropy that the mixture must reach; t is as large as that allows.
    ``repeats``: the most that one source may be repeated relative to the least repeated one; t is as small as that allows.
    """
    if (entropy is None) == (repeats is None):
        raise ValueError("give a target entropy or a repetition limit")
    lo, hi = 0.0, 1.0
    steps = 2**HALVINGS
    logs = sources.select(F.log("share").alias("l"))
    for _ in range(PASSES):
        points = [lo + (hi - lo) * k / steps for k in range(1, steps)]
        at = logs.select("l", F.explode(F.array(*[F.lit(t) for t in points])).alias("t"))
        w = F.exp(F.col("t") * F.col("l"))
        per = at.groupBy("t").agg(F.sum(w).alias("z"), F.sum(w * F.col("t") * F.col("l")).alias("wl"), F.count("*").alias("n"), F.min("l").alias("least"), F.max("l").alias("most"))
        rows = per.orderBy("t").collect()  # one row for each of a few exponents
        if not rows:
            return 1.0
        if entropy is not None:
            ok = [r.t for r in rows if _entropy(r) >= entropy * math.log(r.n) - 1e-12]
            lo, hi = max(ok, default=lo), min((r.t for r in rows if r.t not in ok), default=hi)
        else:
            ok = [r.t for r in rows if (1 - r.t) * (r.most - r.least) <= math.log(repeats) + 1e-12]
            lo, hi = max((r.t for r in rows if r.t not in ok), default=lo), min(ok, default=hi)
    return lo if entropy is not None else hi


def _entropy(r) -> float:
    return math.log(r.z) - r.wl / r.z


def mixture(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", entropy: float | None = None, repeats: float | None = None, budget: float | None = None, block_docs: int = 512, step_tokens: int = 1_000_000, seed: int = 17) -> DataFrame:
    """The rows of ``docs``, each once per appearance, with mix_tokens, mix_copy (from 0), mix_place (0 to 1), mix_step and
    mix_weight (of the row's source). ``budget`` in tokens. Only the columns that are used later travel."""
    name = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))  # null apart from any name
    spread = uniform(F.col(key), F.col(text), F.lit(seed))
    small = written(docs.select(name.alias("_source"), spread.alias("_spread"), token_count(F.col(text)).alias("_tokens")))
    sources = shares(small, "_source", "_tokens")
    t = exponent(sources, entropy, repeats)
    power = F.exp(F.lit(t) * F.log("share"))
    z = sources.agg(F.sum(power)).first()[0] or 1.0
    weighted = sources.withColumn("weight", power / F.lit(z))
    if budget is None:  # the smallest that uses every source once
        budget = weighted.agg(F.max(F.col("tokens") / F.col("weight"))).first()[0] or 1.0
    quota = F.col("weight") * F.lit(float(budget))
    quota = written(
        weighted.select(
            F.col("source").alias("_source"),
            F.col("tokens").alias("_all"),
            F.col("weight").alias("mix_weight"),
            (quota - F.least(quota * 1e-9, F.lit(0.5))).alias("_quota"),  # rounding gives no extra copy, and no document is lost
            F.ceil(F.col("docs") / block_docs).alias("_blocks"),
        ).withColumn("_copies", F.greatest(F.ceil(F.col("_quota") / F.col("_all")), F.lit(1)).cast("int"))
    )
    # texts without tokens have no order: they are dealt out apart, wherever they are
    block = F.when(F.col("_tokens") > 0, F.floor(F.col("_spread") * F.col("_blocks"))).otherwise(-1 - F.floor(F.rand(seed) * 1_048_576)).cast("long").alias("_block")
    # tokens of the blocks before each one in each copy: running sums over runs of blocks, then within each run, so that
    # no task holds a whole source however many blocks it has
    blocks = small.filter(F.col("_tokens") > 0).join(quota, "_source").select("_source", F.floor(F.col("_spread") * F.col("_blocks")).alias("_block"), "_tokens", "_blocks", "_copies")
    blocks = blocks.groupBy("_source", "_block", "_blocks", "_copies").agg(F.sum("_tokens").alias("_in"))
    blocks = blocks.withColumn("mix_copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).withColumn("_at", uniform(F.col("mix_copy"), F.col("_block"), F.lit(seed)))
    blocks = written(blocks.select("_source", "_block", "mix_copy", "_in", "_at", F.floor(F.col("_at") * F.ceil(F.col("_blocks") / RUN)).alias("_run")))
    earlier = lambda *keys, by: F.coalesce(F.sum("_in").over(Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = blocks.groupBy("_source", "mix_copy", "_run").agg(F.sum("_in").alias("_in")).select("_source", "mix_copy", "_run", earlier("_source", "mix_copy", by=["_run"]).alias("_before"))
    inside = blocks.select("_source", "mix_copy", "_run", "_block", earlier("_source", "mix_copy", "_run", by=["_at", "_block"]).alias("_earlier"))
    blocks = written(inside.join(runs, ["_source", "mix_copy", "_run"]).select("_source", "mix_copy", "_block", (F.col("_before") + F.col("_earlier")).alias("_earlier")))

    own = {f"_c{k}": c for k, c in enumerate(docs.columns) if c.lower() not in MIX}
    rows = docs.select(*[quoted(c).alias(n) for n, c in own.items()], name.alias("_source"), spread.alias("_spread"), token_count(F.col(text)).alias("_tokens"), F.xxhash64(key, text).alias("_tie"))
    rows = rows.join(quota, "_source", "left").withColumn("_block", block)
    counted = F.col("_tokens") > 0
    rows = rows.withColumn("mix_copy", F.explode(F.sequence(F.lit(0), F.when(counted, F.col("_copies")).otherwise(1) - 1)))
    order = [uniform(F.col("mix_copy"), F.col("_spread"), F.lit(seed)), "_tie"]
    within = Window.partitionBy("_source", "_block", "mix_copy").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_upto", F.sum("_tokens").over(within)).join(blocks, ["_source", "mix_copy", "_block"], "left")
    start = F.col("mix_copy") * F.col("_all") + F.col("_earlier") + F.col("_upto") - F.col("_tokens")
    rows = rows.filter(~counted | (start < F.col("_quota")))
    steps = max(1, -(-int(budget) // step_tokens))
    rows = rows.withColumn("mix_place", F.when(counted, F.least(start / F.col("_quota"), F.lit(1.0))).otherwise(F.lit(0.0)))
    rows = rows.withColumn("mix_step", F.least(F.floor(F.col("mix_place") * steps), F.lit(steps - 1)).cast("long"))
    return rows.select(*[F.col(n).alias(c) for n, c in own.items()], F.col("_tokens").alias("mix_tokens"), "mix_copy", "mix_place", "mix_step", "mix_weight")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mixture has it; columns unchanged."""
    return mixture(docs, **options).select(*docs.columns)
