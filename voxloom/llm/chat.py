"""Chat formatting of reply trees.

Nodes form trees by ``parent_id``. Self-joins that double their reach enumerate the path from every leaf up to its
root (a path of length n takes about log2 n joins, however long the longest is), branches of a tree are ranked by mean
score, and each chosen path is formatted as one conversation with spans that mark what is trained on.

Template: every turn is ``### role: text</turn>`` and a line feed. Inside roles and texts, backslash, number sign,
less-than sign and colon become backslash plus ``b``, ``h``, ``l``, ``c``; no control string can then occur in them,
and the inverse replacements restore them exactly.

Defined results: null text and null role are empty; a node whose parent is missing is a root; rows without a tree or node
id belong to no conversation; a node id that repeats in a tree keeps its smallest row; cycles have no leaf and are
left out; ties in rank go to the smaller leaf id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxloom.llm.common import written

TURN_START, TURN_END = "### ", "</turn>\n"
NO_SPANS = "cast(array() as array<struct<start:bigint,end:bigint>>)"
#: Escapes, in the order in which they are applied; undone in reverse.
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def linear_nodes(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Nodes of conversations that are plain lists of turns: each turn answers the one before it. Repeated turns
    are ordered by role, then by text."""
    w = Window.partitionBy("tree_id").orderBy(F.col("_turn").asc_nulls_first(), "role", "text")
    nodes = rows.filter(F.col(conversation).isNotNull()).select(
        F.col(conversation).alias("tree_id"),
        F.col(turn).alias("_turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    nodes = nodes.withColumn("node_id", F.row_number().over(w).cast("long"))
    return nodes.select("tree_id", "node_id", (F.col("node_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def branches(nodes: DataFrame, best: int = 1) -> DataFrame:
    """(tree_id, leaf_id, node_id, distance from the leaf, branch rank) of the ``best`` root-to-leaf paths per tree."""
    ids = nodes.filter(F.col("tree_id").isNotNull() & F.col("node_id").isNotNull())
    row = F.struct(F.col("parent_id").alias("parent_id"), F.coalesce("score", F.lit(0.0)).alias("score"))
    ids = ids.groupBy("tree_id", "node_id").agg(F.min(row).alias("row"))
    ids = written(ids.select("tree_id", "node_id", "row.parent_id", "row.score"))
    here = ids.select("tree_id", F.col("node_id").alias("parent_id"))
    hops = [written(ids.join(here, ["tree_id", "parent_id"]).select("tree_id", "node_id", F.col("parent_id").alias("up")))]
    nodes_in_all = ids.count()
    while (left := hops[-1].limit(1).count()) and 2 ** (len(hops) - 1) < nodes_in_all:
        again = hops[-1].select("tree_id", F.col("node_id").alias("up"), F.col("up").alias("_to"))
        hops.append(written(hops[-1].join(again, ["tree_id", "up"]).select("tree_id", "node_id", F.col("_to").alias("up"))))
    leaves = ids.join(hops[0].select("tree_id", F.col("up").alias("node_id")).distinct(), ["tree_id", "node_id"], "left_anti")
    if left:  # the last hop jumps as many replies as there are nodes or more: only a path that runs into a cycle has it
        leaves = leaves.join(hops[-1].select("tree_id", "node_id"), ["tree_id", "node_id"], "left_anti")
    paths = leaves.select("tree_id", F.col("node_id").alias("leaf_id"), "node_id", F.lit(0).cast("long").alias("distance"))
    for k, hop in enumerate(hops):
        # every path known so far, carried 2^k replies further up
        above = paths.join(hop, ["tree_id", "node_id"]).select("tree_id", "leaf_id", F.col("up").alias("node_id"), (F.col("distance") + 2**k).alias("distance"))
        paths = written(paths.unionByName(above))
    scored = paths.join(ids.select("tree_id", "node_id", "score"), ["tree_id", "node_id"])
    rank = Window.partitionBy("tree_id").orderBy(F.col("branch_score").desc(), "leaf_id")
    chosen = scored.groupBy("tree_id", "leaf_id").agg(F.avg("score").alias("branch_score")).withColumn("branch", F.row_number().over(rank)).filter(F.col("branch") <= best)
    return paths.join(chosen.select("tree_id", "leaf_id", "branch"), ["tree_id", "leaf_id"])


def format_paths(nodes: DataFrame, best: int = 1, trained: str = "assistant") -> DataFrame:
    """(tree_id, branch, formatted, loss_spans): one conversation per chosen path. ``loss_spans`` are (start, end) in
    code points of ``formatted``, one for each text of role ``trained``."""
    turn = F.struct(F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    once = nodes.groupBy("tree_id", "node_id").agg(F.min(turn).alias("turn"))
    on_path = branches(nodes, best).join(once, ["tree_id", "node_id"])
    on_path = on_path.select(
        "tree_id",
        "branch",
        F.struct(
            (-F.col("distance")).alias("at"),
            F.concat(F.lit(TURN_START), escape(F.col("turn.role")), F.lit(": ")).alias("head"),
            escape(F.col("turn.text")).alias("body"),
            (F.col("turn.role") == trained).alias("loss"),
        ).alias("turn"),
    )
    # one group is one conversation, the unit that is formatted
    turns = on_path.groupBy("tree_id", "branch").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    step = lambda acc, t: F.struct(
        (acc["at"] + F.length(t["head"]) + F.length(t["body"]) + len(TURN_END)).cast("long").alias("at"),
        F.concat(
            acc["spans"],
            F.when(
                t["loss"],
                F.array(F.struct((acc["at"] + F.length(t["head"])).cast("long").alias("start"), (acc["at"] + F.length(t["head"]) + F.length(t["body"])).cast("long").alias("end"))),
            ).otherwise(F.expr(NO_SPANS)),
        ).alias("spans"),
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr(NO_SPANS).alias("spans"))
    return turns.select(
        "tree_id",
        "branch",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(TURN_END))), "").alias("formatted"),
        F.aggregate("turns", start, step, lambda acc: acc["spans"]).alias("loss_spans"),
    )


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, as they were before formatting."""
    blocks = F.filter(F.split(formatted, F.lit("</turn>\n")), lambda b: b != "")
    one = lambda b: F.struct(
        unescape(F.substring_index(F.substr(b, F.lit(len(TURN_START) + 1)), ": ", 1)).alias("role"),
        unescape(F.substr(b, F.instr(b, ": ") + F.lit(2))).alias("text"),
    )
    return F.transform(blocks, one)


def under_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
