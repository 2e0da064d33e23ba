"""Repair of the structure of conversations by a fold over their turns, in DataFrame functions only.

Windows flag the rows: blank, a repeat of an earlier row, or cut off in mid-sentence. Then every conversation's turns are
collected in order, and ``aggregate`` walks over them with four candidates: the cheapest edits so far that leave nothing, a
system turn, a user turn or an assistant turn at the end. A candidate is a struct of cost and edits, so ``least`` picks the
cheaper one and, of equals, the one whose edits come first in ASCII. The result has roles ``(s?(ua)+)?``.

Edits are letters: D delete, I and J insert a user and an assistant turn, K keep, R and S make a turn the user's and the
assistant's. Their order is that of the audit's letters D, I, K, R, and a candidate's roles follow from its edits, so
comparing edits is comparing audits. Two candidates of equal cost never have edits of which one begins the other, since
the longer one would have paid for another insertion; so what comes first stays first, and the fold is exact.

Defined results: a null text or role is one space; a null turn comes first; equal turns are ordered by role, then text;
rows with a null conversation id are one conversation of their own; a conversation without rows (``alive`` false in all)
has zeros, an empty audit and the digest of the empty string; other columns are left out. The whole conversation is one
row, as its repaired text is: it must fit in one task, and edits take time in proportion to the square of its turns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

INSERT, REROLE, DELETE, CUT_OFF = 3, 3, 4, 3
#: Cost of what can't be.
NEVER = 1 << 50
BLACK = r"[^\x20\x09-\x0D]"
STATES = ("none", "s", "u", "a")


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy, alive): rows with planted faults, by crc32 of ``conv_id:turn`` modulo 20. 0 drops
    the row (kept with ``alive`` false, so its conversation stays known), 1 empties the text, 2 takes its full stops,
    exclamation and question marks, 3 repeats the row, 4 makes it the user's. Nulls count as one space."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(spaced("role")).alias("role"), text.alias("text"), (kind != 0).alias("alive"), copies.alias("copies")).select("conv_id", "turn", "role", "text", "alive", F.explode("copies").alias("copy"))


def flagged(rows: DataFrame) -> DataFrame:
    """``rows`` with ``place`` in the conversation, ``fault`` (blank, duplicate, truncated or null) and ``illegal``."""
    own = ["conv_id", "alive"]
    by = [F.col("turn").asc_nulls_first(), "role", "text", "copy"]
    seen = Window.partitionBy(*own, "role", "text").orderBy(*by)
    along = Window.partitionBy(*own).orderBy(*by)
    last = F.regexp_extract("text", rf"({BLACK})[\x20\x09-\x0D]*\z", 1)
    fault = F.when(last == "", "blank").when(F.row_number().over(seen) > 1, "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    initial = F.substring("role", 1, 1)
    pair = F.concat(F.lag(initial).over(along), initial)
    # one exchange by conversation serves both windows and the grouping
    placed = rows.repartition("conv_id").withColumns({"place": F.row_number().over(along), "illegal": F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False))})
    return placed.withColumn("fault", fault)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def after(candidate: Column, letters: str, cost: Column | int) -> Column:
    """The candidate with further edits."""
    return F.struct((candidate["cost"] + cost).alias("cost"), F.concat(candidate["edits"], F.lit(letters)).alias("edits"))


def inserted(now: Column) -> Column:
    """The four candidates after any useful insertions: nothing or a system turn asks for a user turn, that for an
    assistant turn, and that for a user turn."""
    user = F.least(now["u"], after(now["none"], "I", INSERT), after(now["s"], "I", INSERT), after(now["a"], "I", INSERT))
    assistant = F.least(now["a"], after(now["u"], "J", INSERT), after(now["none"], "IJ", 2 * INSERT), after(now["s"], "IJ", 2 * INSERT))
    return F.struct(now["none"].alias("none"), now["s"].alias("s"), user.alias("u"), assistant.alias("a"))


def stepped(now: Column, turn: Column) -> Column:
    """The candidates after one more turn."""
    more = F.when(turn["fault"] == "truncated", CUT_OFF).otherwise(0).cast("long")
    lost = F.when(turn["fault"].isin("blank", "duplicate"), NEVER).otherwise(more)
    initial = F.substring(turn["role"], 1, 1)

    def kept(candidate: Column, role: str) -> Column:
        edit = {"u": "R", "a": "S"}.get(role)
        keep = after(candidate, "K", lost + F.when(initial == role, 0).otherwise(NEVER).cast("long"))
        return F.least(keep, after(candidate, edit, lost + REROLE)) if edit else keep

    def from_closed(c: Column) -> Column:
        before_user = F.least(c["none"], c["s"], c["a"])
        return F.struct(
            after(c["none"], "D", DELETE).alias("none"),
            F.least(after(c["s"], "D", DELETE), kept(c["none"], "s")).alias("s"),
            F.least(after(c["u"], "D", DELETE), let(before_user, lambda b: kept(b, "u"))).alias("u"),
            F.least(after(c["a"], "D", DELETE), kept(c["u"], "a")).alias("a"),
        )

    # sums of what can't be stay far below the largest long
    capped = lambda s: F.struct(*[F.struct(F.least(s[k]["cost"], F.lit(NEVER)).alias("cost"), F.when(s[k]["cost"] < NEVER, s[k]["edits"]).otherwise("").alias("edits")).alias(k) for k in STATES])
    return let(inserted(now), lambda c: let(from_closed(c), capped))


def cheapest(turns: Column) -> Column:
    """The cheapest edits (cost, edits) of an array of turns (role, fault)."""
    start = F.struct(*[F.struct(F.lit(0 if k == "none" else NEVER).cast("long").alias("cost"), F.lit("").alias("edits")).alias(k) for k in STATES])
    return F.aggregate(turns, start, stepped, lambda end: let(inserted(end), lambda c: F.least(c["none"], c["a"])))


def mended(turns: Column, edits: Column) -> Column:
    """The repaired turns as lines ``role:text``: each turn behind the insertions before it, then those at the end."""
    steps = F.regexp_extract_all(edits, F.lit("[IJ]*[DKRS]"), F.lit(0))
    empty = lambda s: F.replace(F.replace(F.regexp_extract(s, "^[IJ]*", 0), F.lit("I"), F.lit("user:\n")), F.lit("J"), F.lit("assistant:\n"))

    def own(turn: Column, step: Column) -> Column:
        edit = F.right(step, F.lit(1))
        role = F.when(edit == "K", turn["role"]).when(edit == "R", "user").otherwise("assistant")
        return F.concat(empty(step), F.when(edit == "D", "").otherwise(F.concat(role, F.lit(":"), turn["text"], F.lit("\n"))))

    lines = F.concat(F.array_join(F.zip_with(turns, steps, own), ""), empty(F.regexp_extract(edits, "[IJ]*$", 0)))
    return F.regexp_replace(lines, r"\n\z", "")  # lines are joined, not ended


def repaired(rows: DataFrame) -> DataFrame:
    """A row a conversation: counts of gaps, faults and illegal neighbours, ``cost``, ``audit`` and the ``repaired`` text.

    ``rows``: (conv_id, turn, role, text, alive, copy), as ``damaged`` gives them."""
    turn = F.struct("place", "role", "text", "fault")
    alive = F.col("alive")
    count = lambda kind: F.count_if(alive & (F.col("fault") == kind)).alias(kind)
    gaps = F.max(F.when(alive, F.col("turn"))) - F.min(F.when(alive, F.col("turn"))) + 1 - F.size(F.collect_set(F.when(alive, F.col("turn"))))
    whole = flagged(rows).groupBy("conv_id").agg(
        F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"),
        *map(count, ("blank", "duplicate", "truncated")),
        F.count_if(alive & F.col("illegal")).alias("illegal"),
        F.sort_array(F.collect_list(F.when(alive, turn))).alias("turns"),
    )
    found = whole.withColumn("best", cheapest(F.transform("turns", lambda t: F.struct(t["role"], t["fault"]))))
    audit = F.translate("best.edits", "JS", "IR")
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", F.col("best.cost").alias("cost"), audit.alias("audit"), mended(F.col("turns"), F.col("best.edits")).alias("repaired"))
