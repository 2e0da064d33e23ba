"""Names, candidates, settings and expected files: the bookkeeping of an analysis as joins."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def columns_of(conditions: DataFrame, columns: DataFrame, name: str = "name", col: str = "col") -> DataFrame:
    """``conditions`` with the column of that name, else the first whose name contains theirs, else null.

    A design has few columns and fewer conditions, so both are small; the second look meets unmatched conditions only."""
    exact = conditions.join(columns.groupBy(name).agg(F.min(col).alias(col)), name, "left")
    open_ = exact.filter(F.col(col).isNull()).select(name).distinct()
    near = open_.join(F.broadcast(columns.select(F.col(name).alias("_in"), F.col(col).alias("_near"))), F.col("_in").contains(F.col(name)), "left").groupBy(name).agg(F.min("_near").alias("_near"))
    return exact.join(near, name, "left").select(*conditions.columns, F.coalesce(col, "_near").alias(col))


def contrast(columns: DataFrame, given: Sequence[float] | None, weights: dict[str, float]) -> list[float]:
    """A contrast over a design's columns: the given one if its length fits, else by the names of conditions. One without
    any weight is an error."""
    names = [r["name"] for r in columns.orderBy("col").collect()]  # the columns of one design
    if given is not None and len(given) == len(names):
        return list(given)
    out = [0.0] * len(names)
    for want, w in weights.items():
        at = names.index(want) if want in names else next((k for k, n in enumerate(names) if want in n), None)
        if at is not None:
            out[at] = w
    if not any(out):
        raise ValueError(f"no column of the design is named like {sorted(weights)}")
    return out


def first_existing(rows: DataFrame, keys: Sequence[str], candidates: str, there: DataFrame, path: str = "path") -> DataFrame:
    """(keys, path): of each row's candidates in order the first that ``there`` has; null if it has none."""
    asked = rows.select(*keys, F.posexplode(candidates).alias("_k", path))
    found = asked.join(there.select(path).distinct(), path, "left_semi").groupBy(*keys).agg(F.min_by(path, "_k").alias(path))
    return rows.select(*keys).join(found, list(keys), "left")


def overridden(base: DataFrame, given: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``base`` with each value replaced that ``given`` has for the same keys and isn't null."""
    values = [c for c in base.columns if c not in keys]
    more = given.select(*keys, *[F.col(c).alias(f"_{c}") for c in values if c in given.columns])
    return base.join(more, list(keys), "left").select(*keys, *[F.coalesce(f"_{c}", c).alias(c) if c in given.columns else F.col(c) for c in values])


def conditions(events: DataFrame, name: str, order: Sequence[str], onset: str, duration: str | None = None) -> DataFrame:
    """(name, n, onsets, durations): one row per condition with its onsets in order. A condition's onsets fit one row, as
    they do in a design."""
    entry = F.struct(*order, F.col(onset).alias("_o"), (F.col(duration) if duration else F.lit(0.0)).alias("_d"))
    got = events.groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(entry)).alias("_e"))
    return got.select("name", "n", F.transform("_e", lambda e: e["_o"]).alias("onsets"), F.transform("_e", lambda e: e["_d"]).alias("durations"))


# The prefixes of a segmentation's outputs.
PREFIXES = {"class": "c", "import": "rc", "warped": "wc", "modulated": "mwc"}
SINGLE = {"corrected": "m", "bias": "BiasField_", "inverse": "iy_", "forward": "y_"}


def planned_outputs(rows: DataFrame, file: str, switches: str, tissues: int) -> DataFrame:
    """``rows`` with ``name``, a row per file that the map of switches asks for: tissue maps by number, others once."""
    on = lambda k: F.coalesce(F.element_at(switches, k), F.lit(False))
    maps = [F.when(on(k), F.concat(F.lit(f"{p}{n}"), F.col(file))) for k, p in PREFIXES.items() for n in range(1, tissues + 1)]
    once = [F.when(on(k), F.concat(F.lit(p), F.col(file))) for k, p in SINGLE.items()]
    return rows.select("*", F.explode(F.array_compact(F.array(*maps, *once))).alias("name"))


def parity(expected: DataFrame, there: DataFrame, keys: Sequence[str], strict: bool = False) -> DataFrame:
    """(keys, status): ok, missing or extra. ``strict``: the job fails if anything is missing."""
    both = expected.select(*keys).distinct().withColumn("_e", F.lit(True)).join(there.select(*keys).distinct().withColumn("_t", F.lit(True)), list(keys), "full")
    lost = F.raise_error(F.lit("an expected artefact is missing")).cast("string") if strict else F.lit("missing")
    return both.select(*keys, F.when(F.col("_e").isNull(), "extra").when(F.col("_t").isNull(), lost).otherwise("ok").alias("status"))


def ordered_difference(rows: DataFrame, gone: DataFrame, value: str, order: str) -> DataFrame:
    """(value, place): distinct values that aren't in ``gone``, numbered in the order in which they first came."""
    from voxloom.operators.glm import ranked

    first = rows.groupBy(value).agg(F.min(order).alias("_first")).join(gone.select(value).distinct(), value, "left_anti")
    return ranked(first, "_first", to="place").select(value, "place")


def routed(rows: DataFrame, kind: str, converters: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The rows of each kind through its converter, all results together; kinds without a converter are left out."""
    return reduce(DataFrame.unionByName, (f(rows.filter(F.col(kind) == k)) for k, f in converters.items()))


def latest(files: DataFrame, by: Sequence[str], path: str = "path", changed: str = "modificationTime") -> DataFrame:
    """(by, path): the newest file of each group, the first by name where times are equal."""
    w = Window.partitionBy(*by).orderBy(F.col(changed).desc(), path)
    return files.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(*by, path)
