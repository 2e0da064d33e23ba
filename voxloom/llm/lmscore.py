"""Language-model scores from a subword lattice and corpus counts.

Every word has a marginal probability under an existing vocabulary: its scores weight all segmentations, and a forward
recursion in log space adds them up. That distribution over spellings is the prior of a word model learned from the
training documents: P(word) = (c + a L(word)) / (N + a), with c the word's training count, N all training tokens, L the
lattice marginal and a the number of words seen once (the Good-Turing mass of the unseen). Piece probabilities add up to 1
over those that start a word (A) and those that don't (B), and a word is one of the former and any number of the latter,
so L adds up to A / (1 - B) = 1 over all words: P is a probability. In lattice terms each word
has an arc of its own, learned from the corpus, beside its subword arcs, and the document's probability is the sum over
all paths; no arc crosses white space, so it is the product over words and the closing token.

Counts cover all training documents and grow with them: partial counts in each task, one shuffle by word. Words among
the ``common`` most frequent (a table bounded in words and bytes, broadcast) are scored where the text is read; the other words of a
document are joined with the counts by word.

Defined results: null text is empty and has the closing token only; without training documents N is 0, a is 1 and the
prior alone scores; repeated rows are scored row by row.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.llm.common import written
from voxloom.llm.lattice import LITERAL, SPACE, Marginals, Vocabulary

#: The closing token; no word has white space, so none equals it.
END = b" "
NAMES = ("row", "word", "times", "base", "model", "known")
_LATTICES: dict[str, Marginals] = {}


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, as UTF-8; without the closing token."""
    return (text or "").encode("utf-8").lower().split()


def lattice(path: str) -> Marginals:
    if path not in _LATTICES:
        _LATTICES[path] = Marginals(Vocabulary(path))
    return _LATTICES[path]


def word_counts(docs: DataFrame, training: str, text: str = "text", at_once: int = 300_000) -> DataFrame:
    """(word binary, c): training counts of every word of all documents, 0 for those of held-out texts only."""

    def flush(acc):
        return pa.RecordBatch.from_arrays([pa.array(list(acc), pa.binary()), pa.array(list(acc.values()), pa.int64())], ["word", "c"])

    def partial(batches):
        acc: Counter = Counter()
        for b in batches:
            for t, learn in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if learn:
                    acc.update(tokens(t))
                    acc[END] += 1
                else:
                    for w in set(tokens(t)):
                        acc[w] += 0
                    acc[END] += 0
                if len(acc) > at_once:
                    yield flush(acc)
                    acc.clear()
        yield flush(acc)

    return docs.select(text, training).mapInArrow(partial, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def with_prior(counts: DataFrame, path: str) -> DataFrame:
    """Adds ``prior``: the natural log of each word's lattice marginal."""

    def run(batches):
        for b in batches:
            words = [SPACE + w.decode("utf-8").replace(SPACE, LITERAL) if w != END else SPACE for w in b.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("c"), pa.array(lattice(path).log_probability(words), pa.float64())], ["word", "c", "prior"])

    return counts.mapInArrow(run, "word binary, c long, prior double")


#: Bounds of the broadcast table of common words: bytes in all, and of one word.
COMMON_BYTES, LONGEST_COMMON = 8_000_000, 65_536


def _common(words: DataFrame, most: int) -> DataFrame:
    """The most frequent words, at most ``most`` and COMMON_BYTES: those from a count on, which a histogram of the counts'
    logarithms gives (a bounded number of rows, whatever the number of words)."""
    level = F.when(F.col("c") > 0, F.floor(16 * F.log2("c"))).otherwise(-1)
    short = words.filter(F.length("word") <= LONGEST_COMMON).withColumn("_level", level)
    total, size, least = 0, 0, None
    for row in short.groupBy("_level").agg(F.count("*").alias("n"), F.sum(F.length("word")).alias("size")).orderBy(F.col("_level").desc()).collect():
        total, size = total + row["n"], size + row["size"]
        if total > most or size > COMMON_BYTES:
            break
        least = row["_level"]
    return short.filter(F.col("_level") >= least if least is not None else F.lit(False)).drop("_level")


RESULTS = ("n_tokens", "n_known", "train_tokens", "base_score", "lm_score")


def score(docs: DataFrame, training: str, path: str, text: str = "text", common: int = 150_000) -> DataFrame:
    """The columns of ``docs`` but the text, with n_tokens, n_known, train_tokens, base_score (add-one unigram) and
    lm_score, both in log10; columns of ``docs`` with these names are replaced.

    ``training``: a boolean column, true for the documents to learn from."""
    spark = docs.sparkSession
    words = written(with_prior(word_counts(docs, training, text), path))
    n, v, once = words.agg(F.sum("c"), F.count(F.when(F.col("c") > 0, 1)), F.count(F.when(F.col("c") == 1, 1))).first()
    n, a = n or 0, max(1, once)
    base_divisor, model_divisor = math.log10(n + v + 1), math.log10(n + a)
    top = _common(words, common).toPandas()
    c, prior = top.c.to_numpy(float), top.prior.to_numpy(float)
    with np.errstate(divide="ignore"):
        model = np.where(c > 0, np.log10(c + a * np.exp(prior)), math.log10(a) + prior / math.log(10))
    table = spark.sparkContext.broadcast(({w: k for k, w in enumerate(map(bytes, top.word))}, np.stack([np.log10(c + 1), model, (c > 0).astype(float)], 1) if len(c) else np.zeros((0, 3))))
    carried = [name for name in docs.columns if name != text and name not in RESULTS]

    def split(batches):
        """Per document one row with its other columns and the sums over its common words, and one for each other word."""
        index, values = table.value
        for b in batches:
            at_row: list[int | None] = []
            out: list[list] = [[] for _ in range(6)]
            for r, (row, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                count = Counter(tokens(t))
                total = sum(count.values()) + 1
                count[END] += 1
                at = [index.get(w, -1) for w in count]
                times = np.fromiter(count.values(), float, len(count))
                k = np.array(at)
                hit = k >= 0
                sums = times[hit] @ values[k[hit]] if hit.any() else (0.0, 0.0, 0.0)
                rest = [(w, m) for (w, m), j in zip(count.items(), at, strict=True) if j < 0]
                at_row += [r, *[None] * len(rest)]
                out[0] += [row] * (len(rest) + 1)
                # no word holds white space, so a document's own row meets none; its number spreads such rows evenly
                out[1] += [b"  %d" % row, *(w for w, _ in rest)]
                out[2] += [total, *(m for _, m in rest)]
                for column, x in zip(out[3:], sums, strict=True):
                    column += [float(x), *[None] * len(rest)]
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
            where = pa.array(at_row, pa.int64())
            own = [b.column(k).take(where) for k in range(2, b.num_columns)]
            yield pa.RecordBatch.from_arrays([*(pa.array(x, k) for x, k in zip(out, kinds, strict=True)), *own], [*NAMES, *(f"_{k}" for k in range(len(own)))])

    named = [F.col(name).alias(f"_{k}") for k, name in enumerate(carried)]
    # numbered where the rows are split, so the number is made once
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(text).cast("string").alias("text"), *named)
    fields = [T.StructField(name, kind) for name, kind in zip(NAMES, (T.LongType(), T.BinaryType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.DoubleType()), strict=True)]
    parts = rows.mapInArrow(split, T.StructType([*fields, *(T.StructField(f"_{k}", docs.schema[name].dataType) for k, name in enumerate(carried))]))
    joined = parts.join(words, "word", "left")
    whole = F.col("base").isNotNull()
    of_word = F.when(F.col("c") > 0, F.log10(F.col("c") + F.lit(float(a)) * F.exp("prior"))).otherwise(F.lit(math.log10(a)) + F.col("prior") / math.log(10))
    sums = joined.groupBy("row").agg(
        F.first(F.when(whole, F.struct(F.lit(0).alias("_"), *(f"_{k}" for k in range(len(carried))))), ignorenulls=True).alias("own"),
        F.sum(F.when(whole, F.col("times"))).alias("n_tokens"),
        F.sum(F.when(whole, F.col("known").cast("long")).otherwise(F.when(F.col("c") > 0, F.col("times")).otherwise(0))).cast("long").alias("n_known"),
        F.sum(F.when(whole, F.col("base")).otherwise(F.col("times") * F.log10(F.col("c") + 1))).alias("base"),
        F.sum(F.when(whole, F.col("model")).otherwise(F.col("times") * of_word)).alias("model"),
    )
    return sums.select(
        *(F.col(f"own._{k}").alias(name) for k, name in enumerate(carried)),
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * base_divisor).alias("base_score"),
        (F.col("model") - F.col("n_tokens") * model_divisor).alias("lm_score"),
    )
