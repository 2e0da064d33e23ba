"""Language identification by word-first backoff.

A known word adds its log frequency in every language. An unseen word backs off to the longest character n-grams of it
that are known (five characters, then four, ... then one) and adds their mean log frequency. The document's language is
the one with the highest sum.

The tables are fitted on a bounded sample of labelled rows: about ``max_rows`` in proportion, but ``least_rows`` of every
language that has as many, so that a rare one can be predicted beside millions of others. They hold at most
``max_words`` words and ``max_grams`` n-grams, so the broadcast model has a fixed size bound; priors count all labelled rows.
Every document is then scored over its whole text.

Defined results: text that is null or has no letter (Unicode category L) gives ``und`` with score 0; equal sums go to the
language that sorts first; with no labelled rows at all everything is ``und``. Columns named ``lang_pred`` and ``lang_score``
are replaced; all others are carried along untouched, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import quoted, trimmed, unused, written

UNDETERMINED = "und"
LONGEST_GRAM = 5
#: Runs of letters and number signs; a word is one that has a letter.
_WORD = re.compile(r"[^\W\d_]+")
#: Evidence beyond so many words doesn't sharpen the score further, which keeps it from being 1 for any long text.
EVIDENCE_WORDS = 20


def words_of(text: str) -> list[str]:
    """The lower-cased words of a text. Characters such as a half or a raised two are numbers and no letters."""
    found = _WORD.findall(text.lower())
    return [w for w in found if w.isalpha() or any(map(str.isalpha, w))]


def grams(word: str, n: int) -> list[str]:
    """The n-grams of a word with its ends marked; single characters are taken without the marks."""
    if n == 1:
        return list(word)
    padded = f"<{word}>"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class Model:
    """Log frequencies per language: a matrix for the words and one for the n-grams, with a dict from string to row."""

    def __init__(self, langs: list[str], words: tuple[dict[str, int], np.ndarray], pieces: tuple[dict[str, int], np.ndarray], prior: np.ndarray):
        self.langs, self.prior = langs, prior
        (self.words, self.word_logs), (self.pieces, self.piece_logs) = words, pieces

    def known_grams(self, word: str) -> list[int]:
        """Rows of the longest n-grams of an unseen word of which any is known."""
        get = self.pieces.get
        for n in range(min(LONGEST_GRAM, len(word) + 2), 0, -1):
            known = [k for g in grams(word, n) if (k := get(g)) is not None]
            if known:
                return known
        return []

    def row(self, word: str) -> np.ndarray:
        return self.rows([word])[0]

    def rows(self, words: list[str]) -> np.ndarray:
        """One row for each word; those that back off are averaged together."""
        out = np.zeros((len(words), len(self.langs)))
        whole = [self.words.get(w, -1) for w in words]
        seen = np.array(whole) >= 0
        out[seen] = self.word_logs[np.array(whole)[seen]]
        backed = [(r, k) for r, w in enumerate(words) if whole[r] < 0 and (k := self.known_grams(w))]
        if backed:
            n = np.array([len(k) for _, k in backed])
            sums = np.add.reduceat(self.piece_logs[[g for _, k in backed for g in k]], np.cumsum(n) - n)
            out[[r for r, _ in backed]] = sums / n[:, None]
        return out


class Scorer:
    """A model with a bounded memo of the rows of words, one for each Python worker."""

    def __init__(self, model: Model, memo: int = 100_000):
        self.model, self.memo = model, memo
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.rows = np.zeros((1024, max(1, len(self.model.langs))))

    def learn(self, words: list[str]) -> None:
        first, end = len(self.index), len(self.index) + len(words)
        self.index.update(zip(words, range(first, end), strict=True))
        if end > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((max(end - len(self.rows), len(self.rows)), self.rows.shape[1]))])
        self.rows[first:end] = self.model.rows(words)

    def __call__(self, text: str | None) -> tuple[str, float]:
        m = self.model
        words = Counter(words_of(text)) if text and m.langs else None
        if not words:
            return UNDETERMINED, 0.0
        if len(self.index) > self.memo:
            self.clear()
        if new := [w for w in words if w not in self.index]:
            self.learn(new)
        at = list(map(self.index.__getitem__, words))
        n = np.fromiter(words.values(), float, len(words))
        total = (self.rows[at] * n[:, None]).sum(0)
        seen = n.sum()
        z = m.prior + total * (min(seen, EVIDENCE_WORDS) / max(seen, 1.0))
        best = int(np.argmax(m.prior + total))
        p = np.exp(z - z.max())
        return m.langs[best], float(p[best] / p.sum())


def _counts(batches, pieces: bool):
    """Partial counts per language and string, flushed before they grow large; the next groupBy adds them up."""

    def flush(acc):
        keys = list(acc)
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(acc.values()), pa.int64())],
            ["lang", "item", "n"],
        )

    acc: Counter = Counter()
    for b in batches:
        for lang, item, n in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            if pieces:
                for size in range(1, LONGEST_GRAM + 1):
                    for g in grams(item, size):
                        acc[lang, g] += n
            elif item:
                for w, c in Counter(words_of(item)).items():
                    acc[lang, w] += c
            if len(acc) > 50_000:
                yield flush(acc)
                acc.clear()
    yield flush(acc)


def _table(counts: DataFrame, most: int, langs: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """Log frequencies of the ``most`` commonest items, add-half smoothed."""
    per_item = counts.groupBy("item").agg(F.sum("n").alias("total"), F.collect_list(F.struct("lang", "n")).alias("of"))  # a struct per language
    top = per_item.orderBy(F.col("total").desc(), "item").limit(most).select("item", F.explode("of").alias("of")).select("item", "of.lang", "of.n").toPandas()
    items = {x: k for k, x in enumerate(dict.fromkeys(top["item"]))}
    n = np.zeros((len(items), len(langs)))
    n[top["item"].map(items).to_numpy(int), top["lang"].map({x: k for k, x in enumerate(langs)}).to_numpy(int)] = top["n"].to_numpy(float)
    return items, np.log((n + 0.5) / (n.sum(0) + 0.5 * max(1, len(n))))


def sampled(rows: DataFrame, per_lang: dict[str, int], max_rows: int, least_rows: int, seed: int) -> DataFrame:
    """The rows (lang, key, item) that the tables are fitted on, picked by a hash of key and text: the same ones however the
    table is partitioned, about ``max_rows`` plus ``least_rows`` a language at most."""
    total = sum(per_lang.values())
    if total <= max_rows:
        return rows
    steps = 1 << 30
    shares = [(x, int(steps * min(1.0, max(max_rows / total, least_rows / n)))) for x, n in per_lang.items()]
    shares = rows.sparkSession.createDataFrame(shares, "lang string, share long")
    return rows.join(F.broadcast(shares), "lang").filter(F.pmod(F.xxhash64(F.lit(seed), "key", "item"), F.lit(steps)) < F.col("share")).drop("share")


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", max_rows: int = 20_000, least_rows: int = 500, max_words: int = 60_000, max_grams: int = 60_000, seed: int = 7) -> Model:
    """Fit the tables on a sample of the rows whose text and language are not null."""
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(key).alias("key"), F.col(text).cast("string").alias("item"))
    prior = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row per language
    langs = sorted(prior)
    if not langs:
        return Model([], ({}, np.zeros((0, 0))), ({}, np.zeros((0, 0))), np.zeros(0))
    rows = sampled(rows, prior, max_rows, least_rows, seed).select("lang", "item", F.lit(1).cast("long").alias("n"))
    schema = "lang string, item string, n long"
    words = written(rows.mapInArrow(lambda b: trimmed(_counts(b, False)), schema).groupBy("lang", "item").agg(F.sum("n").alias("n")))
    pieces = written(words.mapInArrow(lambda b: trimmed(_counts(b, True)), schema).groupBy("lang", "item").agg(F.sum("n").alias("n")))
    return Model(langs, _table(words, max_words, langs), _table(pieces, max_grams, langs), np.log([prior[x] / sum(prior.values()) for x in langs]))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` (a learned language or ``und``) and ``lang_score`` (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scorers: list[Scorer] = []

    @F.arrow_udf("lang string, score double")
    def best(texts: pa.Array) -> pa.Array:
        if not scorers:
            scorers.append(Scorer(shared.value))
        # small slices keep what a worker holds small
        found = [scorers[0](t) for at in range(0, len(texts), 256) for t in texts.slice(at, 256).to_pylist()]
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["lang", "score"])

    # marked as not deterministic, or a filter on the prediction would run the whole model a second time
    once = best.asNondeterministic()
    name = unused(docs, "_lang")
    kept = [quoted(c) for c in docs.columns if c.lower() not in ("lang_pred", "lang_score")]
    found = docs.withColumn(name, once(F.col(text).cast("string")))
    return found.select(*kept, F.col(f"{name}.lang").alias("lang_pred"), F.col(f"{name}.score").alias("lang_score"))
