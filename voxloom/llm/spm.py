"""SentencePiece encoding and decoding by a max-plus scan.

A text is encoded into the segmentation with the highest sum of an existing vocabulary's scores (ties: the longer last
piece), with byte pieces for characters that are no piece. Spaces become U+2581, one is put in front, and a literal
U+2581 is spelled in bytes, so decoding restores every text exactly.

No piece crosses the start of a word, so the best path of an ordinary document is the concatenation of its words' best
paths; equal words of a task are solved once, many at a time.

A document over ``giant`` characters is not held by one task. It is cut into chunks of ``chunk`` characters wherever they
fall. Each chunk yields a matrix M of boundary states: M[i, j] is the best score from a cut i characters before
the chunk's start to one j characters before its end. Matrices combine associatively in max-plus algebra; a scan over
a document's matrices (a few KB each) finds the two states in which the best path passes through each chunk, and every
chunk is then backtraced on its own.

Defined results: null and empty texts have no ids and decode to an empty text; repeated rows are encoded alike.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.llm.common import quoted, trimmed, written
from voxloom.llm.lattice import LITERAL, SPACE, BestPaths, Vocabulary

GIANT, CHUNK = 32_768, 16_384
_WORD_STARTS = re.compile(f"(?={SPACE})|(?<=\n)|(?=\n)")


def marked(text: str) -> str:
    """The text as the vocabulary spells it: spaces marked, one in front."""
    return SPACE + text.replace(SPACE, LITERAL).replace(" ", SPACE)


def words_of(text: str, line_feed: bool) -> list[str]:
    """The parts that no piece crosses: a new one at every space, and line feeds alone where no piece holds one.
    Empty strings between them stand for nothing."""
    t = marked(text).replace(SPACE, " " + SPACE)
    return (t.replace("\n", " \n ") if line_feed else t).split(" ")


class Encoder:
    """Encodes words with a memo bounded to two generations; one encoder for each Python worker."""

    def __init__(self, path: str, memo: int = 40_000, block: int = 256):
        self.vocabulary = Vocabulary(path)
        self.best = BestPaths(self.vocabulary)
        self.memo, self.block = memo, block
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def learn(self, words: set[str]) -> None:
        """Have all ``words`` in ``known``; those in neither generation are solved together."""
        if len(self.known) > self.memo:
            self.known, self.older = {}, self.known
        new = words - self.known.keys()
        for w in new & self.older.keys():
            self.known[w] = self.older[w]
        new = list(new - self.older.keys())
        if new:
            self.known.update(zip(new, self.best.encode(new), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids as int32 bytes, for each text."""
        out = []
        for s in range(0, len(texts), self.block):
            split = [words_of(t, self.vocabulary.line_feed_stands_alone) if t else [] for t in texts[s : s + self.block]]
            self.learn(set().union(*split))
            solved = self.known.__getitem__
            out += [b"".join(map(solved, ws)) for ws in split]
        return out

    def score(self, ids: bytes) -> float:
        return float(self.vocabulary.scores[np.frombuffer(ids, np.int32)].sum())

    def decode(self, ids: np.ndarray) -> str:
        table = self.vocabulary.bytes
        return b"".join([table[k] for k in ids]).decode("utf-8", "replace")[1:]

    # --- boundary states of chunks -------------------------------------------------------------------------------
    def columns(self, text: str, sources: list[int]) -> np.ndarray:
        """Scores from each source position (rows) to each position of ``text``; small fragments only."""
        v = self.vocabulary
        out = np.full((len(sources), len(text) + 1), -np.inf)
        for r, s in enumerate(sources):
            out[r, s] = 0.0
        for i in range(min(sources, default=0), len(text)):
            for size in range(1, min(v.longest, len(text) - i) + 1):
                w = self.arc(text[i : i + size])
                if w is not None:
                    np.maximum(out[:, i + size], out[:, i] + w, out=out[:, i + size])
        return out

    def arc(self, piece: str) -> float | None:
        k = self.vocabulary.pieces.get(piece)
        if k is not None:
            return self.vocabulary.scores[k]
        if len(piece) == 1:
            return len((SPACE if piece == LITERAL else piece).encode("utf-8")) * self.vocabulary.byte_score
        return None

    def word_starts(self, left: str, body: str) -> list[int]:
        """Positions in ``body``, its ends included, at which every path has a cut."""
        whole = left[-1:] + body
        alone = self.vocabulary.line_feed_stands_alone
        shift = len(left[-1:])
        starts = [m.start() - shift for m in (_WORD_STARTS if alone else re.compile(f"(?={SPACE})")).finditer(whole)]
        return [s for s in starts if 0 <= s <= len(body) and (s < len(body) or (alone and body.endswith("\n")))]

    def matrix(self, left: str, body: str) -> np.ndarray:
        """The chunk's boundary states. ``left``: the characters before it, as many as the longest piece less one."""
        m = self.vocabulary.longest
        starts = self.word_starts(left, body)
        whole, at = left + body, len(left)
        sources = [at - i for i in range(min(m - 1, at) + 1)]
        out = np.full((m, m), -np.inf)
        reach = min(m, len(body))
        if starts:
            first, last = at + starts[0], at + starts[-1]
            # only arcs that end beyond the chunk's start belong to it
            head = self._entering(whole[:first], at, sources)[:, first] if first > at else np.array([0.0] + [-np.inf] * (len(sources) - 1))
            inner = whole[first:last]
            middle = self.score(self._words(inner))
            tail = self.columns(whole[last:], [0])[0]
            ends = np.array([tail[len(whole) - j - last] if len(whole) - j >= last else -np.inf for j in range(reach)])
            out[: len(sources), :reach] = head[:, None] + middle + ends[None, :]
        else:
            f = self._entering(whole, at, sources)
            out[: len(sources), :reach] = f[:, [len(whole) - j for j in range(reach)]]
        return out

    def _entering(self, text: str, at: int, sources: list[int]) -> np.ndarray:
        """Like columns, but from a source before ``at`` only one arc leads, to beyond ``at``."""
        v = self.vocabulary
        out = np.full((len(sources), len(text) + 1), -np.inf)
        for r, s in enumerate(sources):
            if s == at:
                out[r, s] = 0.0
            for size in range(at - s + 1, min(v.longest, len(text) - s) + 1) if s < at else ():
                w = self.arc(text[s : s + size])
                if w is not None:
                    out[r, s + size] = max(out[r, s + size], w)
        for i in range(at, len(text)):
            for size in range(1, min(v.longest, len(text) - i) + 1):
                w = self.arc(text[i : i + size])
                if w is not None:
                    np.maximum(out[:, i + size], out[:, i] + w, out=out[:, i + size])
        return out

    def _words(self, text: str) -> bytes:
        """Best path of a text that begins and ends at word starts."""
        words = text.replace(SPACE, " " + SPACE)
        words = (words.replace("\n", " \n ") if self.vocabulary.line_feed_stands_alone else words).split(" ")
        self.learn(set(words))
        return b"".join(map(self.known.__getitem__, words))

    def trace(self, left: str, body: str, entry: int, leave: int) -> bytes:
        """Ids of the pieces that end in this chunk, on the best path from state ``entry`` to state ``leave``."""
        whole = (left[len(left) - entry :] if entry else "") + body
        text = whole[: len(whole) - leave]
        starts = [s + entry for s in self.word_starts(left, body) if entry < s + entry < len(text)] if entry else self.word_starts("", body)
        starts = [s for s in starts if 0 < s < len(text)]
        if not starts:
            return self._fragment(text, entry)
        head = self._fragment(text[: starts[0]], entry) if entry else self._words(text[: starts[0]])
        return head + self._words(text[starts[0] :])

    def _fragment(self, text: str, entry: int) -> bytes:
        """Best path of a fragment whose first arc must end beyond ``entry`` characters."""
        if not text:
            return b""
        v = self.vocabulary
        best, back = [-np.inf] * (len(text) + 1), [0] * (len(text) + 1)
        best[0] = 0.0
        for i in range(len(text)):
            if best[i] == -np.inf:
                continue
            for size in range(entry + 1 if i == 0 else 1, min(v.longest, len(text) - i) + 1):
                w = self.arc(text[i : i + size])
                if w is not None and best[i] + w > best[i + size]:
                    best[i + size], back[i + size] = best[i] + w, size
        ids, at = [], len(text)
        while at:
            piece = text[at - back[at] : at]
            k = v.pieces.get(piece)
            ids.append([k] if k is not None else [int(v.byte_ids[b]) for b in (SPACE if piece == LITERAL else piece).encode("utf-8")])
            at -= back[at]
        return np.array([k for part in reversed(ids) for k in part], np.int32).tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker and vocabulary; the file must be readable on every executor, as the library is."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product: the matrix of two chunks that follow each other."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def scan(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """Entry and exit state of every chunk on the best path of the whole text.

    Prefixes are formed by recursive doubling with the associative product; the states then follow backwards."""
    prefix = list(matrices)
    step = 1
    while step < len(prefix):
        prefix = [combine(prefix[k - step], prefix[k]) if k >= step else prefix[k] for k in range(len(prefix))]
        step *= 2
    states, leave = [], 0
    for k in range(len(matrices) - 1, -1, -1):
        before = prefix[k - 1][0] if k else np.where(np.arange(len(matrices[0])) == 0, 0.0, -np.inf)
        entry = int(np.argmax(before + matrices[k][:, leave]))
        states.append((entry, leave))
        leave = entry
    return states[::-1]


_ENCODED = "ids array<int>, score double"


def _id_lists(rows: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(r) // 4 for r in rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), np.int32)))


def encode_giants(texts: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """(digest, text) to (digest, ids, score): the scan over chunks. Texts must be distinct by digest."""
    longest = Vocabulary(path).longest
    if chunk < 2 * longest:
        raise ValueError("chunks must be longer than two pieces")

    def pieces(batches):
        for b in batches:
            rows = []
            for digest, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = marked(text)
                ends = list(range(chunk, len(t) - chunk // 2, chunk)) + [len(t)]
                for k, (s, e) in enumerate(zip([0, *ends], ends, strict=False)):
                    rows.append((digest, k, t[max(0, s - longest + 1) : s].encode("utf-8", "surrogatepass"), t[s:e].encode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.string(), pa.int32(), pa.binary(), pa.binary()))], ["digest", "k", "before", "body"])

    plain = lambda x: x.decode("utf-8", "surrogatepass")
    chunks = written(texts.select("digest", "text").mapInArrow(lambda b: trimmed(pieces(b)), "digest string, k int, before binary, body binary").repartition("digest", "k"))

    def matrices(batches):
        for b in batches:
            m = [encoder(path).matrix(plain(x), plain(y)).astype(np.float64).tobytes() for x, y in zip(b.column("before").to_pylist(), b.column("body").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("digest"), b.column("k"), pa.array(m, pa.binary())], ["digest", "k", "m"])

    def states(group: pa.Table) -> pa.Table:
        group = group.sort_by("k")
        found = scan([np.frombuffer(m, np.float64).reshape(longest, longest) for m in group.column("m").to_pylist()])
        return pa.table({"digest": group.column("digest"), "k": group.column("k"), "entry": pa.array([s[0] for s in found], pa.int32()), "leave": pa.array([s[1] for s in found], pa.int32())})

    # the states are small; written, they don't leave a second Python worker beside that of the next step
    through = written(chunks.mapInArrow(lambda b: trimmed(matrices(b)), "digest string, k int, m binary").groupBy("digest").applyInArrow(states, "digest string, k int, entry int, leave int"))

    def traced(batches):
        for b in batches:
            rows = [encoder(path).trace(plain(x), plain(y), i, j) for x, y, i, j in zip(*(b.column(n).to_pylist() for n in ("before", "body", "entry", "leave")), strict=True)]
            scores = [encoder(path).score(r) for r in rows]
            yield pa.RecordBatch.from_arrays([b.column("digest"), b.column("k"), _id_lists(rows), pa.array(scores, pa.float64())], ["digest", "k", "ids", "score"])

    parts = chunks.join(through, ["digest", "k"]).mapInArrow(lambda b: trimmed(traced(b)), f"digest string, k int, {_ENCODED}")
    # the result holds a document's ids in one row, so this group is no larger than its output
    whole = parts.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("k", "ids", "score"))).alias("parts"))
    return whole.select("digest", F.flatten(F.col("parts.ids")).alias("ids"), F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["score"]).alias("score"))


def encode(docs: DataFrame, path: str, text: str = "text", giant: int = GIANT, chunk: int = CHUNK, decoded: str | None = None) -> DataFrame:
    """``docs`` with ``ids`` (array of int) and ``piece_score`` (sum of their scores); with ``decoded``, also a column of
    that name with the text that the ids stand for, found in the same pass. Input columns of these names are replaced."""
    made = {"ids", "piece_score", *([decoded.lower()] if decoded else [])}
    if text.lower() in made:
        raise ValueError(f"the text column can't be named {text}")
    docs = docs.select(*[quoted(c) for c in docs.columns if c.lower() not in made])
    size = F.length(F.coalesce(quoted(text), F.lit("")))
    small, large = docs.filter(size <= giant), docs.filter(size > giant)

    names = docs.columns

    more = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("piece_score", T.DoubleType())]
    more += [T.StructField(decoded, T.StringType())] if decoded else []

    def run(batches):
        own = encoder(path)
        for b in batches:
            for at in range(0, b.num_rows, own.block):  # small slices keep what a worker holds small
                part = b.slice(at, own.block)
                got = own.encode(part.column(names.index(text)).to_pylist())
                out = [_id_lists(got), pa.array(map(own.score, got), pa.float64())]
                if decoded:
                    out.append(pa.array([own.decode(np.frombuffer(x, np.int32)) for x in got], pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, *out], names=[*b.schema.names, *(f.name for f in more)])

    schema = T.StructType([*docs.schema.fields, *more])
    plain = small.mapInArrow(lambda b: trimmed(run(b)), schema)
    distinct = large.select(F.sha2(quoted(text), 256).alias("digest"), quoted(text).alias("text")).dropDuplicates(["digest"])
    solved = encode_giants(distinct, path, chunk)
    joined = large.select(F.struct(*map(quoted, names)).alias("row"), F.sha2(quoted(text), 256).alias("digest")).join(solved, "digest")
    joined = joined.select(*[F.col("row").getField(c).alias(c) for c in names], "ids", F.col("score").alias("piece_score"))
    return plain.unionByName(decode(joined, path, to=decoded) if decoded else joined)


def decode(encoded: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``encoded`` with the text that ``ids`` stand for; null ids decode to null."""

    @F.pandas_udf("string")
    def texts(rows):
        return pd.Series([encoder(path).decode(r) if r is not None else None for r in rows], dtype=object)

    return encoded.withColumn(to, texts(F.col(ids)))
