"""Packing by lexical retrieval: windows of tokens filled with a seed document and its nearest unused neighbours.

Documents are tokenised once and stored. Counts over all of them (documents with each token, documents, tokens) give the
BM25 weights. Documents that share a distinctive token go to one shard; a shard holds about ``shard_tokens`` tokens, and a
token that more documents have spreads over several shards. A shard is one task: it builds an inverted index of its
documents, takes the longest unused one as a seed, ranks the unused others by BM25 against it and fills the window with them
in that order. The document that doesn't fit whole is cut, and its rest is the next seed. Where no neighbour shares a token,
the longest unused documents follow.

Every window is full but for what is left at a shard's end; that is cut into sequences whose lengths are powers of two,
which need no padding.

Defined results: a null text counts as empty; every document ends with the end id, so an empty one is that id alone; each
row is a document of its own, also with a repeated or null key; a document longer than a window fills windows of its own
first; ties in length or score go to the order of the stored rows; other columns are left out, so none can clash; an
empty table gives no rows. A single document must fit in a task's memory, and so must a shard and its longest document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import quoted, trimmed, written

WINDOW, SHARD_TOKENS = 4096, 2**20
K1, B = 1.2, 0.75
#: Characters that are tokenised together, and words that a worker remembers the ids of.
TOGETHER, REMEMBERED = 24_000_000, 1_000_000
#: Postings of tokens that more than this share of a shard's documents hold lie as dense rows.
DENSE = 1 / 8
PIECE = "`start` long, `length` long, doc_tokens long, sequence_id long, `offset` long, piece_ids binary"
LATIN = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþœšž"
SPACES, ANY_CASE = re.compile(r"[^ \t\n\r]+"), re.compile(f"[{LATIN}{LATIN.upper()}ß]+")
#: Arrow splits texts at these, too, the tokenizer doesn't.
NO_SPACES = "[\x1c-\x1f]"


class Words:
    """Ids of texts, put together from remembered words.

    White space never lies inside a token of this kind of vocabulary (normaliser and splitter drop it), so the ids of a
    text are those of its words, and full stops and commas behind a word's last letter are a word of their own. Words of
    plain Latin letters go to the model itself, as the splitter would write them; others through the whole tokenizer.
    Splitting, counting and putting together are done on whole columns."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(vocabulary)
        self.model = self.whole.model
        self.kind = id_kind(self.whole.get_vocab_size())
        self.letters = {ord(c): "".join(p for p, _ in self.whole.pre_tokenizer.pre_tokenize_str(c)) for c in LATIN + "ß"}
        # remembered words, and where their ids lie in the store
        self.words, self.first, self.size, self.store = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.kind)

    def learn(self, words: pa.StringArray) -> None:
        """Remembers words that aren't known."""
        import pyarrow.compute as pc

        # a word without the stops at its end, and those
        stopped = pc.match_substring_regex(words, r"[\p{L}\p{N}][.,]+$")
        base = pc.if_else(stopped, pc.utf8_rtrim(words, ".,"), words)
        extra = np.flatnonzero(stopped.to_numpy(zero_copy_only=False))
        tails = [w[len(b) :] for w, b in zip(words.take(pa.array(extra)).to_pylist(), base.take(pa.array(extra)).to_pylist(), strict=True)]
        coded, stops = base.dictionary_encode(), ["", *sorted(set(tails))]
        names = coded.dictionary.to_pylist() + stops
        tail = np.full(len(words), len(coded.dictionary))
        tail[extra] += np.array([stops.index(t) for t in tails], np.int64)
        lower = [w.lower() if ANY_CASE.fullmatch(w) else None for w in names]
        tokenize, letters = self.model.tokenize, self.letters
        ids = [None if x is None else [t.id for t in tokenize(x if x.isascii() else x.translate(letters))] for x in lower]
        rest = [k for k, x in enumerate(lower) if x is None]
        for k, e in zip(rest, self.whole.encode_batch_fast([names[k] for k in rest], add_special_tokens=False), strict=True):
            ids[k] = e.ids
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        part = np.stack([coded.indices.to_numpy(zero_copy_only=False), tail], 1).ravel()
        store, ends = gathered(np.array([i for x in ids for i in x], self.kind), (np.cumsum(size) - size)[part], size[part])
        self.words, self.first, self.size = pa.concat_arrays([self.words, words]), np.concatenate([self.first, len(self.store) + ends[:-1:2]]), np.concatenate([self.size, ends[2::2] - ends[:-1:2]])
        self.store = np.concatenate([self.store, store])

    def forget(self, kept: np.ndarray) -> None:
        """Only the words at the places ``kept`` stay."""
        self.store, ends = gathered(self.store, self.first[kept], self.size[kept])
        self.words, self.first, self.size = self.words.take(pa.array(kept)), ends[:-1], np.diff(ends)

    def ids(self, texts: pa.StringArray, end_id: int | None = None) -> pa.BinaryArray:
        """The stored ids of each text, with ``end_id`` behind them; a null text counts as empty."""
        import pyarrow.compute as pc

        texts = texts.fill_null("")
        if pc.any(pc.match_substring_regex(texts, NO_SPACES)).as_py():
            split = pa.array([SPACES.findall(t) for t in texts.to_pylist()], pa.list_(pa.string()))
        else:
            split = pc.utf8_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        words, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        known = pc.index_in(words, value_set=self.words)
        new = words.filter(known.is_null())
        if len(self.words) + len(new) > REMEMBERED:  # what these texts share with earlier ones stays
            kept = known.drop_null().to_numpy()
            self.forget(kept)
            known = pc.index_in(words, value_set=self.words)
        place = known.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        place[place < 0] = len(self.words) + np.arange(len(new))
        if len(new):
            self.learn(new)
        values, ends = gathered(self.store, self.first[place][codes], self.size[place][codes])
        at = ends[split.offsets.to_numpy() - split.offsets[0].as_py()]
        if end_id is not None:
            rows = np.arange(len(texts))
            out = np.full(len(values) + len(rows), end_id, self.kind)
            out[np.arange(len(values)) + np.repeat(rows, np.diff(at))] = values
            values, at = out, at + np.arange(len(at))
        return pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((at * self.kind.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def gathered(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``values`` that begin at ``first``, one after the other, and where each ends, with 0 before."""
    ends = np.concatenate([[0], np.cumsum(size)])
    kind = np.int32 if max(len(values), ends[-1]) < 2**31 else np.int64
    at = np.repeat((first - ends[:-1]).astype(kind), size)
    at += np.arange(ends[-1], dtype=kind)
    return values[at], ends


def id_kind(size: int) -> np.dtype:
    """How stored ids of a vocabulary of ``size`` look."""
    return np.dtype("<u2" if size <= 2**16 else "<u4")


_words: dict[str, Words] = {}


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``TOGETHER`` characters."""
    import pyarrow.compute as pc

    at = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)) // TOGETHER
    ends = [*np.flatnonzero(np.diff(at)) + 1, batch.num_rows]
    yield from (batch.slice(a, b - a) for a, b in zip([0, *ends[:-1]], ends, strict=True) if b > a)


def tokenised(docs: DataFrame, vocabulary: str, end_id: int, key: str, text: str) -> DataFrame:
    """(key, ids binary, uid): the ids of every whole text and the end id, stored; ``uid`` tells rows apart."""
    kind = docs.schema[key].dataType.simpleString()

    def encode(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words = _words[vocabulary] = _words.get(vocabulary) or Words(vocabulary)  # kept between tasks
        for b in (s for whole in batches for s in slices(whole, "text")):
            yield pa.RecordBatch.from_arrays([b.column("key"), words.ids(b.column("text"), end_id)], ["key", "ids"])

    rows = docs.select(quoted(key).alias("key"), quoted(text).cast("string").alias("text"))
    coded = rows.mapInArrow(lambda batches: trimmed(encode(batches)), f"key {kind}, ids binary")
    return written(coded.withColumn("uid", F.monotonically_increasing_id()))


def flat(column: pa.BinaryArray, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All ids of stored rows, one after the other, and where each row begins, with the end last; no copy."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw.view(kind), (at - at[0]) // kind.itemsize


class Statistics:
    """Counts over all documents. ``df[t]``: documents that hold token t."""

    def __init__(self, tokens: DataFrame, size: int):
        self.kind = kind = id_kind(size)

        def counts(batches):
            df, n, total = np.zeros(size, np.int64), 0, 0
            for b in batches:
                ids, at = flat(b.column("ids"), kind)
                for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    own = np.sort(ids[lo:hi], kind="stable")  # by radix for two bytes
                    df[own[np.flatnonzero(own[1:] != own[:-1])]] += 1
                    df[own[-1]] += 1
                n, total = n + len(at) - 1, total + len(ids)
            held = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array([*held, -1, -2], pa.int64()), pa.array([*df[held], n, total], pa.int64())], ["term", "n"])

        # a row a token of the vocabulary at most, from each task and at the driver
        rows = dict(tokens.select("ids").mapInArrow(counts, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect())
        self.n, self.total = rows.pop(-1, 0), rows.pop(-2, 0)
        self.df = np.zeros(size, np.int64)
        self.df[list(rows)] = list(rows.values())
        self.idf = np.log1p((self.n - self.df + 0.5) / (self.df + 0.5))
        self.average = self.total / max(1, self.n)


def priorities(stats: Statistics, shard_tokens: int) -> np.ndarray:
    """For each token how well it names a shard: best the rarest of those that enough documents hold to fill one; else the
    more documents, the better. All differ."""
    enough = shard_tokens / max(1.0, stats.average)
    order = np.lexsort((np.arange(len(stats.df)), np.where(stats.df >= enough, -stats.df, stats.df), stats.df >= enough))
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


def dealt(tokens: DataFrame, stats: Statistics, shard_tokens: int) -> DataFrame:
    """``tokens`` with ``shard``. The table of shards has a row a token of the vocabulary at most."""
    rank = priorities(stats, shard_tokens)
    named, kind_of_ids = np.argsort(rank), stats.kind

    def names(batches):
        for b in batches:
            ids, at = flat(b.column("ids"), kind_of_ids)
            best = np.maximum.reduceat(rank[ids], at[:-1]) if len(ids) else np.zeros(0, np.int64)  # no row is empty
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("key", "ids", "uid")), pa.array(named[best], pa.int64()), pa.array(np.diff(at), pa.int64())], ["key", "ids", "uid", "term", "n"])

    kind = tokens.schema["key"].dataType.simpleString()
    terms = tokens.mapInArrow(names, f"key {kind}, ids binary, uid long, term long, n long")
    sizes = dict(terms.groupBy("term").agg(F.sum("n").alias("n")).collect())
    first, parts, filled, shard = {}, {}, 0, 0
    for term in sorted(sizes):
        n = sizes[term]
        if n > shard_tokens or filled + n > shard_tokens:
            shard, filled = shard + (filled > 0), 0
        first[term], parts[term] = shard, max(1, -(-n // shard_tokens))
        if n > shard_tokens:
            shard += parts[term]
        else:
            filled += n
    table = tokens.sparkSession.createDataFrame([(t, first[t], parts[t]) for t in first], "term long, first long, parts long")
    mixed = F.pmod(F.xxhash64("uid"), F.col("parts"))
    return terms.join(F.broadcast(table), "term").select("key", "ids", "uid", (F.col("first") + mixed).alias("shard"))


class Index:
    """Inverted index of one shard with BM25 weights. The postings of a frequent token are a dense row over all documents;
    all dense rows together are at most 1 / ``DENSE`` times as large as the shard."""

    def __init__(self, ids: np.ndarray, at: np.ndarray, stats: Statistics):
        self.lengths = np.diff(at)
        n = len(self.lengths)
        order = np.argsort(ids, kind="stable")  # by token, then in the order of documents
        terms, docs = ids[order], np.repeat(np.arange(n, dtype=np.int32), self.lengths)[order]
        new = np.ones(len(terms), bool)
        new[1:] = (terms[1:] != terms[:-1]) | (docs[1:] != docs[:-1])
        start = np.flatnonzero(new)
        counts = np.diff(np.append(start, len(terms)))
        terms, self.docs = terms[start].astype(np.int64), docs[start]
        scale = counts + K1 * (1 - B + B * self.lengths[self.docs] / max(1.0, stats.average))
        self.weights = stats.idf[terms] * counts * (K1 + 1) / scale
        self.terms, self.first = np.unique(terms, return_index=True)
        self.size = np.diff(np.append(self.first, len(terms)))
        # the tokens of each document, as places in ``terms``
        place = np.repeat(np.arange(len(self.terms), dtype=np.int32), self.size)
        self.held, self.begins = place[np.argsort(self.docs, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(self.docs, minlength=n))])
        often = np.flatnonzero(self.size > n * DENSE)
        self.row = np.full(len(self.terms), -1)
        self.row[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), n), np.float32)
        for k, t in enumerate(often):
            own = slice(self.first[t], self.first[t] + self.size[t])
            self.dense[k, self.docs[own]] = self.weights[own]

    def scores(self, doc: int) -> np.ndarray:
        """BM25 of every document against the distinct tokens of one of them."""
        asked = self.held[self.begins[doc] : self.begins[doc + 1]]
        rows = self.row[asked]
        rare = asked[rows < 0]
        size = self.size[rare]
        at = np.repeat(self.first[rare] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return self.dense[rows[rows >= 0]].sum(0) + np.bincount(self.docs[at], self.weights[at], len(self.lengths))


def windows(ids: np.ndarray, at: np.ndarray, stats: Statistics, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of a shard, each a list of (document, start, length)."""
    n = len(at) - 1
    index, out, now, room = Index(ids, at, stats), [], [], window
    unused = np.ones(n, bool)
    longest, turn = np.argsort(-index.lengths, kind="stable"), 0

    def place(doc: int, start: int) -> int:
        """Puts what fits into the window; returns how far the document is placed."""
        nonlocal now, room
        take = min(room, int(index.lengths[doc]) - start)
        now.append((doc, start, take))
        room -= take
        if not room:
            out.append(now)
            now, room = [], window
        return start + take

    cut: tuple[int, int] | None = None
    while True:
        if cut is None:
            while turn < n and not unused[longest[turn]]:
                turn += 1
            if turn == n:
                break
            cut = (int(longest[turn]), 0)
            unused[cut[0]] = False
        doc, start = cut
        cut = None
        while start < index.lengths[doc] and (start := place(doc, start)) < index.lengths[doc]:
            pass  # whole windows of a long document
        if not now:
            continue
        left = np.flatnonzero(unused)
        if not len(left):
            break
        score = index.scores(doc)[left]
        sized = index.lengths[left]
        most = min(len(left), 1 + room)  # a document has one id at least
        near = np.argpartition(-score, most - 1)[:most] if most < len(left) else np.arange(len(left))
        for k in near[np.lexsort((left[near], -sized[near], -score[near]))]:
            other = int(left[k])
            unused[other] = False
            done = place(other, 0)
            if done < index.lengths[other]:
                cut = (other, done)
            if not now:
                break
    return out + powers(now)


def powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """A last, shorter sequence as sequences whose lengths are powers of two, longest first."""
    out, left, pieces = [], sum(n for _, _, n in pieces), list(pieces)
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        out.append([])
        while room:
            doc, start, n = pieces[0]
            take = min(room, n)
            out[-1].append((doc, start, take))
            room -= take
            pieces[0] = (doc, start + take, n - take)
            if take == n:
                pieces.pop(0)
    return out


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, key: str = "doc_id", text: str = "text", window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """A row a piece: (``key``, start, length, doc_tokens, sequence_id, offset, piece_ids). ``piece_ids`` are the ids as
    unsigned little-endian 32-bit numbers, ``start`` the document's ids before them, ``offset`` the piece's place in its
    sequence. ``sequences`` puts the pieces together."""
    from tokenizers import Tokenizer

    tokens = tokenised(docs, vocabulary, end_id, key, text)
    kind = tokens.schema["key"].dataType.simpleString()
    stats = Statistics(tokens, max(end_id + 1, Tokenizer.from_file(vocabulary).get_vocab_size()))

    def packed(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("uid")
        ids, at = flat(group.column("ids").combine_chunks(), stats.kind)
        rows = [(d, s, n, int(at[d + 1] - at[d]), q, o) for q, seq in enumerate(windows(ids, at, stats, window)) for (d, s, n), o in zip(seq, np.cumsum([0] + [n for _, _, n in seq]).tolist(), strict=False)]
        doc, start, length, total, sequence, offset = (np.array(x, np.int64) for x in zip(*rows, strict=True))
        shard = group.column("shard")[0].as_py()
        pieces = [ids[a : a + n].astype("<u4").tobytes() for a, n in zip((at[doc] + start).tolist(), length.tolist(), strict=True)]
        columns = [group.column("key").combine_chunks().take(pa.array(doc)), start, length, total, (shard << 32) + sequence, offset, pa.array(pieces, pa.binary())]
        return pa.table([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["key", "start", "length", "doc_tokens", "sequence_id", "offset", "piece_ids"])

    out = dealt(tokens, stats, shard_tokens).groupBy("shard").applyInArrow(packed, f"key {kind}, {PIECE}")
    return out.withColumnRenamed("key", key)


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids, used): the sequences as arrays of ids, padded to ``window`` unless their length is a power of two.
    A sequence has ``window`` pieces at most."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "piece_ids")))
    whole = pieces.groupBy("sequence_id").agg(F.transform(parts, lambda p: p["piece_ids"]).alias("parts"))

    def joined(batches):
        for b in batches:
            rows = [np.frombuffer(b"".join(x), "<u4").astype(np.int64) for x in b.column("parts").to_pylist()]
            full = [r if len(r) & (len(r) - 1) == 0 else np.concatenate([r, np.full(window - len(r), pad_id)]) for r in rows]
            yield pa.RecordBatch.from_arrays([b.column("sequence_id"), pa.array(full, pa.list_(pa.int64())), pa.array([len(r) for r in rows], pa.int64())], ["sequence_id", "ids", "used"])

    return whole.mapInArrow(joined, "sequence_id long, ids array<long>, used long")
