"""Media columns stored as content-defined chunks.

A media value is an 8-bit mono wave: a 44-byte RIFF header and the payload as samples. The wave's bytes, header included,
are cut where a rolling gear hash of their last 16 bytes has its low bits clear, so equal passages give equal chunks
wherever they stand. Chunks are named by digest, and digests alone decide what is kept: they are counted and joined over
the whole table before any bytes move. Then the bytes of each distinct wave move once. Chunks that no other wave has
stay together as one row of the store, next to each other; a chunk that several waves share is a row of its own, written
by one of them. A list per wave keeps its chunks in order.

A wave whose chunks are all its own is read and verified where it lies. Others fetch their shared chunks by a join, are
put together in order and verified by digest; only then features are computed. Rows are compressed with a dictionary of
common passages, fitted on at most about ``SAMPLE`` texts and kept in the store.

Defined results: null text is an empty payload before padding; equal texts share one stored wave; waves of any length are
handled one at a time; no rows, an empty store. A chunk that is missing or damaged fails the read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.common import bounded_sample, trimmed, written

WINDOW = 16
LEAST, MEAN_BITS, MOST = 512, 11, 16 * 1024
LEVEL = 9
#: Texts that the compression dictionary is fitted on, the bytes of each that count, and the dictionary's size.
SAMPLE, SAMPLE_BYTES, DICTIONARY = 4_000, 8_192, 64 * 1024
#: A chunk or wave with more than 1/HOT_SHARE of all uses, and more than HOT_LEAST, is joined by broadcast: at most
#: HOT_SHARE rows of at most MOST bytes.
HOT_SHARE, HOT_LEAST = 1_000, 1_000
SAMPLE_RATE = 8000
#: The gear table: a fixed mixing rule, not random numbers.
GEAR = np.array([int.from_bytes(hashlib.sha256(bytes([k])).digest()[:4], "little") for k in range(256)], np.uint32)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """The gear hash of the last WINDOW bytes at every position: sums of shifted table entries, by doubling."""
    h = GEAR[data]
    width = 1
    while width < WINDOW:
        moved = np.zeros_like(h)
        moved[width:] = h[:-width] << np.uint32(width)
        h = h + moved
        width *= 2
    return h


def cuts(payload: bytes, least: int = LEAST, bits: int = MEAN_BITS, most: int = MOST) -> list[int]:
    """Ends of the chunks, at least ``least`` and at most ``most`` bytes each (the last may be shorter)."""
    n = len(payload)
    if n <= least:
        return [n]
    marks = np.flatnonzero((gear_hash(np.frombuffer(payload, np.uint8)) & np.uint32((1 << bits) - 1)) == 0) + 1
    out, at = [], 0
    while n - at > least:
        k = np.searchsorted(marks, at + least)
        end = min(int(marks[k]) if k < len(marks) else n, at + most, n)
        out.append(end)
        at = end
    if at < n:
        out.append(n)
    return out


def padded(text: str | None, unit: int) -> tuple[int, bytes]:
    """UTF-8 bytes, filled up with bytes 255 to a positive multiple of ``unit``; the unpadded length first."""
    raw = (text or "").encode("utf-8")
    return len(raw), raw + b"\xff" * (-len(raw) % unit or (unit if not raw else 0))


def wave_header(n: int) -> bytes:
    """RIFF header of ``n`` unsigned 8-bit mono samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", (36 + n) % 2**32, b"WAVE", b"fmt ", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8, b"data", n % 2**32)


def describe(payload: bytes) -> str:
    """Integer features of the samples: number, least, most, sum, sum of squares about 128, crossings of 128."""
    x = np.frombuffer(payload, np.uint8)
    d = x.astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    return f"n={len(x)};min={x.min()};max={x.max()};sum={int(x.sum(dtype=np.int64))};energy={int((d * d).sum())};crossings={crossings}"


def digest(data: bytes) -> bytes:
    """A chunk's name: the first half of its SHA-256."""
    return hashlib.sha256(data).digest()[:16]


def wave(payload: bytes) -> bytes:
    return wave_header(len(payload)) + payload


def _facts(media: bytes) -> tuple:
    payload = media[len(wave_header(0)) :]
    return hashlib.sha256(payload).hexdigest(), len(payload), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), describe(payload)


FACTS = "payload_sha256 string, payload_bytes long, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
#: ``shared`` is 0 or 1, and the folder that a row lies in.
CHUNKS = "digest binary, shared int, media binary, of int, uses long, seqs array<int>, sizes array<int>, body binary"
_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<binary>": pa.list_(pa.binary())}


def _rows(rows: list[tuple], schema: str, first: pa.Array | None = None) -> pa.RecordBatch:
    """Rows of tuples as a batch; ``first``: a column to be put in front."""
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    arrays = [pa.array(c, _KINDS[t]) for c, (_, t) in zip(columns, fields, strict=True)]
    return pa.RecordBatch.from_arrays([first, *arrays] if first is not None else arrays, [*(["key"] if first is not None else []), *(n for n, _ in fields)])


def _slices(batches: Iterator[pa.RecordBatch], size: int = 256) -> Iterator[pa.RecordBatch]:
    """Small slices, as rows may be long."""
    return (b.slice(at, size) for b in batches for at in range(0, b.num_rows, size))


def dictionary(docs: DataFrame, key: str, text: str) -> bytes:
    """Common passages of a bounded sample; empty where there is too little to learn from."""
    sample = bounded_sample(docs.select(key, text).filter(F.col(text).isNotNull()), [key, text], SAMPLE, 3)
    texts = [r[0].encode("utf-8")[:SAMPLE_BYTES] for r in sample.select(F.substring(text, 1, SAMPLE_BYTES)).limit(2 * SAMPLE).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY, texts).as_bytes()
    except zstandard.ZstdError:
        return b""


def _codec(words: bytes) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    known = zstandard.ZstdCompressionDict(words) if words else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=known), zstandard.ZstdDecompressor(dict_data=known)


def store(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", unit: int = 576) -> None:
    """Write ``path``/chunks, ``path``/media (media, seq, digest, of, own, copies: a row per chunk of each distinct wave),
    ``path``/rows (key, media, n_bytes) and ``path``/dictionary."""
    spark = docs.sparkSession
    docs = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    words = dictionary(docs, "key", "text")
    spark.createDataFrame([(words,)], "words binary").coalesce(1).write.parquet(f"{path}/dictionary")
    shared_words = spark.sparkContext.broadcast(words)

    def lists(batches):
        for b in _slices(batches):
            out = []
            for t in b.column(1).to_pylist():
                n, payload = padded(t, unit)
                whole, at, names = wave(payload), 0, []
                for end in cuts(whole):
                    names.append(digest(whole[at:end]))
                    at = end
                out.append((hashlib.sha256(whole).digest(), n, names))
            yield _rows(out, "media binary, n_bytes long, digests array<binary>", b.column(0))

    kind = docs.schema["key"].dataType.simpleString()
    listed = docs.mapInArrow(lambda b: trimmed(lists(b)), f"key {kind}, media binary, n_bytes long, digests array<binary>")
    listed.write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")

    # who has which chunk: digests only
    once = written(rows.groupBy("media").agg(F.first("digests").alias("digests"), F.count("*").alias("copies")))
    uses = once.select("media", F.posexplode("digests").alias("seq", "digest")).groupBy("digest").agg(F.count("*").alias("uses"), F.min(F.struct("media", "seq")).alias("at"))
    own = F.sort_array(F.collect_list(F.when(F.col("uses") == 1, F.col("at.seq"))))
    lent = F.sort_array(F.collect_list(F.when(F.col("uses") > 1, F.struct("at.seq", "uses"))))
    plan = written(uses.groupBy("at.media").agg(own.alias("own"), lent.alias("lent")))
    chunk_rows = once.join(plan.select("media", "own"), "media", "left").select("media", "own", "copies", F.size("digests").alias("of"), F.posexplode("digests").alias("seq", "digest"))
    chunk_rows.select("media", "seq", "digest", "of", F.coalesce(F.array_contains("own", F.col("seq")), F.lit(False)).alias("own"), "copies").write.parquet(f"{path}/media")

    # each wave's bytes move to its plan, which sorts before them
    def bodies(batches):
        squeeze, seen = _codec(shared_words.value)[0], set()
        for b in _slices(batches):
            out = []
            for t in b.column(0).to_pylist():
                whole = wave(padded(t, unit)[1])
                name = hashlib.sha256(whole).digest()
                if name not in seen:  # copies within a task don't reach the shuffle
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(name)
                    out.append((name, squeeze.compress(whole)))
            yield _rows(out, "media binary, body binary")

    def chosen(batches):
        squeeze, unpack = _codec(shared_words.value)
        now, plan = None, None
        for b in _slices(batches):
            out = []
            for name, mine, lend, body in zip(*(b.column(k).to_pylist() for k in ("media", "own", "lent", "body")), strict=True):
                if body is None:
                    now, plan = name, (mine, lend)
                elif name == now and plan is not None:
                    whole = unpack.decompress(body)
                    ends = cuts(whole)
                    piece = lambda k, whole=whole, ends=ends: whole[ends[k - 1] if k else 0 : ends[k]]
                    if plan[0]:
                        parts = [piece(k) for k in plan[0]]
                        joined = b"".join(parts)
                        out.append((digest(joined), 0, name, len(ends), 1, plan[0], [len(p) for p in parts], squeeze.compress(joined)))
                    for x in plan[1]:
                        p = piece(x["seq"])
                        out.append((digest(p), 1, None, None, x["uses"], None, None, squeeze.compress(p)))
                    plan = None  # further copies of this wave have nothing to add
            yield _rows(out, CHUNKS)

    moving = docs.select("text").mapInArrow(lambda b: trimmed(bodies(b)), "media binary, body binary")
    both = plan.withColumn("body", F.lit(None).cast("binary")).unionByName(moving, allowMissingColumns=True)
    both = both.repartition("media").sortWithinPartitions("media", F.col("body").isNotNull())
    both.mapInArrow(lambda b: trimmed(chosen(b)), CHUNKS).write.option("compression", "none").partitionBy("shared").parquet(f"{path}/chunks")


def _hot(counts: DataFrame, n: str, total: int) -> DataFrame:
    return counts.filter(F.col(n) > max(HOT_LEAST, total // HOT_SHARE))


def _waves(spark: SparkSession, path: str, results, schema: str) -> DataFrame:
    """``results`` of every distinct wave (its bytes, verified), after its name: (media, ...schema)."""
    chunks = spark.read.schema(CHUNKS).parquet(f"{path}/chunks")
    media = spark.read.parquet(f"{path}/media")
    try:
        known = b"".join(bytes(r.words) for r in spark.read.parquet(f"{path}/dictionary").collect())
    except AnalysisException:  # a store without one; where its rows need it, they count as damaged
        known = b""
    words = spark.sparkContext.broadcast(known)
    schema = f"media binary, {schema}"

    def unpacked(unpack, name: bytes, body: bytes) -> bytes:
        try:
            raw = unpack.decompress(body)
        except zstandard.ZstdError:
            raw = b""
        if digest(raw) != name:
            raise ValueError(f"damaged chunk {name.hex()}")
        return raw

    def whole(name: bytes, raw: bytes) -> tuple:
        if hashlib.sha256(raw).digest() != name:
            raise ValueError(f"wave {name.hex()} isn't what was stored")
        return name, *results(raw)

    def alone(batches):
        unpack = _codec(words.value)[1]
        for b in _slices(batches):
            yield _rows([whole(m, unpacked(unpack, d, z)) for m, d, z in zip(*(b.column(k).to_pylist() for k in ("media", "digest", "body")), strict=True)], schema)

    def rebuilt(batches):
        unpack = _codec(words.value)[1]
        now, of, parts = None, 0, {}

        def done():
            lost = [k for k in range(of) if k not in parts]
            if lost:
                raise ValueError(f"missing chunk {lost[0]} of {now.hex()}")
            return whole(now, b"".join(parts[k] for k in range(of)))

        for b in _slices(batches):
            out = []
            for m, n, seq, seqs, sizes, d, z in zip(*(b.column(k).to_pylist() for k in ("media", "of", "seq", "seqs", "sizes", "digest", "body")), strict=True):
                if m != now:
                    out += [done()] if now is not None else []
                    now, of, parts = m, n, {}
                if z is None:
                    raise ValueError(f"missing chunk {seq} of {m.hex()}")
                raw = unpacked(unpack, d, z)
                if seqs is None:
                    parts[seq] = raw
                    continue
                at = 0
                for k, size in zip(seqs, sizes, strict=True):
                    parts[k] = raw[at : at + size]
                    at += size
            yield _rows(out, schema)
        if now is not None:
            yield _rows([done()], schema)

    packs, pool = chunks.filter("shared = 0"), chunks.filter("shared = 1").select("digest", "uses", "body")
    complete = F.size("seqs") == F.col("of")
    short = packs.filter(complete).select("media", "digest", "body").mapInArrow(lambda b: trimmed(alone(b)), schema)
    asked = media.filter(~F.col("own")).select("media", "of", "seq", "digest")
    hot = written(_hot(pool, "uses", media.count()).select("digest", "body"))
    names = F.broadcast(hot.select("digest"))
    fetched = asked.join(F.broadcast(hot), "digest").unionByName(asked.join(names, "digest", "left_anti").join(pool.join(names, "digest", "left_anti").select("digest", "body"), "digest", "left"))
    parts = fetched.unionByName(packs.filter(~complete).select("media", "of", "seqs", "sizes", "digest", "body"), allowMissingColumns=True)
    ordered = parts.select("media", "of", "seq", "seqs", "sizes", "digest", "body").repartition("media").sortWithinPartitions("media", F.col("seq").asc_nulls_first())
    return short.unionByName(ordered.mapInArrow(lambda b: trimmed(rebuilt(b)), schema))


def _of_rows(spark: SparkSession, path: str, found: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Every stored row with what was found for its wave; a row whose wave is nowhere fails the read."""
    rows, media = spark.read.parquet(f"{path}/rows").select("key", "media", "n_bytes"), spark.read.parquet(f"{path}/media")
    hot = written(_hot(media.filter("seq = 0"), "copies", rows.count()).select("media"))
    few = F.broadcast(hot)
    found = found.withColumn("_found", F.lit(True))
    known = rows.join(few, "media", "left_semi").join(F.broadcast(found.join(few, "media", "left_semi")), "media", "left")
    known = known.unionByName(rows.join(few, "media", "left_anti").join(found.join(few, "media", "left_anti"), "media", "left"))
    lost = F.raise_error(F.concat(F.lit("missing chunk or wave "), F.hex("media"))).cast("boolean")
    return known.filter(F.coalesce("_found", lost)).select("key", "n_bytes", *columns)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every stored row with the facts of its wave as read back: key, n_bytes and the FACTS columns."""
    facts = written(_waves(spark, path, _facts, FACTS))
    return _of_rows(spark, path, facts, tuple(x.split()[0] for x in FACTS.split(", ")))


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """(key, payload): the stored bytes of every row, rebuilt and verified. For export; moves all bytes."""
    start = len(wave_header(0))
    found = _waves(spark, path, lambda raw: (raw[start:],), "payload binary")
    rows = spark.read.parquet(f"{path}/rows").select("key", "media").join(found, "media", "left")
    lost = F.raise_error(F.concat(F.lit("missing chunk or wave "), F.hex("media"))).cast("binary")
    return rows.select("key", F.coalesce("payload", lost).alias("payload"))
