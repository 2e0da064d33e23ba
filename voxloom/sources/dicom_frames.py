"""Multi-frame DICOM files and the private headers of mosaics: nested elements to rows.

A file's frames become rows of their own, each with the geometry of its own functional groups or, where it has none, of the
shared ones; Spark sorts them into stacks and volumes. The private header of a mosaic is a table of named values inside one
element; its slice normal says in which order the tiles lie.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxloom.sources.dicom import BINARY, LONG_FORM, NUMBERS, OPEN, SYNTAX_BIG, SYNTAX_IMPLICIT, TAGS, numbers, slice_position, stored_values

# Tags of the format.
ITEM, ITEM_END, SEQUENCE_END = 0xFFFEE000, 0xFFFEE00D, 0xFFFEE0DD
SHARED, PER_FRAME = 0x52009229, 0x52009230
POSITIONS, ORIENTATIONS, MEASURES, CONTENT, TRANSFORMS = 0x00209113, 0x00209116, 0x00289110, 0x00209111, 0x00289145
STACK, IN_STACK, TIME, GAP = 0x00209056, 0x00209057, 0x00209128, 0x00180088
PRIVATE = 0x00291010
SEQUENCES = {SHARED, PER_FRAME, POSITIONS, ORIENTATIONS, MEASURES, CONTENT, TRANSFORMS}
NAMES = TAGS | {STACK: "stack", IN_STACK: "in_stack", TIME: "time", PRIVATE: "private"}
WORDS = BINARY | {"in_stack": "I", "time": "I"}

FRAME = (
    "frame int, rows int, cols int, spacing array<double>, thickness double, position array<double>, orientation array<double>, stack string, in_stack long, time long, "
    "data array<double>"
)


class Reader:
    """Elements of a file as nested dictionaries: tag to (representation, bytes) or to a list of items."""

    def __init__(self, raw: bytes):
        self.raw, self.order, self.explicit = raw, "<", True

    def header(self, at: int) -> tuple[int, bytes, int, int]:
        """(tag, representation, size, where the value begins)."""
        raw, order = self.raw, self.order
        group, element = struct.unpack_from(order + "2H", raw, at)
        tag = group << 16 | element
        kind = raw[at + 4 : at + 6] if self.explicit and group != 0xFFFE else b""
        if kind in LONG_FORM:
            return tag, kind, struct.unpack_from(order + "I", raw, at + 8)[0], at + 12
        if kind.isalpha():
            return tag, kind, struct.unpack_from(order + "H", raw, at + 6)[0], at + 8
        return tag, b"", struct.unpack_from(order + "I", raw, at + 4)[0], at + 8

    def file(self) -> dict:
        at, syntax, found = 132 if self.raw[128:132] == b"DICM" else 0, "", {}
        while at + 8 <= len(self.raw) and self.raw[at : at + 2] == b"\x02\x00":  # the group before the transfer syntax holds
            tag, kind, size, at = self.header(at)
            found[tag] = (kind, self.raw[at : at + size])
            at += size
        syntax = found.get(0x00020010, (b"", b""))[1].decode("ascii", "replace").strip("\0 ")
        self.order, self.explicit = ">" if syntax == SYNTAX_BIG else "<", syntax != SYNTAX_IMPLICIT
        return found | self.elements(at, len(self.raw))[0]

    def elements(self, at: int, end: int) -> tuple[dict, int]:
        """The elements up to ``end`` or to the mark that closes an item."""
        out: dict = {}
        while at + 8 <= end:
            tag, kind, size, at = self.header(at)
            if tag in (ITEM_END, SEQUENCE_END):
                return out, at
            if kind == b"SQ" or tag in SEQUENCES or size == OPEN and kind in (b"", b"UN"):
                out[tag], at = self.items(at, end if size == OPEN else min(end, at + size), size == OPEN)
            elif size == OPEN or at + size > end:
                return out, end  # pixels in packets, or a file that is cut off
            else:
                out[tag] = (kind, self.raw[at : at + size])
                at += size
        return out, at

    def items(self, at: int, end: int, marked: bool) -> tuple[list[dict], int]:
        out = []
        while at + 8 <= end:
            tag, _, size, begin = self.header(at)
            if tag == SEQUENCE_END:
                return out, begin
            if tag != ITEM:
                break
            item, after = self.elements(begin, end if size == OPEN else min(end, begin + size))
            out.append(item)
            at = after if size == OPEN else begin + size
        return out, at if marked else end

    def named(self, item: dict) -> dict:
        """Known elements of an item by name, as numbers or text."""
        out = {}
        for tag, value in item.items():
            name = NAMES.get(tag)
            if name is None or isinstance(value, list):
                continue
            kind, raw = value
            code = NUMBERS.get(kind) or (WORDS.get(name) if kind in (b"", b"UN") else None)
            if name in ("pixels", "private"):
                out[name] = raw
            elif code and len(raw) >= struct.calcsize(code):
                out[name] = struct.unpack_from(self.order + code, raw)[0]
            else:
                out[name] = raw.decode("latin-1").strip("\0 ")
        return out


def first(item: dict, tag: int) -> dict:
    """The first item of a sequence inside an item; empty if there is none."""
    found = item.get(tag)
    return found[0] if isinstance(found, list) and found else {}


def groups(reader: Reader, item: dict) -> dict:
    """What one item of functional groups says about its frame."""
    own = {}
    for tag in (POSITIONS, ORIENTATIONS, MEASURES, CONTENT, TRANSFORMS):
        own |= reader.named(first(item, tag))
    return own


def frames_of(raw: bytes) -> tuple[str | None, list[dict]]:
    """Series and frames of a file; none if pixels and header don't fit."""
    reader = Reader(raw)
    tree = reader.file()
    head = reader.named(tree)
    shared, own = groups(reader, first(tree, SHARED)), tree.get(PER_FRAME)
    own = own if isinstance(own, list) else []
    n, rows, cols, bits = int((numbers(head.get("frames")) or [1])[0]), int(head.get("rows") or 0), int(head.get("cols") or 0), int(head.get("bits_allocated") or 16)
    size = rows * cols
    if "pixels" not in head or not size or bits not in (8, 16, 32) or len(head["pixels"]) < n * size * bits // 8:
        return head.get("series"), []
    pixels = np.frombuffer(head["pixels"][: n * size * bits // 8], np.dtype(f"{reader.order}u{bits // 8}"))
    values = stored_values(pixels, int(head.get("bits_stored") or bits), int(head.get("high_bit", bits - 1)), bool(head.get("signed"))).reshape(n, size)
    out = []
    for k in range(n):
        h = head | shared | (groups(reader, own[k]) if k < len(own) else {})
        slope, shift = (numbers(h.get("slope")) or [1.0])[0] or 1.0, (numbers(h.get("intercept")) or [0.0])[0]
        spacing = numbers(h.get("spacing"))
        whole = lambda name, h=h: int(h[name]) if isinstance(h.get(name), int) else None
        out.append(
            {
                "frame": k, "rows": rows, "cols": cols, "spacing": spacing if len(spacing) == 2 else [1.0, 1.0], "thickness": (numbers(h.get("slice_gap")) or numbers(h.get("thickness")) or [3.0])[0],
                "position": numbers(h.get("position")), "orientation": numbers(h.get("orientation")), "stack": str(h["stack"]) if "stack" in h else None, "in_stack": whole("in_stack"), "time": whole("time"),
                "data": (values[k] * slope + shift).tolist(),
            }
        )
    return head.get("series"), out


def frames(found: DataFrame) -> DataFrame:
    """``found`` (path, content) as a row a frame: (path, series, frame, geometry, stack, time, data). Files that can't be read,
    or whose pixels don't fit their header, have none."""
    fields = [f.split() for f in FRAME.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}

    def run(batches):
        for b in batches:
            for path, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):  # one file's frames at a time
                try:
                    series, rows = frames_of(raw or b"")
                except (struct.error, ValueError, IndexError, OverflowError):
                    continue
                if rows:
                    columns = [pa.array([r[n] for r in rows], kinds[k]) for n, k in fields]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array([series] * len(rows), pa.string()), *columns], ["path", "series", *(n for n, _ in fields)])

    return found.select("path", "content").mapInArrow(run, f"path string, series string, {FRAME}")


def volumes(frames: DataFrame, digits: int = 2) -> DataFrame:
    """(path, series, stack, volume, nx, ny, nz, orientation, positions, data): frames stacked into volumes.

    Frames of a file with the same orientation, spacing and stack belong together. A slice is a place along the normal, rounded
    to ``digits``; the k-th frame at a place, by time and frame number, belongs to volume k. File rows run against y.
    Whatever is ranked are keys; the pixels are joined to their place afterwards."""
    of = ["path", "orientation", "spacing", "stack"]
    place = F.round(slice_position(F.col("position"), F.col("orientation")), digits)
    keys = frames.select(*of, "frame", "time", place.alias("place"))
    turn = Window.partitionBy(*of, "place").orderBy(F.col("time").asc_nulls_last(), "frame")
    ranked = keys.withColumn("volume", F.row_number().over(turn) - 1).select("path", "frame", "volume", "place")
    flipped = F.flatten(F.transform(F.sequence(F.lit(1), F.col("rows")), lambda r: F.slice("data", (F.col("rows") - r) * F.col("cols") + 1, F.col("cols"))))
    one = F.struct("place", "frame", "position", flipped.alias("data"))
    got = frames.join(ranked, ["path", "frame"]).groupBy(*of, "series", "volume", F.col("cols").alias("nx"), F.col("rows").alias("ny")).agg(F.sort_array(F.collect_list(one)).alias("s"))
    return got.select("path", "series", "stack", "volume", "nx", "ny", F.size("s").alias("nz"), "orientation", F.col("s.place").alias("places"), F.col("s.position").alias("positions"), F.flatten(F.col("s.data")).alias("data"))


# --- private headers -----------------------------------------------------------------------------------------------------
def private_values(raw: bytes) -> dict[str, list[str]]:
    """The named values of a private header: a count of entries, then for each a name, a number of items, and the items as
    text, padded to four bytes. The newer form starts with a mark."""
    newer = raw[:4] == b"SV10"
    at = 8 if newer else 0
    if len(raw) < at + 8:
        return {}
    entries, out = struct.unpack_from("<I", raw, at)[0], {}
    at += 8
    for _ in range(min(entries, 1000)):
        if at + 84 > len(raw):
            break
        name = raw[at : at + 64].split(b"\0")[0].decode("latin-1")
        items = struct.unpack_from("<i", raw, at + 76)[0]
        at += 84
        values = []
        for _ in range(max(0, items)):
            if at + 16 > len(raw):
                return out
            sizes = struct.unpack_from("<4i", raw, at)
            size = sizes[1] if newer else sizes[0]
            at += 16
            if size < 0 or at + size > len(raw):
                return out
            values.append(raw[at : at + size].split(b"\0")[0].decode("latin-1").strip())
            at += -(-size // 4) * 4
        out[name] = [v for v in values if v]
    return out


def encoded_private(values: dict[str, Sequence[str]]) -> bytes:
    """A private header of the newer form, for tests and exports."""
    out = [b"SV10\4\3\2\1", struct.pack("<2I", len(values), 77)]
    for name, items in values.items():
        out.append(name.encode("latin-1").ljust(64, b"\0") + struct.pack("<i4s3i", len(items), b"FD\0\0", 0, len(items), 77))
        for item in items:
            text = item.encode("latin-1") + b"\0"
            out.append(struct.pack("<4i", len(text), len(text), 77, len(text)) + text.ljust(-(-len(text) // 4) * 4, b"\0"))
    return b"".join(out)


PRIVATE_FIELDS = "path string, tiles int, normal array<double>, orientation array<double>"


def private_headers(found: DataFrame) -> DataFrame:
    """(path, tiles, normal, orientation) of files with a private header: the number of tiles, the slice normal it states,
    and the public orientation; null or empty where they are missing."""

    def run(batches):
        for b in batches:
            rows = []
            for path, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    reader = Reader(raw or b"")
                    h = reader.named(reader.file())
                    own = private_values(h.get("private", b""))
                except (struct.error, ValueError, IndexError):
                    h, own = {}, {}
                tiles = [n for v in own.get("NumberOfImagesInMosaic", []) for n in numbers(v)]
                rows.append((path, int(tiles[0]) if tiles else None, [n for v in own.get("SliceNormalVector", []) for n in numbers(v)], numbers(h.get("orientation"))))
            columns = zip(*rows, strict=True) if rows else [()] * 4
            kinds = (pa.string(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "tiles", "normal", "orientation"])

    return found.select("path", "content").mapInArrow(run, PRIVATE_FIELDS)


def runs_backwards(normal: Column, orientation: Column) -> Column:
    """Whether the stated normal points against the plane's own; false where either is missing."""
    n = lambda k: F.get(normal, F.lit(k))
    along = slice_position(F.array(n(0), n(1), n(2)), orientation)
    return F.coalesce(along < 0, F.lit(False))


def reversed_slices(data: Column, plane: int, slices: int) -> Column:
    return F.flatten(F.transform(F.sequence(F.lit(slices - 1), F.lit(0), F.lit(-1)), lambda z: F.slice(data, z * plane + 1, plane)))


def in_order(volumes: DataFrame, private: DataFrame, plane: int, slices: int, data: str = "data") -> DataFrame:
    """``volumes`` (with path) with the slices of those files turned round whose private header says so; ``backwards`` tells."""
    told = private.select("path", runs_backwards(F.col("normal"), F.col("orientation")).alias("backwards"))
    got = volumes.join(told, "path", "left").withColumn("backwards", F.coalesce("backwards", F.lit(False)))
    return got.withColumn(data, F.when(F.col("backwards"), reversed_slices(F.col(data), plane, slices)).otherwise(F.col(data)))


def sequence_element(tag: int, items: Sequence[bytes], marked: bool = False) -> bytes:
    """A sequence of items, with sizes or (``marked``) with closing marks."""
    head = struct.pack("<2H2s2x", tag >> 16, tag & 0xFFFF, b"SQ")
    mark = lambda t, n: struct.pack("<2HI", t >> 16, t & 0xFFFF, n)
    if marked:
        body = b"".join(mark(ITEM, OPEN) + i + mark(ITEM_END, 0) for i in items) + mark(SEQUENCE_END, 0)
        return head + struct.pack("<I", OPEN) + body
    body = b"".join(mark(ITEM, len(i)) + i for i in items)
    return head + struct.pack("<I", len(body)) + body


def element(tag: int, kind: bytes, value: bytes) -> bytes:
    value += (b"\0" if kind in (b"OB", b"OW", b"UI") else b" ") * (len(value) % 2)
    size = b"\0\0" + struct.pack("<I", len(value)) if kind in LONG_FORM else struct.pack("<H", len(value))
    return struct.pack("<2H", tag >> 16, tag & 0xFFFF) + kind + size + value


def encoded_frames(pixels: np.ndarray, positions: Sequence[Sequence[float]], orientation: Sequence[float], series: str, stacks: Sequence[str], times: Sequence[int], slopes: Sequence[float], marked: bool = False) -> bytes:
    """A multi-frame file (frames x rows x cols, 16-bit signed) with shared orientation and its frames' own places, stacks,
    times and slopes, for tests and exports."""
    text = lambda v: "\\".join(f"{x:g}" for x in v).encode()
    n, rows, cols = pixels.shape
    shared = sequence_element(ORIENTATIONS, [element(0x00200037, b"DS", text(orientation))], marked) + sequence_element(MEASURES, [element(0x00180050, b"DS", b"2") + element(0x00280030, b"DS", b"2\\2")], marked)
    own = [
        sequence_element(CONTENT, [element(STACK, b"SH", stacks[k].encode()) + element(TIME, b"UL", struct.pack("<I", times[k]))], marked)
        + sequence_element(POSITIONS, [element(0x00200032, b"DS", text(positions[k]))], marked)
        + sequence_element(TRANSFORMS, [element(0x00281052, b"DS", b"0") + element(0x00281053, b"DS", text([slopes[k]]))], marked)
        for k in range(n)
    ]
    word = lambda tag, v: element(tag, b"US", struct.pack("<H", v))
    return b"\0" * 128 + b"DICM" + b"".join(
        [
            element(0x0020000E, b"UI", series.encode()), element(0x00280008, b"IS", str(n).encode()), word(0x00280010, rows), word(0x00280011, cols), word(0x00280100, 16), word(0x00280101, 16), word(0x00280102, 15), word(0x00280103, 1),
            sequence_element(SHARED, [shared], marked), sequence_element(PER_FRAME, own, marked), element(0x7FE00010, b"OW", pixels.astype("<i2").tobytes()),
        ]
    )
