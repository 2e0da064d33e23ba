"""DICOM slices to header rows, volume series and sidecars.

Files come from Spark's binaryFile source, one file a row. A small reader takes the elements that geometry and pixels need,
in explicit or implicit, little or big endian form, and walks over everything else; ordering, grouping, placing and
selection of files are Spark expressions on its rows. A file that isn't readable has a row with ``class`` guff.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxloom.operators.layout import demosaic

# Tags and value representations of the format.
TAGS = {
    0x00080008: "image_type", 0x00080016: "sop_class", 0x00080020: "study_date", 0x00080060: "modality", 0x00100010: "patient_name", 0x00100030: "birth_date", 0x00180050: "thickness",
    0x00180088: "slice_gap", 0x0019100A: "mosaic_images", 0x0020000E: "series", 0x00200013: "instance", 0x00200032: "position", 0x00200037: "orientation", 0x00280008: "frames",
    0x00280010: "rows", 0x00280011: "cols", 0x00280030: "spacing", 0x00280100: "bits_allocated", 0x00280101: "bits_stored", 0x00280102: "high_bit", 0x00280103: "signed",
    0x00281052: "intercept", 0x00281053: "slope", 0x7FE00010: "pixels",
}
LONG_FORM = (b"OB", b"OW", b"OF", b"SQ", b"UT", b"UN")
NUMBERS = {b"US": "H", b"SS": "h", b"UL": "I", b"SL": "i", b"FL": "f", b"FD": "d"}
BINARY = {"rows": "H", "cols": "H", "bits_allocated": "H", "bits_stored": "H", "high_bit": "H", "signed": "H", "mosaic_images": "H"}
SYNTAX_IMPLICIT, SYNTAX_BIG = "1.2.840.10008.1.2", "1.2.840.10008.1.2.2"
SPECTRUM = "1.2.840.10008.5.1.4.1.1.4.2"
OPEN = 0xFFFFFFFF

FIELDS = (
    "class string, series string, instance long, rows int, cols int, frames int, spacing array<double>, thickness double, position array<double>, orientation array<double>, "
    "mosaic_images int, header map<string,string>, data array<double>"
)


def elements(raw: bytes) -> Iterator[tuple[int, bytes, bytes, str]]:
    """(tag, representation, value, byte order) of the top level; nested sequences are stepped over."""
    at = 132 if raw[128:132] == b"DICM" else 0
    order, explicit, syntax = "<", True, ""
    while at + 8 <= len(raw):
        if syntax and raw[at : at + 2] != b"\x02\x00":  # the preamble's group is over
            order, explicit, syntax = (">" if syntax == SYNTAX_BIG else "<"), syntax != SYNTAX_IMPLICIT, ""
        group, element = struct.unpack_from(order + "2H", raw, at)
        kind = raw[at + 4 : at + 6] if explicit else b""
        if explicit and kind in LONG_FORM:
            size, at = struct.unpack_from(order + "I", raw, at + 8)[0], at + 12
        elif explicit and kind.isalpha():
            size, at = struct.unpack_from(order + "H", raw, at + 6)[0], at + 8
        else:  # implicit, as items always are
            size, at = struct.unpack_from(order + "I", raw, at + 4)[0], at + 8
        if group == 0xFFFE or (size == OPEN and kind != b"OB"):
            continue  # item marks, and sequences without a length: their elements follow
        if size == OPEN or at + size > len(raw):
            return
        value = raw[at : at + size]
        at += size
        if (group, element) == (2, 0x10):
            syntax = value.decode("ascii", "replace").strip("\0 ")
        yield group << 16 | element, kind, value, order


def parsed(raw: bytes) -> dict:
    """The known elements by name; the first of each, as numbers or text."""
    out: dict = {}
    for tag, kind, value, order in elements(raw):
        name = TAGS.get(tag)
        if name is None or name in out:
            continue
        code = NUMBERS.get(kind) or (BINARY.get(name) if kind in (b"", b"UN") else None)
        if name == "pixels":
            out[name], out["order"] = value, order
        elif code and len(value) >= struct.calcsize(code):
            out[name] = struct.unpack_from(order + code, value)[0]
        else:
            out[name] = value.decode("latin-1").strip("\0 ")
    return out


def numbers(text) -> list[float]:
    """The numbers of a multi-valued text; what isn't one is left out."""
    found = []
    for part in str(text).split("\\") if text not in (None, "") else []:
        try:
            found.append(float(part))
        except ValueError:
            continue
    return found


def stored_values(raw: np.ndarray, stored: int, high: int, signed: bool) -> np.ndarray:
    """Whole numbers out of the ``stored`` bits that end at bit ``high``; signed ones from two's complement."""
    v = raw.astype(np.int64) >> max(0, high - stored + 1) & ((1 << stored) - 1)
    return np.where(v >> (stored - 1) & 1, v - (1 << stored), v) if signed else v


def stored_value(raw: Column, stored: int, high: int, signed: bool) -> Column:
    """The same for a column of raw words."""
    v = F.shiftright(raw.cast("long"), max(0, high - stored + 1)).bitwiseAND(F.lit((1 << stored) - 1))
    return F.when(v >= 1 << (stored - 1), v - (1 << stored)).otherwise(v) if signed else v


def kind_of(h: dict) -> str:
    """Which converter a file goes to."""
    if "pixels" not in h or not h.get("rows") or not h.get("cols"):
        return "spectroscopy" if h.get("sop_class") == SPECTRUM else "guff"
    if numbers(h.get("frames"))[:1] > [1.0]:
        return "multiframe"
    if "MOSAIC" in str(h.get("image_type", "")).upper() or h.get("mosaic_images"):
        return "mosaic"
    return "standard" if len(numbers(h.get("position"))) == 3 and len(numbers(h.get("orientation"))) == 6 else "tomographic"


def decoded(h: dict) -> list[float] | None:
    """Pixels as numbers, all frames, scaled by slope and intercept; None if they don't fit the header."""
    bits = int(h.get("bits_allocated") or 16)
    n = int(h["rows"]) * int(h["cols"]) * int((numbers(h.get("frames")) or [1])[0])
    if bits not in (8, 16, 32) or len(h["pixels"]) < n * bits // 8:
        return None
    raw = np.frombuffer(h["pixels"][: n * bits // 8], np.dtype(f"{h['order']}u{bits // 8}"))
    v = stored_values(raw, int(h.get("bits_stored") or bits), int(h.get("high_bit", bits - 1)), bool(h.get("signed")))
    slope, shift = (numbers(h.get("slope")) or [1.0])[0], (numbers(h.get("intercept")) or [0.0])[0]
    return v * (slope or 1.0) + shift


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the ``.dcm`` files and those without an extension below ``path``. A folder that has such files
    itself hides those of its subfolders."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return shallowest(found.filter(F.element_at(F.split("path", "/"), -1).rlike(r"(?i)\.dcm$|^[^.]+$")).select("path", "content"))


def shallowest(found: DataFrame, path: str = "path") -> DataFrame:
    """Without the files that have a file in a folder above their own."""
    folder = F.regexp_replace(path, "/[^/]*$", "")
    folders = found.select(folder.alias("_above")).distinct()
    own = folders.withColumnRenamed("_above", "_folder")
    parts = F.split("_folder", "/")
    above = own.select("_folder", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("_above"))
    hidden = above.filter(F.col("_above") != F.col("_folder")).join(folders, "_above", "left_semi").select("_folder").distinct()
    return found.withColumn("_folder", folder).join(hidden, "_folder", "left_anti").drop("_folder")


def headers(found: DataFrame, keep: Sequence[str] = ("study_date", "modality", "patient_name", "birth_date")) -> DataFrame:
    """``found`` (path, content) as a row per file: class, geometry, ``keep`` as a map of text, and the decoded pixels."""

    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in FIELDS.split(", ")]
            for raw in b.column("content").to_pylist():
                try:
                    h = parsed(raw or b"")
                except (struct.error, ValueError, IndexError):
                    h = {}
                kind = kind_of(h)
                values = decoded(h) if "pixels" in h and kind != "guff" else None
                one = lambda name, default=None, h=h: (numbers(h.get(name)) or [default])[0]
                whole = lambda x: None if x is None else int(x)
                row = (
                    kind if values is not None or kind == "spectroscopy" else "guff", h.get("series"), whole(one("instance")), whole(one("rows")), whole(one("cols")), whole(one("frames", 1)),
                    (numbers(h.get("spacing")) + [1.0, 1.0])[:2] if numbers(h.get("spacing")) else [1.0, 1.0], one("slice_gap", one("thickness", 3.0)), numbers(h.get("position")), numbers(h.get("orientation")),
                    whole(one("mosaic_images")), [(k, str(h[k])) for k in keep if k in h], values,
                )
                for column, v in zip(out, row, strict=True):
                    column.append(v)
            names = [f.split()[0] for f in FIELDS.split(", ")]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.int32(), pa.map_(pa.string(), pa.string()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([b.column("path"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["path", *names])

    return found.select("path", "content").mapInArrow(run, f"path string, {FIELDS}")


def mosaic_series(rows: DataFrame, tile: int, slices: int) -> DataFrame:
    """(series, t, path, data): each mosaic is one volume; scans in the order of their instance numbers, then of their files."""
    side = math.ceil(math.sqrt(slices))
    scan = F.row_number().over(Window.partitionBy("series").orderBy(F.col("instance").asc_nulls_last(), "path")) - 1
    ok = rows.filter((F.col("class") == "mosaic") & (F.size("data") == (tile * side) ** 2))
    # keys are ranked, and the pixels joined to their place: a long series is one window of keys
    places = ok.select("series", "instance", "path").withColumn("t", scan).select("path", "t")
    return ok.join(places, "path").select("series", "t", "path", demosaic(F.col("data"), tile, side, slices).alias("data"))


def slice_position(position: Column, orientation: Column) -> Column:
    """Where a slice lies along the normal of its plane."""
    p, o = (lambda k: F.get(position, F.lit(k))), (lambda k: F.get(orientation, F.lit(k)))
    return p(0) * (o(1) * o(5) - o(2) * o(4)) + p(1) * (o(2) * o(3) - o(0) * o(5)) + p(2) * (o(0) * o(4) - o(1) * o(3))


def stacked(rows: DataFrame) -> DataFrame:
    """(series, nx, ny, nz, positions, data): the standard slices of each series as one volume, by their place along the
    normal, then instance number, then file; file rows run against y. A series is one volume and one row."""
    ok = rows.filter(F.col("class").isin("standard", "tomographic"))
    flipped = F.flatten(F.transform(F.sequence(F.lit(1), F.col("rows")), lambda r: F.slice("data", (F.col("rows") - r) * F.col("cols") + 1, F.col("cols"))))
    one = F.struct(slice_position(F.col("position"), F.col("orientation")).alias("at"), F.coalesce("instance", F.lit(0)).alias("instance"), "path", flipped.alias("data"))
    got = ok.groupBy("series", F.col("cols").alias("nx"), F.col("rows").alias("ny")).agg(F.sort_array(F.collect_list(one)).alias("s"))
    return got.select("series", "nx", "ny", F.size("s").alias("nz"), F.col("s.at").alias("positions"), F.flatten(F.col("s.data")).alias("data"))


def evenly_spaced(positions: Sequence[float], tolerance: float = 1e-3):
    """Kernel for ``layout.map_arrays``: slices at uneven ``positions`` interpolated to even ones, as far apart as the
    closest two. Even stacks stay as they are."""
    at = np.asarray(positions, float)
    gaps = np.diff(at)
    if len(at) < 3 or gaps.max() - gaps.min() <= tolerance:
        return lambda flat: flat
    wanted = np.arange(at[0], at[-1] + gaps.min() * 1e-6, gaps.min())
    low = np.clip(np.searchsorted(at, wanted, side="right") - 1, 0, len(at) - 2)
    share = (wanted - at[low]) / gaps[low]

    def kernel(flat):
        v = flat.reshape(len(flat), len(at), -1)
        return (v[:, low] * (1 - share)[None, :, None] + v[:, low + 1] * share[None, :, None]).reshape(len(flat), -1)

    return kernel


def trimmed(data: Column, plane: int, slices: int) -> Column:
    """A volume without the slices at its end that are all 0; one slice always stays."""
    last = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(slices - 1)), lambda z: F.when(F.exists(F.slice(data, z * plane + 1, plane), lambda v: v != 0), z).otherwise(0)))
    return F.slice(data, F.lit(1), (last + 1) * plane)


def frame_places(frames: DataFrame, by: Sequence[str], order: Sequence[str], position: str, *stack: str) -> DataFrame:
    """Adds ``stack_`` and ``slice_``: frames in runs of equal ``stack`` values along ``order``; within a run, slices by
    their projected position to a hundredth."""
    from voxloom.operators.relational import runs

    found = runs(frames, by, order, *stack).withColumnRenamed("run", "stack_")
    place = F.dense_rank().over(Window.partitionBy(*by, "stack_").orderBy(F.round(position, 2)))
    return found.withColumn("slice_", place)


def tolerant_groups(rows: DataFrame, by: Sequence[str], value: str, tie: str, tolerance: float) -> DataFrame:
    """Adds ``group_``, from 0 in each ``by``: rows are together while the step to the next value is within the tolerance."""
    w = Window.partitionBy(*by).orderBy(value, tie)
    step = F.col(value) - F.lag(value).over(w)
    return rows.withColumn("_far", (F.coalesce(step, F.lit(0.0)) > tolerance).cast("long")).withColumn("group_", F.sum("_far").over(w)).drop("_far")


def sidecar(fields: DataFrame, by: Sequence[str], key: str = "key", value: str = "value") -> DataFrame:
    """(by, key, constant, value): a field with one value in its group is a parameter of the whole, with that value; the
    others differ from slice to slice and have none."""
    got = fields.groupBy(*by, key).agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.count(F.when(F.col(value).isNull(), 1)).alias("_none"))
    same = F.col("_low").eqNullSafe(F.col("_high")) & ((F.col("_none") == 0) | F.col("_low").isNull())
    return got.select(*by, key, same.alias("constant"), F.when(same, F.col("_low")).alias("value"))


def sidecar_json(found: DataFrame, by: Sequence[str], key: str = "key") -> DataFrame:
    """(by, json): the constant fields of each group as one JSON object, and the names of the others under ``perSlice``."""
    grouped = found.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.when(F.col("constant"), F.struct(F.col(key), "value")))).alias("same"), F.sort_array(F.collect_list(F.when(~F.col("constant"), F.col(key)))).alias("perSlice")
    )
    return grouped.select(*by, F.to_json(F.struct(F.map_from_entries("same").alias("acqpar"), "perSlice")).alias("json"))


def encode(pixels: np.ndarray, tags: dict[int, tuple[bytes, bytes]]) -> bytes:
    """A small explicit little-endian file of 16-bit signed pixels (rows x cols), for tests and exports; ``tags`` adds text
    elements: tag to (representation, value)."""
    word = lambda v: (b"US", struct.pack("<H", v))
    own = {0x00280010: word(pixels.shape[0]), 0x00280011: word(pixels.shape[1]), 0x00280100: word(16), 0x00280101: word(16), 0x00280102: word(15), 0x00280103: word(1)}
    own |= tags | {0x7FE00010: (b"OW", pixels.astype("<i2").tobytes())}
    out = [b"\0" * 128 + b"DICM"]
    for tag, (kind, value) in sorted(own.items()):
        value += b"\0" * (len(value) % 2) if kind in (b"OW", b"UI") else b" " * (len(value) % 2)
        size = b"\0\0" + struct.pack("<I", len(value)) if kind in LONG_FORM else struct.pack("<H", len(value))
        out.append(struct.pack("<2H", tag >> 16, tag & 0xFFFF) + kind + size + value)
    return b"".join(out)
