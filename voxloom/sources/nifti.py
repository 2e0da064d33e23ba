"""NIfTI-1 volumes to block rows and back.

Files are read by Spark's binaryFile source, so any file system that Spark reads will do; one file is one unit of work.
Both byte orders, plain, paired and gzipped files; the sform matrix goes before the quaternion, the quaternion before
plain spacings. Headers of the older Analyze form have an originator in their place. A file that ends early is filled up
with zeros and marked ``short``.
"""

from __future__ import annotations

import gzip
import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions.scalar import quaternion_affine
from voxloom.operators.layout import lists, matrix
from voxloom.session import settled

# Data type codes of the format.
KINDS = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 32: "c8", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}
SCHEMA = "image_id string, t int, nx int, ny int, nz int, pixdim array<double>, affine array<double>, datatype int, descrip string, short boolean, data array<double>"


def affine_of(h: dict) -> np.ndarray:
    if h["magic"] not in (b"n+1\0", b"ni1\0"):
        return analyze_affine(h["pixdim"][1:4], h["originator"])
    if h["sform"] > 0:
        out = np.eye(4)
        out[:3] = h["srow"]
        return out
    if h["qform"] > 0:
        return quaternion_affine(*h["quatern"], h["offset"], h["pixdim"])
    return np.diag([*h["pixdim"][1:4], 1.0])


def analyze_affine(spacing, originator) -> np.ndarray:
    """The originator's voxel (from 1) at 0, x from right to left; plain spacings where it is all zeros."""
    dx, dy, dz = spacing
    ox, oy, oz = originator
    if not any(originator):
        return np.diag([dx, dy, dz, 1.0])
    return np.array([[-dx, 0, 0, dx * ox], [0, dy, 0, -dy * (oy - 1)], [0, 0, dz, -dz * (oz - 1)], [0, 0, 0, 1]])


def header(raw: bytes) -> dict:
    order = next((o for o in "<>" if struct.unpack(o + "i", raw[:4])[0] == 348), None)
    if order is None:
        raise ValueError("no NIfTI-1 header")
    at = lambda fmt, k: struct.unpack_from(order + fmt, raw, k)
    dim = at("8h", 40)
    return {
        "order": order, "dim": dim, "datatype": at("h", 70)[0], "pixdim": at("8f", 76), "offset_bytes": int(at("f", 108)[0]), "slope": at("f", 112)[0], "inter": at("f", 116)[0],
        "descrip": raw[148:228].split(b"\0")[0].decode("latin-1"), "qform": at("h", 252)[0], "sform": at("h", 254)[0], "quatern": at("3f", 256), "offset": at("3f", 268),
        "srow": np.array(at("12f", 280)).reshape(3, 4), "magic": raw[344:348], "originator": at("3h", 253),
    }


def _plain(raw: bytes) -> bytes:
    return gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw


def decode(raw: bytes, image: bytes | None = None) -> tuple[dict, np.ndarray, bool]:
    """Header, values (t x voxels, x fastest) and whether the file was short. ``image``: the values' own file, if any."""
    raw = _plain(raw)
    h = header(raw)
    n = max(1, min(7, h["dim"][0]))
    dims = [max(1, d) for d in h["dim"][1 : n + 1]] + [1] * 4
    nx, ny, nz, nt = dims[0], dims[1], dims[2], int(np.prod(dims[3:]))
    kind = np.dtype(h["order"] + KINDS.get(h["datatype"], "f4"))
    start = max(352, h["offset_bytes"]) if image is None else max(0, h["offset_bytes"])
    raw = raw if image is None else _plain(image)
    body = raw[start : start + nx * ny * nz * nt * kind.itemsize]
    short = len(body) < nx * ny * nz * nt * kind.itemsize
    body += b"\0" * (nx * ny * nz * nt * kind.itemsize - len(body))
    v = np.frombuffer(body, kind)
    v = (v.real if kind.kind == "c" else v).astype(float)
    if h["slope"] and np.isfinite(h["slope"]):
        v = v * h["slope"] + (h["inter"] if np.isfinite(h["inter"]) else 0.0)
    return h | {"shape": (nx, ny, nz)}, v.reshape(nt, -1), short


def encode(values: np.ndarray, shape, affine: np.ndarray, pixdim=(1.0, 1.0, 1.0), datatype: int = 16, slope: float = 1.0, inter: float = 0.0, descrip: str = "", tr: float = 1.0) -> bytes:
    """A single-file image. Null or NaN is written as NaN in float types and as 0 in whole-number types, which round half
    away from zero and saturate."""
    kind = np.dtype("<" + KINDS[datatype])
    v = np.asarray(values, float).reshape(-1)
    scaled = (v - inter) / slope
    if kind.kind in "iu":
        r = np.where(np.isnan(scaled), 0, np.sign(scaled) * np.floor(np.abs(scaled) + 0.5))
        scaled = np.clip(r, np.iinfo(kind).min, np.iinfo(kind).max)
    finite = v[np.isfinite(v)]
    h = bytearray(352)
    struct.pack_into("<i", h, 0, 348)
    struct.pack_into("<8h", h, 40, 4, *shape, max(1, v.size // int(np.prod(shape))), 1, 1, 1)
    struct.pack_into("<2h", h, 70, datatype, kind.itemsize * 8)
    struct.pack_into("<8f", h, 76, 1.0, *pixdim, tr, 0, 0, 0)
    struct.pack_into("<3f", h, 108, 352.0, slope, inter)
    struct.pack_into("<2f", h, 124, finite.max() if finite.size else 0.0, finite.min() if finite.size else 0.0)
    h[148 : 148 + len(descrip[:79])] = descrip[:79].encode("latin-1", "replace")
    struct.pack_into("<2h", h, 252, 0, 1)
    struct.pack_into("<12f", h, 280, *np.asarray(affine)[:3].ravel())
    h[344:348] = b"n+1\0"
    return bytes(h) + scaled.astype(kind).tobytes()


def decoded(files: DataFrame) -> DataFrame:
    """(path, content) and, for paired files, ``image`` as one block row per volume."""

    def run(batches):
        for b in batches:
            paired = b.column("image").to_pylist() if "image" in b.schema.names else [None] * b.num_rows
            for name, raw, image in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), paired, strict=True):
                h, v, short = decode(raw, image)
                n = len(v)
                same = lambda x, kind: pa.array([x] * n, kind)
                columns = [same(name, pa.string()), pa.array(range(n), pa.int32()), *(same(k, pa.int32()) for k in h["shape"])]
                columns += [same(list(map(float, h["pixdim"][1:4])), pa.list_(pa.float64())), same(affine_of(h).ravel().tolist(), pa.list_(pa.float64()))]
                columns += [same(h["datatype"], pa.int32()), same(h["descrip"], pa.string()), same(short, pa.bool_()), lists(v)]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in SCHEMA.split(", ")])

    return files.mapInArrow(run, SCHEMA)


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def read(spark: SparkSession, path: str, pattern: str = "*.nii*") -> DataFrame:
    """One block row per volume of every single-file image under ``path``."""
    return decoded(_files(spark, path, pattern))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """The same of images in two files, ``.hdr`` and ``.img`` (or these gzipped); a header without an image is left out."""
    stem = F.regexp_replace("path", r"\.(hdr|img)(\.gz)?$", "").alias("_stem")
    heads, bodies = _files(spark, path, "*.hdr*").select("path", "content", stem), _files(spark, path, "*.img*").select(F.col("content").alias("image"), stem)
    return decoded(heads.join(bodies, "_stem").drop("_stem"))


def write(blocks: DataFrame, path: str, datatype: int = 16) -> DataFrame:
    """Write one ``.nii`` file per image into the folder ``path``, from the tasks and under any file system that pyarrow
    knows; (image_id, path, bytes). Files appear under their names only when they are whole, so a task may run again."""
    from pyarrow import fs

    def run(batches):
        for b in batches:
            names, sizes = [], []
            for image_id, content in zip(b.column("image_id").to_pylist(), b.column("content").to_pylist(), strict=True):
                system, folder = fs.FileSystem.from_uri(path)
                system.create_dir(folder, recursive=True)
                name = f"{folder}/{image_id.rpartition('/')[2].removesuffix('.nii')}.nii"
                part = f"{name}.{uuid.uuid4().hex}.part"
                with system.open_output_stream(part) as out:
                    out.write(content)
                system.move(part, name)
                names.append(name)
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([b.column("image_id"), pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["image_id", "path", "bytes"])

    return settled(images(blocks, datatype).mapInArrow(run, "image_id string, path string, bytes long"))


def images(blocks: DataFrame, datatype: int = 16) -> DataFrame:
    """(image_id, content): the bytes of one file per image, its volumes in the order of t. One image is one group."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("t")
        first = {c: group.column(c)[0].as_py() for c in ("image_id", "nx", "ny", "nz", "pixdim", "affine", "descrip")}
        v = matrix(group.column("data"))  # null becomes NaN
        body = encode(v, (first["nx"], first["ny"], first["nz"]), np.reshape(first["affine"], (4, 4)), first["pixdim"], datatype, descrip=first["descrip"] or "")
        return pa.table({"image_id": [first["image_id"]], "content": pa.array([body], pa.binary())})

    wanted = blocks.select("image_id", "t", "nx", "ny", "nz", "pixdim", "affine", "descrip", "data")
    return wanted.groupBy("image_id").applyInArrow(run, "image_id string, content binary")
