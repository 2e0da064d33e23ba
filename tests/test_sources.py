"""Image files of every data type, both byte orders, and motion text files."""

import gzip
import os
import struct

import numpy as np
import pytest

from voxloom.sources import motion, nifti

SHAPE = (3, 4, 2)
AFFINE = np.array([[-2.0, 0, 0, 10], [0, 2, 0, -20], [0, 0, 3, 5], [0, 0, 0, 1]])


@pytest.mark.parametrize("datatype", sorted(set(nifti.KINDS) - {32}))
@pytest.mark.parametrize("slope,inter", [(1.0, 0.0), (0.5, 3.0)])
def test_round_trip(datatype, slope, inter):
    v = np.arange(48, dtype=float) * slope + inter
    h, got, short = nifti.decode(nifti.encode(v, SHAPE, AFFINE, (2, 2, 3), datatype, slope, inter))
    assert h["shape"] == SHAPE and got.shape == (2, 24) and not short
    assert got.ravel() == pytest.approx(v) and nifti.affine_of(h) == pytest.approx(AFFINE)


def test_whole_numbers_round_and_saturate():
    raw = nifti.encode(np.array([2.5, -2.5, 1e9, np.nan]), (4, 1, 1), np.eye(4), datatype=4)
    assert nifti.decode(raw)[1].tolist() == [[3, -3, 32767, 0]]


def test_big_endian_short_and_compressed_files(spark, tmp_path):
    raw = bytearray(nifti.encode(np.arange(24.0), SHAPE, AFFINE, (2, 2, 3), 16, descrip="scan"))
    big = bytearray(raw)
    for fmt, at in (("i", 0), ("8h", 40), ("2h", 70), ("8f", 76), ("3f", 108), ("2f", 124), ("2h", 252), ("3f", 256), ("3f", 268), ("12f", 280)):
        struct.pack_into(">" + fmt, big, at, *struct.unpack_from("<" + fmt, raw, at))
    big[352:] = np.frombuffer(bytes(raw[352:]), "<f4").astype(">f4").tobytes()
    (tmp_path / "big.nii").write_bytes(big)
    (tmp_path / "short.nii").write_bytes(raw[:-8])
    (tmp_path / "packed.nii.gz").write_bytes(gzip.compress(bytes(raw)))
    got = {os.path.basename(r.image_id): r for r in nifti.read(spark, f"file://{tmp_path}").collect()}
    assert got["big.nii"].data == got["packed.nii.gz"].data == list(map(float, range(24)))
    assert got["short.nii"].short and got["short.nii"].data[-3:] == [21.0, 0.0, 0.0] and got["big.nii"].descrip == "scan"
    with pytest.raises(ValueError):
        nifti.header(b"\0" * 352)


def test_blocks_to_files_and_back(spark, tmp_path):
    (tmp_path / "a.nii").write_bytes(nifti.encode(np.arange(72.0), SHAPE, AFFINE, (2, 2, 3)))
    blocks = nifti.read(spark, f"file://{tmp_path}")
    assert blocks.count() == 3
    content = nifti.images(blocks).first().content
    assert nifti.decode(content)[1].ravel().tolist() == list(range(72))


def test_motion_files(spark, tmp_path):
    rows = [("s1", k, *(0.1 * k + j for j in range(6))) for k in range(5)]
    moved = spark.createDataFrame(rows, "subject string, t int, tx double, ty double, tz double, rx double, ry double, rz double")
    text = "\n".join("\t".join(f"{x:.8f}" for x in r[2:]) for r in rows)
    (tmp_path / "rp_s1.txt").write_text(text + "\n")
    got = motion.read(spark, f"file://{tmp_path}/rp_s1.txt").orderBy("t").collect()
    assert [(r.subject, r.t) for r in got] == [r[:2] for r in rows]
    assert [tuple(r)[2:] for r in got] == [pytest.approx(r[2:]) for r in rows]
    motion.write(moved, f"file://{tmp_path}/out")
    assert motion.aligned(moved, moved.select("t")).count() == 5
    with pytest.raises(ValueError):
        motion.aligned(moved, moved.select("t").limit(3))


def test_written_files_pairs_and_analyze_headers(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(f"s{k}", t, 3, 2, 2, [1.0, 2.0, 3.0], np.eye(4).ravel().tolist(), 16, "d", False, rng.normal(size=12).tolist()) for k in range(2) for t in range(3)]
    df = spark.createDataFrame(rows, nifti.SCHEMA)
    told = {r.image_id: r for r in nifti.write(df, f"file://{tmp_path}/out").collect()}
    assert set(told) == {"s0", "s1"} and all(r.bytes == 352 + 4 * 36 for r in told.values())
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["s0.nii", "s1.nii"]
    back = {(r.image_id.rpartition("/")[2], r.t): r.data for r in nifti.read(spark, f"file://{tmp_path}/out").collect()}
    assert all(np.allclose(back[f"{r[0]}.nii", r[1]], r[-1], atol=1e-6) for r in rows)

    values = np.arange(12.0)
    raw = bytearray(nifti.encode(values, (3, 2, 2), np.eye(4), (2.0, 2.0, 4.0))[:348])
    struct.pack_into("<f", raw, 108, 0.0)
    raw[252:263] = b"\0" + struct.pack("<5h", 2, 3, 1, 0, 0)
    raw[344:348] = b"\0\0\0\0"
    (tmp_path / "pair").mkdir()
    for name, origin in (("a", (2, 3, 1)), ("b", (0, 0, 0))):
        raw[253:259] = struct.pack("<3h", *origin)
        (tmp_path / f"pair/{name}.hdr").write_bytes(bytes(raw))
        (tmp_path / f"pair/{name}.img").write_bytes(values.astype("<f4").tobytes())
    (tmp_path / "pair/lonely.hdr").write_bytes(bytes(raw))
    got = {r.image_id.rpartition("/")[2]: r for r in nifti.read_pairs(spark, f"file://{tmp_path}/pair").collect()}
    assert set(got) == {"a.hdr", "b.hdr"} and all(r.data == values.tolist() and not r.short for r in got.values())
    placed = np.reshape(got["a.hdr"].affine, (4, 4))
    assert np.allclose(placed @ [2, 2, 0, 1], [0, 0, 0, 1]) and placed[0, 0] == -2  # voxel (2, 3, 1) from 1, x counted from its right end
    assert np.allclose(np.reshape(got["b.hdr"].affine, (4, 4)), np.diag([2.0, 2, 4, 1]))
