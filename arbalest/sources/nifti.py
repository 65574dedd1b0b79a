"""NIfTI-1 files over the binaryFile source: volumes, headers, listings.

Files are decoded in Arrow batches on the executors. Volumes come as (path, shape, data) with data in row-major x, y, z order.
"""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the public format: numpy kinds by data type code.
KINDS = {2: "u1", 256: "i1", 4: "i2", 512: "u2", 8: "i4", 16: "f4", 64: "f8", 768: "u4"}
HEADER = 348

HEADER_SCHEMA = (
    "path string, shape array<int>, affine array<double>, zooms array<double>, qform_code int, sform_code int, qoffset array<double>, srow array<double>, "
    "quatern array<double>, descrip string, aux_file string, db_name string, intent_name string, n_extensions int, ext_blob binary"
)


def unpacked(content: bytes) -> bytes:
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def head_of(content: bytes) -> bytes:
    """What stands before the voxels; of a packed file no more is unpacked."""
    if content[:2] != b"\x1f\x8b":
        return content[: max(HEADER + 4, voxel_start(content))]
    stream = zlib.decompressobj(31)
    head = stream.decompress(content, HEADER + 4)
    more = voxel_start(head) - len(head)
    return head + stream.decompress(stream.unconsumed_tail, more) if more > 0 else head


def voxel_start(head: bytes) -> int:
    order = "<" if struct.unpack_from("<i", head, 0)[0] == HEADER else ">"
    return int(struct.unpack_from(order + "f", head, 108)[0])


def _text(raw: bytes) -> str:
    return raw.split(b"\0", 1)[0].decode("latin-1").strip()


def header(content: bytes) -> dict:
    """The header's fields and, under private names, what decoding the voxels needs."""
    order = "<" if struct.unpack_from("<i", content, 0)[0] == HEADER else ">"
    get = lambda fmt, at: struct.unpack_from(order + fmt, content, at)
    dims = get("8h", 40)
    shape = [int(n) for n in dims[1 : 1 + max(1, min(7, dims[0]))]]
    zooms = [float(x) for x in get("8f", 76)]
    q, s = get("2h", 252)
    quatern, offset = get("3f", 256), get("3f", 268)
    rows = get("12f", 280)
    slope, inter = get("2f", 112)
    if s > 0:
        affine = np.vstack([np.reshape(rows, (3, 4)), [0, 0, 0, 1]])
    elif q > 0:
        affine = _from_quaternion(quatern, offset, zooms)
    else:
        affine = np.diag([*zooms[1:4], 1.0])
    start = int(get("f", 108)[0])
    extensions, blob, at = 0, b"", HEADER + 4
    if len(content) > HEADER and content[HEADER] and start > at:
        blob = content[at:start]
        while at + 8 <= start and (size := get("i", at)[0]) >= 8:
            extensions, at = extensions + 1, at + size
    return {
        "shape": shape, "affine": affine.ravel().tolist(), "zooms": zooms[1 : 1 + len(shape)], "qform_code": q, "sform_code": s, "qoffset": list(map(float, offset)),
        "srow": list(map(float, rows)), "quatern": list(map(float, quatern)), "descrip": _text(content[148:228]), "aux_file": _text(content[228:252]),
        "db_name": _text(content[14:32]), "intent_name": _text(content[328:344]), "n_extensions": extensions, "ext_blob": blob,
        "_order": order, "_code": get("h", 70)[0], "_start": max(start, HEADER), "_slope": slope, "_inter": inter,
    }


def _from_quaternion(quatern: tuple, offset: tuple, zooms: list[float]) -> np.ndarray:
    b, c, d = quatern
    a = np.sqrt(max(0.0, 1 - b * b - c * c - d * d))
    turn = np.array([
        [a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)],
        [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)],
        [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c],
    ])
    out = np.eye(4)
    out[:3, :3] = turn * np.array([zooms[1], zooms[2], zooms[3] * (-1 if zooms[0] < 0 else 1)])
    out[:3, 3] = offset
    return out


def volume(content: bytes) -> np.ndarray:
    """float32 voxels; of a 4-D file the first volume; NaN and infinities are 0."""
    content = unpacked(content)
    h = header(content)
    n = int(np.prod(h["shape"]))
    kind = np.dtype(KINDS.get(h["_code"], "i2")).newbyteorder(h["_order"])
    data = np.frombuffer(content, kind, n, h["_start"]).astype(np.float32).reshape(h["shape"], order="F")
    if h["_slope"] not in (0.0, 1.0) or (h["_slope"] and h["_inter"]):
        data = data * np.float32(h["_slope"]) + np.float32(h["_inter"])
    while data.ndim > 3:
        data = data[..., 0]
    return np.nan_to_num(data, nan=0.0, posinf=0.0, neginf=0.0)


def encode(data: np.ndarray, affine: np.ndarray) -> bytes:
    """A float32 NIfTI-1 file."""
    out = bytearray(HEADER + 4)
    struct.pack_into("<i", out, 0, HEADER)
    struct.pack_into("<8h", out, 40, data.ndim, *data.shape, *[1] * (7 - data.ndim))
    struct.pack_into("<2h", out, 70, 16, 32)
    struct.pack_into("<8f", out, 76, 1, *np.sqrt((np.asarray(affine)[:3, :3] ** 2).sum(axis=0)), *[1] * 4)
    struct.pack_into("<3f", out, 108, HEADER + 4, 1, 0)
    struct.pack_into("<2h", out, 252, 0, 1)
    struct.pack_into("<12f", out, 280, *np.asarray(affine)[:3].ravel())
    out[344:348] = b"n+1\0"
    return bytes(out) + np.asarray(data, "<f4").tobytes(order="F")


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, content) of .nii and .nii.gz files, recursively."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{nii,nii.gz}").option("recursiveFileLookup", "true").load(path)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Without reading contents."""
    return files(spark, path).select("path", "length", "modificationTime")


def read_volumes(spark: SparkSession, path: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = [volume(c) for c in frame.content]
            yield pd.DataFrame({"path": frame.path, "shape": [list(v.shape) for v in got], "data": [v.ravel() for v in got]})

    return files(spark, path).select("path", "content").mapInPandas(run, "path string, shape array<int>, data array<float>")


def read_headers(spark: SparkSession, path: str, ranged: bool = True) -> DataFrame:
    """Headers and extensions alone, with ``bytes_read`` of each file: ranged reads fetch what stands before the voxels. Without
    ``ranged`` Spark's own reader fetches whole files, from any file system; voxels are not unpacked either way."""
    if ranged:
        from arbalest.sources import volume_source

        volume_source.register(spark)
        return spark.read.format("nifti").load(path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = [header(head_of(c)) for c in frame.content]
            yield pd.DataFrame([{"path": p} | {k: v for k, v in h.items() if k[0] != "_"} | {"bytes_read": len(c)} for p, c, h in zip(frame.path, frame.content, got)])

    return files(spark, path).select("path", "content").mapInPandas(run, f"{HEADER_SCHEMA}, bytes_read long")


def write_volumes(rows: DataFrame, folder: str, packed: bool = True, mode: str = "append") -> None:
    """A <name>.nii.gz (or .nii) file of each row (name, shape, data, affine); of rows of one name the last written stays. Files show
    in the folder when all tasks are done, or not at all; ``overwrite`` replaces the folder's volumes then."""
    from arbalest.sources import volume_source

    volume_source.register(rows.sparkSession)
    rows = rows.select("name", "shape", F.col("data").cast("array<float>").alias("data"), F.col("affine").cast("array<double>").alias("affine"))
    rows.write.format("nifti").option("packed", str(packed).lower()).mode(mode).save(folder)
