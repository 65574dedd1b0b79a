"""The Spark data source ``nifti``: headers read by range, volumes written with job commit.

Reading opens each file as a ranged stream and takes the bytes before the voxels, of a packed file as few blocks as hold them; so the
bytes read (column ``bytes_read``) follow the number of files, not of voxels. A partition is a run of ``FILES`` files. Writing puts a task's
files under ``_temporary`` in the target folder; the driver moves them when all tasks are done, or deletes them all. A task that is
run again writes to a place of its own, of which only the one that was reported is moved.

Files are reached through Arrow's file systems: local and mounted folders, hdfs, s3, gs, abfs. Others raise an error; for them
``nifti.read_headers(..., ranged=False)`` goes through Spark's own reader, which reads whole files.
"""

from __future__ import annotations

import gzip
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from arbalest.sources import nifti

FILES = 256
#: Bytes of a packed file that are fetched at a time.
PROBE = 1024
TEMPORARY = "_temporary"


def opened(path: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, path in it, what stands before such paths in full names)."""
    full = re.sub(r"^file:/+", "file:///", path if re.match(r"\w+:/", path) else f"file://{path}").rstrip("/")
    system, at = fs.FileSystem.from_uri(full)
    return system, at, full.removesuffix(at)


def fetch_head(stream) -> tuple[bytes, int]:
    """(what stands before the voxels, bytes fetched for it)."""
    data = stream.read(nifti.HEADER + 4)
    if data[:2] != b"\x1f\x8b":
        more = nifti.voxel_start(data) - len(data)
        return (data + stream.read(more), len(data) + more) if more > 0 else (data, len(data))
    unpack, head, fetched, wanted = zlib.decompressobj(31), b"", len(data), nifti.HEADER + 4
    while True:
        head += unpack.decompress(data, wanted - len(head))
        if len(head) >= nifti.HEADER + 4:
            wanted = max(wanted, nifti.voxel_start(head))
        if len(head) >= wanted or unpack.eof:
            return head, fetched
        data = unpack.unconsumed_tail
        if not data:
            data = stream.read(PROBE)
            fetched += len(data)
            if not data:
                return head, fetched


@dataclass
class Files(InputPartition):
    paths: list[str]


class HeaderReader(DataSourceReader):
    def __init__(self, path: str, files: int):
        self.path, self.files = path, files

    def partitions(self) -> list[InputPartition]:
        system, at, _ = opened(self.path)
        if system.get_file_info(at).type == fs.FileType.File:
            return [Files([at])]
        found = system.get_file_info(fs.FileSelector(at, recursive=True))
        names = sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith((".nii", ".nii.gz")) and f"/{TEMPORARY}/" not in f.path[len(at) :])
        return [Files(names[i : i + self.files]) for i in range(0, len(names), self.files)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _, before = opened(self.path)
        for path in partition.paths:
            with system.open_input_file(path) as stream:
                head, fetched = fetch_head(stream)
            yield (f"{before}{path}", *(v for k, v in nifti.header(head).items() if k[0] != "_"), fetched)


@dataclass
class Written(WriterCommitMessage):
    folder: str


class VolumeWriter(DataSourceArrowWriter):
    def __init__(self, path: str, packed: bool, overwrite: bool):
        self.path, self.packed, self.overwrite, self.job = path, packed, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, at, _ = opened(self.path)
        folder = f"{at}/{TEMPORARY}/{self.job}/{uuid.uuid4().hex}"
        system.create_dir(folder, recursive=True)
        try:
            for batch in iterator:
                for name, shape, data, affine in zip(*(batch.column(c) for c in ("name", "shape", "data", "affine"))):
                    name = name.as_py()
                    if "/" in name or name.startswith((".", "_")):
                        raise ValueError(f"{name!r} is no file name")
                    content = nifti.encode(data.values.to_numpy(zero_copy_only=False).astype(np.float32).reshape(shape.as_py()), np.reshape(affine.as_py(), (4, 4)))
                    with system.open_output_stream(f"{folder}/{name}.nii{'.gz' * self.packed}", compression=None) as out:
                        out.write(gzip.compress(content, mtime=0) if self.packed else content)
        except BaseException:
            system.delete_dir(folder)
            raise
        return Written(folder)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, at, _ = opened(self.path)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(at)):
                if f.type == fs.FileType.File and f.path.endswith((".nii", ".nii.gz")):
                    system.delete_file(f.path)
        for message in messages:
            for f in system.get_file_info(fs.FileSelector(message.folder)) if message else ():
                target = f"{at}/{f.base_name}"
                if system.get_file_info(target).type != fs.FileType.NotFound:
                    system.delete_file(target)
                system.move(f.path, target)
        self._clear(system, at)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, at, _ = opened(self.path)
        self._clear(system, at)

    def _clear(self, system: fs.FileSystem, at: str) -> None:
        for folder in (f"{at}/{TEMPORARY}/{self.job}", f"{at}/{TEMPORARY}"):
            if system.get_file_info(folder).type == fs.FileType.Directory and (folder.endswith(self.job) or not system.get_file_info(fs.FileSelector(folder))):
                system.delete_dir(folder)


class Nifti(DataSource):
    """``spark.read.format("nifti").load(folder)`` and ``rows.write.format("nifti").mode("append").save(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "nifti"

    def schema(self) -> str:
        return f"{nifti.HEADER_SCHEMA}, bytes_read long"

    def reader(self, schema: StructType) -> DataSourceReader:
        return HeaderReader(self.options["path"], int(self.options.get("files", FILES)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return VolumeWriter(self.options["path"], self.options.get("packed", "true") == "true", overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Nifti)
