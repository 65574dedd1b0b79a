"""Volumes stored as slabs along z, so that one axial slice is read without the rest.

A row is (id, nx, ny, nz, z0, z1, last, data): the slices z0 .. z1 - 1 of a volume, z slowest, so that a slice is one run of ``data``. Slabs
are range-sorted by their place and then id; a slice is a filter on z0, z1, last and nz, which Parquet's statistics turn into the files and
row groups of that place alone. Row groups are kept small (``GROUP`` slabs) for that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEPTH, GROUP = 8, 32
SHAPE = "id string, nx int, ny int, nz int, z0 int, z1 int, last boolean, data array<float>"
_SCHEMA = pa.schema([("id", pa.string()), *((c, pa.int32()) for c in ("nx", "ny", "nz", "z0", "z1")), ("last", pa.bool_()), ("data", pa.list_(pa.float32()))])


def slabs(volumes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The slabs of (id, shape, data) with row-major x, y, z data. Volumes without voxels have none."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                nx, ny, nz = batch["shape"][i].as_py()
                whole = batch["data"][i].values.to_numpy(zero_copy_only=False).reshape(nx, ny, nz).transpose(2, 0, 1)
                for lo in range(0, nz if nx * ny else 0, depth):
                    hi = min(lo + depth, nz)
                    values = [batch["id"][i].as_py(), nx, ny, nz, lo, hi, hi == nz, np.ascontiguousarray(whole[lo:hi]).ravel()]
                    yield pa.record_batch([pa.array([v], f.type) for v, f in zip(values, _SCHEMA)], schema=_SCHEMA)

    rows = volumes.select(F.col("id").cast("string").alias("id"), "shape", F.col("data").cast("array<float>").alias("data"))
    return rows.mapInArrow(cut, SHAPE)


def write(volumes: DataFrame, path: str, depth: int = DEPTH, group: int = GROUP) -> None:
    rows = slabs(volumes, depth).repartitionByRange("z0", "id").sortWithinPartitions("z0", "id")
    rows.write.option("parquet.block.row.count.limit", group).parquet(path)


def axial_slice(spark: SparkSession, path: str, z: int) -> DataFrame:
    """(id, nx, ny, z, data) of each volume's slice ``z``, clamped to its shape; data is row-major x, y."""
    z = max(z, 0)
    here = ((F.col("z0") <= z) & (F.col("z1") > z)) | (F.col("last") & (F.col("nz") <= z))
    at, size = F.least(F.lit(z), F.col("nz") - 1), F.col("nx") * F.col("ny")
    rows = spark.read.parquet(path).where(here)
    return rows.select("id", "nx", "ny", at.alias("z"), F.slice("data", (at - F.col("z0")) * size + 1, size).alias("data"))
