"""Volumes as arrays (row-major x, y, z) and as voxel rows (id, x, y, z, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbalest.functions import vectors as V

AXES = ("x", "y", "z")


def voxels(volumes: DataFrame, shape: tuple[int, int, int], column: str = "vec") -> DataFrame:
    """One row for each voxel."""
    _, ny, nz = shape
    rows = volumes.select("id", F.posexplode(column).alias("_i", "value"))
    at = {"x": F.col("_i") / (ny * nz), "y": F.col("_i") / nz % ny, "z": F.col("_i") % nz}
    return rows.select("id", *[F.floor(c).cast("int").alias(n) for n, c in at.items()], "value")


def foreground_box(rows: DataFrame, shape: tuple[int, int, int], margin: int = 8, least: float = 1e-6) -> DataFrame:
    """Half-open box of the voxels off 0, widened by ``margin`` and cut to the shape; an empty volume keeps its whole extent."""
    off = F.abs("value") > least
    parts = []
    for axis, n in zip(AXES, shape):
        parts.append(F.coalesce(F.greatest(F.min(F.when(off, F.col(axis))) - margin, F.lit(0)), F.lit(0)).cast("int").alias(f"{axis}_lo"))
        parts.append(F.coalesce(F.least(F.max(F.when(off, F.col(axis))) + margin + 1, F.lit(n)), F.lit(n)).cast("int").alias(f"{axis}_hi"))
    return rows.groupBy("id").agg(*parts)


def crop(rows: DataFrame, boxes: DataFrame) -> DataFrame:
    inside = F.lit(True)
    for axis in AXES:
        inside &= (F.col(axis) >= F.col(f"{axis}_lo")) & (F.col(axis) < F.col(f"{axis}_hi"))
    return rows.join(boxes, "id").where(inside).select("id", *[(F.col(a) - F.col(f"{a}_lo")).alias(a) for a in AXES], "value")


def occupied_range(rows: DataFrame, axis: str, least: float = 0.0) -> DataFrame:
    """First and last index with a voxel over ``least``; the whole axis if there is none."""
    off = F.col("value") > least
    return rows.groupBy("id").agg(
        F.coalesce(F.min(F.when(off, F.col(axis))), F.min(axis)).alias("lo"), F.coalesce(F.max(F.when(off, F.col(axis))), F.max(axis)).alias("hi")
    )


def slice_position(lo: Column, hi: Column, share: float) -> Column:
    """lo + share * (hi - lo), rounded half to even and clipped to the range."""
    return F.least(F.greatest(F.rint(lo + F.lit(share) * (hi - lo)).cast("int"), lo), hi)


def triplane(rows: DataFrame, shares: tuple[float, ...] = (0.35, 0.5, 0.65), least: float = 0.0) -> DataFrame:
    """(id, axis, slice_no, position) of slices at shares of the occupied range of each axis."""
    out = None
    for axis in AXES:
        ranges = occupied_range(rows, axis, least).select("id", F.lit(axis).alias("axis"), F.posexplode(F.array(*[slice_position(F.col("lo"), F.col("hi"), s) for s in shares])).alias("slice_no", "position"))
        out = ranges if out is None else out.unionByName(ranges)
    return out


def slice_values(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The voxels of the wanted slices, as arrays in row-major order."""
    at = F.create_map(*[x for a in AXES for x in (F.lit(a), F.col(a))])
    each = rows.withColumn("axis", F.explode(F.array(*[F.lit(a) for a in AXES]))).withColumn("position", at[F.col("axis")])
    hits = each.join(wanted, ["id", "axis", "position"])
    return hits.groupBy("id", "axis", "slice_no", "position").agg(F.transform(F.sort_array(F.collect_list(F.struct("x", "y", "z", "value"))), lambda v: v["value"]).alias("vec"))


def median_slice(rows: DataFrame, axis: str, least: float = 0.0) -> DataFrame:
    """The middle one of the indices that have a voxel over ``least``."""
    used = F.sort_array(F.collect_set(F.when(F.col("value") > least, F.col(axis))))
    return rows.groupBy("id").agg(used.alias("_u")).where(F.size("_u") > 0).select("id", F.element_at("_u", F.floor(F.size("_u") / 2).cast("int") + 1).alias("position"))


def sweep(lo: Column, hi: Column, n: int) -> Column:
    """n evenly spaced positions, truncated."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(lo + i * (hi - lo) / max(1, n - 1)).cast("int"))


def percentile_window(v: str, lo: float = 0.01, hi: float = 0.99) -> Column:
    """Voxels over 0 scaled between two of their quantiles to 0..255 (rounded half to even) and clipped; no spread: 0."""
    ends = lambda u: F.struct(V.interpolated(u, lo).alias("lo"), V.interpolated(u, hi).alias("hi"))

    def place(x: Column, r: Column) -> Column:
        share = F.least(F.greatest((x - r["lo"]) / (r["hi"] - r["lo"]), F.lit(0.0)), F.lit(1.0))
        return F.coalesce(F.when(r["hi"] > r["lo"], F.rint(share * 255)), F.lit(0.0)).cast("int")

    positive = F.array_sort(F.filter(v, lambda x: x > 0))
    return V.let(positive, lambda u: V.let(ends(u), lambda r: F.transform(v, lambda x: place(x, r))))


def rank_window(v: str, lo: float = 0.02, hi: float = 0.98) -> Column:
    """The values at the two shares of the sorted array (index truncated)."""
    at = lambda u, q: F.get(u, F.floor(F.lit(q) * (F.size(u) - 1)).cast("int"))
    return V.let(F.array_sort(v), lambda u: F.struct(at(u, lo).alias("low"), at(u, hi).alias("high")))


def voxel_spacing(affine: str) -> Column:
    """Column norms of the 3x3 part of a row-major 4x4 affine."""
    e = lambda r, c: F.element_at(affine, r * 4 + c + 1)
    return F.array(*[F.sqrt(e(0, c) * e(0, c) + e(1, c) * e(1, c) + e(2, c) * e(2, c)) for c in range(3)])


def inside_ellipsoid(centre: tuple[float, float, float], radii: tuple[float, float, float]) -> Column:
    """Row predicate on voxel rows: the region that a resection empties."""
    return sum(((F.col(a) - c) * (F.col(a) - c) / (r * r) for a, c, r in zip(AXES, centre, radii)), F.lit(0.0)) <= 1.0


def axial_slice(v: str, shape: tuple[int, int, int], z: Column) -> Column:
    """The z-th axial slice of a row-major volume, z clamped to the shape."""
    nx, ny, nz = shape
    at = F.least(F.greatest(z, F.lit(0)), F.lit(nz - 1))
    return F.transform(F.sequence(F.lit(0), F.lit(nx * ny - 1)), lambda i: F.element_at(F.col(v), (i * nz + at + 1).cast("int")))
