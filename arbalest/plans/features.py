"""Queries on volumes and on pooled vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbalest.functions import vectors as V
from arbalest.operators import kernels, pooling, volumes
from arbalest.plans import views
from arbalest.plans.catalogue import query
from arbalest.plans.views import SHAPE, SQL
from arbalest.sources import slabs, staging

#: A voxel counts as occupied above this value, so that ranges differ among the volumes.
LEAST = 0.15


@query(SQL + """SELECT id, coalesce(greatest(min(x) FILTER (o) - 0, 0), 0)::INT AS x_lo, coalesce(least(max(x) FILTER (o) + 1, 4), 4)::INT AS x_hi,
  coalesce(min(y) FILTER (o), 0)::INT AS y_lo, coalesce(max(y) FILTER (o) + 1, 4)::INT AS y_hi, coalesce(min(z) FILTER (o), 0)::INT AS z_lo, coalesce(max(z) FILTER (o) + 1, 4)::INT AS z_hi
FROM (SELECT *, abs(value) > 0.2::DOUBLE AS o FROM vox) GROUP BY id""")  # fmt: skip
def foreground_bbox(spark, d):
    return volumes.foreground_box(volumes.voxels(views.volumes(spark, d), SHAPE), SHAPE, 0, 0.2)


@query(SQL + """, b AS (SELECT id, coalesce(min(x) FILTER (o), 0) AS xl, coalesce(max(x) FILTER (o) + 1, 4) AS xh, coalesce(min(y) FILTER (o), 0) AS yl, coalesce(max(y) FILTER (o) + 1, 4) AS yh,
  coalesce(min(z) FILTER (o), 0) AS zl, coalesce(max(z) FILTER (o) + 1, 4) AS zh FROM (SELECT *, abs(value) > 0.2::DOUBLE AS o FROM vox) GROUP BY id)
SELECT id, x - xl AS x, y - yl AS y, z - zl AS z, value FROM vox JOIN b USING (id) WHERE x >= xl AND x < xh AND y >= yl AND y < yh AND z >= zl AND z < zh""")  # fmt: skip
def foreground_crop(spark, d):
    rows = volumes.voxels(views.volumes(spark, d), SHAPE)
    return volumes.crop(rows, volumes.foreground_box(rows, SHAPE, 0, 0.2))


def _long(rows, *keys):
    return rows.select(*keys, F.posexplode("vec").alias("i", "value"))


@query(SQL + ", c AS (SELECT vec_id AS id, v, list_min(v) AS lo, list_max(v) AS hi FROM e) SELECT id, i::INT AS i, round(CASE WHEN hi > lo THEN (x - lo) / (hi - lo) ELSE 0 END, 6) AS value FROM (SELECT id, lo, hi, unnest(v) AS x, unnest(range(64)) AS i FROM c)")
def minmax_scale(spark, d):
    rows = views.volumes(spark, d).withColumn("vec", V.min_max("vec"))
    return _long(rows, "id").withColumn("value", F.round("value", 6))


@query(SQL + """, w AS (SELECT id, quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS b FROM vox WHERE value > 0 GROUP BY id)
SELECT id, count(*) FILTER (k = 0) AS n_dark, count(*) FILTER (k = 255) AS n_bright, sum(k)::BIGINT AS total
FROM (SELECT id, coalesce(CASE WHEN b > a THEN round_even(least(greatest((value - a) / (b - a), 0), 1) * 255, 0) END, 0)::INT AS k FROM vox LEFT JOIN w USING (id)) GROUP BY id""")  # fmt: skip
def percentile_window(spark, d):
    rows = views.volumes(spark, d).withColumn("vec", volumes.percentile_window("vec"))
    return _long(rows, "id").groupBy("id").agg(F.count_if(F.col("value") == 0).alias("n_dark"), F.count_if(F.col("value") == 255).alias("n_bright"), F.sum("value").alias("total"))


@query(SQL + "SELECT vec_id AS id, list_sort(v)[floor(0.02::DOUBLE * 63)::INT + 1] AS low, list_sort(v)[floor(0.98::DOUBLE * 63)::INT + 1] AS high FROM e")
def rank_window(spark, d):
    return views.volumes(spark, d).select("id", volumes.rank_window("vec").alias("w")).select("id", "w.*")


RANGE = "rg AS (SELECT id, axis, coalesce(min(pos) FILTER (value > 0.15::DOUBLE), min(pos)) AS lo, coalesce(max(pos) FILTER (value > 0.15::DOUBLE), max(pos)) AS hi FROM (SELECT id, value, unnest(['x', 'y', 'z']) AS axis, unnest([x, y, z]) AS pos FROM vox) GROUP BY ALL)"


@query(SQL + f", {RANGE} SELECT id, lo, hi FROM rg WHERE axis = 'z'")
def occupied_range(spark, d):
    return volumes.occupied_range(volumes.voxels(views.volumes(spark, d), SHAPE), "z", LEAST)


POSITION = "least(greatest(round_even(lo + s * (hi - lo), 0)::INT, lo), hi)"


@query(SQL + f", {RANGE} SELECT id, axis, k::INT AS slice_no, {POSITION} AS position FROM (SELECT *, unnest([0.35::DOUBLE, 0.5, 0.65]) AS s, unnest(range(3)) AS k FROM rg)")
def slice_positions(spark, d):
    return volumes.triplane(volumes.voxels(views.volumes(spark, d), SHAPE), (0.35, 0.5, 0.65), LEAST)


@query(SQL + f""", {RANGE}, ps AS (SELECT id, axis, k::INT AS slice_no, {POSITION} AS position FROM (SELECT *, unnest([0.35::DOUBLE, 0.5, 0.65]) AS s, unnest(range(3)) AS k FROM rg)),
lv AS (SELECT id, x, y, z, value, unnest(['x', 'y', 'z']) AS axis, unnest([x, y, z]) AS position FROM vox)
SELECT id, axis, slice_no, position, round(sum(value), 6) AS total, count(*) AS n FROM ps JOIN lv USING (id, axis, position) GROUP BY ALL""")  # fmt: skip
def triplane_slices(spark, d):
    rows = volumes.voxels(views.volumes(spark, d), SHAPE)
    got = volumes.slice_values(rows, volumes.triplane(rows, (0.35, 0.5, 0.65), LEAST))
    return got.select("id", "axis", "slice_no", "position", F.round(V.total(F.col("vec")), 6).alias("total"), F.size("vec").cast("long").alias("n"))


@query(SQL + ", u AS (SELECT id, list_sort(list_distinct(list(z))) AS u FROM vox WHERE value > 0.15::DOUBLE GROUP BY id) SELECT id, u[len(u) // 2 + 1] AS position FROM u")
def median_slice(spark, d):
    return volumes.median_slice(volumes.voxels(views.volumes(spark, d), SHAPE), "z", LEAST)


@query(SQL + f", {RANGE} SELECT id, i::INT AS i, floor(lo + i * (hi - lo) / 4.0::DOUBLE)::INT AS position FROM (SELECT *, unnest(range(5)) AS i FROM rg WHERE axis = 'z')")
def sweep_positions(spark, d):
    rows = volumes.occupied_range(volumes.voxels(views.volumes(spark, d), SHAPE), "z", LEAST)
    return rows.select("id", F.posexplode(volumes.sweep(F.col("lo"), F.col("hi"), 5)).alias("i", "position"))


@query(SQL + "SELECT vec_id AS id, round(sqrt(v[1]*v[1] + v[5]*v[5] + v[9]*v[9]), 6) AS sx, round(sqrt(v[2]*v[2] + v[6]*v[6] + v[10]*v[10]), 6) AS sy, round(sqrt(v[3]*v[3] + v[7]*v[7] + v[11]*v[11]), 6) AS sz FROM e")
def voxel_spacing(spark, d):
    rows = views.volumes(spark, d).select("id", volumes.voxel_spacing("vec").alias("s"))
    return rows.select("id", *[F.round(F.col("s")[i], 6).alias(n) for i, n in enumerate(("sx", "sy", "sz"))])


@query(SQL + "SELECT id, count(*) AS n_removed FROM vox WHERE (x - 1.5::DOUBLE) * (x - 1.5) / 4 + (y - 1.0::DOUBLE) * (y - 1.0) / 1 + (z - 2.0::DOUBLE) * (z - 2.0) / 2.25 <= 1 GROUP BY id")
def resection_region(spark, d):
    rows = volumes.voxels(views.volumes(spark, d), SHAPE)
    return rows.where(volumes.inside_ellipsoid((1.5, 1.0, 2.0), (2.0, 1.0, 1.5))).groupBy("id").agg(F.count("*").alias("n_removed"))


@query(SQL + "SELECT id, (x * 4 + y)::INT AS i, value FROM vox WHERE z = 3")
def axial_slice(spark, d):
    rows = views.volumes(spark, d).select("id", volumes.axial_slice("vec", SHAPE, F.lit(9)).alias("vec"))
    return _long(rows, "id")


@query(SQL + "SELECT id::VARCHAR AS id, 3 AS z, (x * 4 + y)::INT AS i, round(value::FLOAT::DOUBLE, 6) AS value FROM vox WHERE z = 3")
def stored_slices(spark, d):
    """Volumes stored as slabs of one slice; the last slice read again, by a place beyond it."""
    path = staging.fresh_path(spark, "slabs")
    slabs.write(views.volumes(spark, d).select("id", F.array(*[F.lit(n) for n in SHAPE]).alias("shape"), F.col("vec").alias("data")), path, 1)
    rows = slabs.axial_slice(spark, path, 9).select("id", "z", F.posexplode("data").alias("i", "value"))
    return rows.withColumn("value", F.round(F.col("value").cast("double"), 6))


@query(SQL + """, a AS (SELECT i, j, greatest(0, 1 - abs(j + 0.5::DOUBLE - (i + 0.5::DOUBLE) * 4 / 3) * 3 / 4) AS w FROM (SELECT unnest(range(3)) AS i), (SELECT unnest(range(4)) AS j)),
k AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM a)
SELECT id::VARCHAR AS id, (p.i * 3 + r.i)::INT AS i, round(sum(p.w * r.w * value), 6) AS value FROM vox JOIN k p ON p.j = x JOIN k r ON r.j = y WHERE z = 2 GROUP BY id, p.i, r.i""")  # fmt: skip
def smooth_resize(spark, d):
    """A slice of each volume, resized from 4 x 4 to 3 x 3 by the smoothing rule."""
    rows = views.volumes(spark, d).select(F.col("id").cast("string").alias("id"), F.array(F.lit(4), F.lit(4)).alias("shape"), volumes.axial_slice("vec", SHAPE, F.lit(2)).alias("data"))
    resized = kernels.map_volumes(rows, lambda v, _: kernels.smooth_resize(v, (3, 3)))
    return resized.select("id", F.posexplode("data").alias("i", "value")).withColumn("value", F.round("value", 6))


SLICES = "sl AS (SELECT vec_id AS id, label, k, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) AS w FROM (SELECT e.vec_id, embeddings.label, k, e.v[k * 16 + 1:k * 16 + 16] AS w FROM e JOIN embeddings USING (vec_id), (SELECT unnest(range(4)) AS k)))"


def _slices(spark, d):
    rows = views.slices(views.volumes(spark, d), "vec", "s")
    return rows.select("id", F.posexplode("s").alias("slice_no", "vec"))


@query(SQL + f", {SLICES}, m AS (SELECT id, i, avg(x) AS x FROM (SELECT id, unnest(w) AS x, unnest(range(16)) AS i FROM sl) GROUP BY ALL), n AS (SELECT id, sqrt(sum(x * x)) AS n FROM m GROUP BY id) SELECT id, i::INT AS i, round(x / n, 6) AS value FROM m JOIN n USING (id)")
def mean_pool(spark, d):
    return _long(pooling.mean_pool(_slices(spark, d), ["id"], "vec"), "id").withColumn("value", F.round("value", 6))


@query(SQL + f", {SLICES}, m AS (SELECT id, i, avg(x) AS a, max(x) AS b FROM (SELECT id, unnest(w) AS x, unnest(range(16)) AS i FROM sl) GROUP BY ALL) SELECT id, i::INT AS i, round(a, 6) AS value FROM m UNION ALL SELECT id, (i + 16)::INT, round(b, 6) FROM m")
def mean_max_concat(spark, d):
    return _long(pooling.mean_max(_slices(spark, d), ["id"], "vec"), "id").withColumn("value", F.round("value", 6))


@query(SQL + ", m AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(e.v) AS x, unnest(range(64)) AS i FROM e JOIN embeddings USING (vec_id)) GROUP BY ALL), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY label) SELECT label, i::INT AS i, round(x / n, 6) AS value FROM m JOIN n USING (label)")
def view_average(spark, d):
    """Vectors of one label as its views."""
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("label", V.doubles("embedding").alias("vec"))
    return _long(pooling.mean_pool(rows, ["label"], "vec"), "label").withColumn("value", F.round("value", 6))


WEIGHTS = [[((i * 7 + j * 3) % 11 - 5) / 10 for j in range(64)] for i in range(4)]


@query(SQL + ", o AS (SELECT vec_id AS id, unnest(range(4)) AS i, unnest([" + ", ".join(f"list_dot_product(v, {[float(x) for x in row]}::DOUBLE[]) + {i / 10}::DOUBLE" for i, row in enumerate(WEIGHTS)) + "]) AS x FROM e) SELECT id, i::INT AS i, round(0.5::DOUBLE * x * (1 + tanh(0.7978845608028654::DOUBLE * (x + 0.044715::DOUBLE * x * x * x))), 6) AS value FROM o")
def projection_head(spark, d):
    rows = views.volumes(spark, d).select("id", pooling.gelu(pooling.project(F.col("vec"), WEIGHTS, [i / 10 for i in range(4)])).alias("vec"))
    return _long(rows, "id").withColumn("value", F.round("value", 6))
