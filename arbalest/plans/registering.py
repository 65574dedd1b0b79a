"""Queries that register volumes. Without SQL; the tests hold the solver against planted affines."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from arbalest.operators import kernels, registration, scoring
from arbalest.operators.scoring import POOL
from arbalest.plans import cascades, views
from arbalest.plans.catalogue import query
from arbalest.sources import staging

EDGE = 12


def planted(name: str) -> registration.Affine:
    """An affine that follows from a volume's name: turns, scales and shifts of up to 10 degrees, 8 % and a voxel."""
    random = np.random.default_rng(int(name))
    turns = np.deg2rad(random.uniform(-10, 10, 3))
    matrix = np.eye(3)
    for axis, angle in enumerate(turns):
        i, j = (a for a in range(3) if a != axis)
        turn = np.eye(3)
        turn[[i, j], [i, j]], turn[i, j], turn[j, i] = np.cos(angle), -np.sin(angle), np.sin(angle)
        matrix = matrix @ turn
    return registration.Affine(matrix @ np.diag(random.uniform(0.92, 1.08, 3)), random.uniform(-1, 1, 3))


def smooth(volume: np.ndarray, name: str) -> np.ndarray:
    """A volume of some size inside an empty border."""
    inner = kernels.resample(np.abs(volume), (EDGE - 4,) * 3)
    return kernels.gaussian(np.pad(inner, 2), 0.8)


def moved(volume: np.ndarray, name: str) -> np.ndarray:
    """The same in another modality, moved by the planted affine."""
    affine = planted(name)
    back = np.linalg.inv(affine.matrix)
    return np.exp(-4 * registration.warp(smooth(volume, name), registration.Affine(back, -back @ affine.shift), (EDGE,) * 3))


@query()
def affine_registration(spark, d):
    """Every query volume against its own copy, moved and in another modality: mean distance of its places from where they belong, before and
    after, in voxels, and mean information."""
    rows = views.queries(spark, d).select(F.col("p").cast("string").alias("id"), F.array(*[F.lit(n) for n in views.SHAPE]).alias("shape"), F.col("qv").alias("data"), *POOL, "query_id")
    sides = [staging.stage(kernels.map_volumes(rows, k)) for k in (smooth, moved)]
    q, t = (x.select("id", F.col("shape").alias(f"{c}_shape"), F.col("data").alias(f"{c}v")) for c, x in zip("qt", sides))
    pairs = rows.select("id", *POOL, "query_id", F.col("id").alias("target_id")).join(q, "id").join(t, "id")
    got = registration.registered(pairs, (2, 1))
    grid = np.stack(np.meshgrid(*[np.arange(3, EDGE - 3)] * 3, indexing="ij"), axis=-1).reshape(-1, 3).astype(float)
    centre = np.full(3, (EDGE - 1) / 2)

    @F.pandas_udf("was double, now double")
    def errors(name, affine):
        import pandas as pd

        out = []
        for n, a in zip(name, affine):
            true = planted(n).places(grid, centre)
            now = registration.Affine(np.reshape(a[:9], (3, 3)), np.array(a[9:])).places(grid, centre)
            out.append([np.linalg.norm(x - true, axis=1).mean() for x in (grid, now)])
        return pd.DataFrame(out, columns=["was", "now"])

    got = got.withColumn("e", errors("target_id", "affine"))
    mean = lambda c, n: F.round(F.avg(c), 4).alias(n)
    return got.groupBy(*POOL).agg(F.count("*").alias("n"), mean("e.was", "error_before"), mean("e.now", "error_after"), mean("before", "information_before"), mean("after", "information_after"))


@query()
def affine_cascade(spark, d):
    """The shortlist cascade with affine registration of its best 5."""
    got = cascades.dataset2_ranking(views.queries(spark, d), views.linked(spark, d), views.SHAPE, k=5, aligner=registration.affine_alignment)
    return got.select(*scoring.PAIR, F.col("rank").cast("long").alias("rank"))
