"""Pair scores: every query against its own pool's gallery, as (dataset, split, query_id, target_id, score).

Features are prepared per entity before the join. A pool's gallery is dealt into blocks of about ``TARGETS``, so that a large pool is
spread over many tasks; the query side is copied to each block. Nothing runs before the plan does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbalest.functions import vectors as V

POOL = ["dataset", "split"]
PAIR = [*POOL, "query_id", "target_id"]
#: Targets of a block of a pool, and blocks of a pool at most.
TARGETS, BLOCKS = 64, 1 << 12


def pairs(queries: DataFrame, gallery: DataFrame, targets: int = TARGETS) -> DataFrame:
    """Every query with every target of its pool. The gallery alone is counted, within the plan: a pool's targets are dealt by hash into
    blocks, and queries are copied to the numbers of these. Of counts there is one row a pool."""
    parts = F.greatest(F.lit(1), F.least(F.ceil(F.count("*") / targets), F.lit(BLOCKS))).cast("int")
    counts = F.broadcast(gallery.select(*POOL, "target_id").groupBy(*POOL).agg(parts.alias("_n")))
    right = gallery.join(counts, POOL).withColumn("_b", F.pmod(F.xxhash64("target_id"), F.col("_n")).cast("int")).drop("_n")
    left = queries.join(counts, POOL).withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    return left.join(right, [*POOL, "_b"]).drop("_b")


def score_by(queries: DataFrame, gallery: DataFrame, score: Column) -> DataFrame:
    """``score`` is an expression over the columns of both sides."""
    return pairs(queries, gallery).select(*PAIR, score.alias("score"))


def dot_scores(queries: DataFrame, gallery: DataFrame, scale: float = 1.0) -> DataFrame:
    """Of unit vectors qv and tv."""
    return score_by(queries, gallery, V.dot("qv", "tv") * scale if scale != 1.0 else V.dot("qv", "tv"))


def cosine_scores(queries: DataFrame, gallery: DataFrame) -> DataFrame:
    return dot_scores(queries.withColumn("qv", V.floor_unit("qv")), gallery.withColumn("tv", V.floor_unit("tv")))


def ncc_scores(queries: DataFrame, gallery: DataFrame) -> DataFrame:
    """Mean product of z-scores."""
    q, t = queries.withColumn("qv", V.z_score("qv")), gallery.withColumn("tv", V.z_score("tv"))
    return score_by(q, t, V.dot("qv", "tv") / F.size("qv"))


def affine_scores(queries: DataFrame, gallery: DataFrame) -> DataFrame:
    """Minus the Frobenius distance of 4x4 affines (qa, ta). A high hit rate tells of a header leak, not of a good ranker."""
    return score_by(queries, gallery, -V.frobenius("qa", "ta"))


def geometry_scores(queries: DataFrame, gallery: DataFrame) -> DataFrame:
    """Minus the L1 distance of shapes (qs, ts) and of affines rounded to 4 digits."""
    four = lambda c: F.transform(c, lambda x: F.round(x, 4))
    q, t = queries.withColumn("qa", four("qa")), gallery.withColumn("ta", four("ta"))
    return score_by(q, t, -(V.l1(V.doubles("qs"), V.doubles("ts")) + V.l1("qa", "ta")))


def shape_equal(queries: DataFrame, gallery: DataFrame) -> DataFrame:
    return pairs(queries, gallery).select(*PAIR, (F.col("qs") == F.col("ts")).alias("same_shape"))


def digitize(volume: str, bins: int) -> Column:
    """Bin index of each voxel over 0, min-max scaled over these and rounded half to even; null elsewhere."""

    def scaled(x: Column, r: Column) -> Column:
        at = F.least(F.rint((x - r["lo"]) / (r["hi"] - r["lo"]) * (bins - 1)), F.lit(bins - 1.0))
        return F.when(x > 0, F.when(r["hi"] > r["lo"], at).otherwise(0.0).cast("int"))

    return V.let(V.bounds(F.filter(volume, lambda x: x > 0)), lambda r: F.transform(volume, lambda x: scaled(x, r)))


def joint_entropies(joint: Column, bins: int) -> Column:
    """H(A) + H(B) and H(A, B) of joint codes a * bins + b."""
    each = V.entropy(F.transform(joint, lambda c: F.floor(c / bins))) + V.entropy(F.transform(joint, lambda c: c % bins))
    return F.struct(each.alias("each"), V.entropy(joint).alias("both"))


def nmi(a: Column, b: Column, bins: int) -> Column:
    """(H(A) + H(B)) / H(A, B) where both digitised volumes have a bin; 1 under 2 common voxels, 2 if both are constant."""
    joint = F.filter(F.zip_with(a, b, lambda x, y: x * bins + y), lambda c: c.isNotNull())
    ratio = lambda h: F.when(h["both"] < 1e-12, 2.0).otherwise(h["each"] / h["both"])
    return V.let(joint, lambda j: F.when(F.size(j) < 2, 1.0).otherwise(V.let(joint_entropies(j, bins), ratio)))


def nmi_scores(queries: DataFrame, gallery: DataFrame, bins: int = 48) -> DataFrame:
    """Of volumes qv and tv; digitised once each. For volumes of many voxels use ``nmi_block_scores``, which gives the same."""
    q, t = queries.withColumn("qd", digitize("qv", bins)), gallery.withColumn("td", digitize("tv", bins))
    return score_by(q.select(*POOL, "query_id", "qd"), t.select(*POOL, "target_id", "td"), nmi(F.col("qd"), F.col("td"), bins))


def robust(volume: str, least: int = 64) -> Column:
    """Clipped to the 1 and 99 % quantiles of the voxels off 0, centred by median, scaled by IQR, clipped to 6; voxels at 0
    stay 0; with fewer than ``least`` voxels off 0 all are 0."""
    clip = lambda x, q: F.least(F.greatest(x, q["lo"]), q["hi"])
    ends = lambda v: F.struct(V.interpolated(v, 0.01).alias("lo"), V.interpolated(v, 0.99).alias("hi"))

    def middle(v: Column) -> Column:
        iqr = V.interpolated(v, 0.75) - V.interpolated(v, 0.25)
        return F.struct(V.interpolated(v, 0.5).alias("med"), F.greatest(iqr, F.lit(1e-6)).alias("iqr"))

    def scaled(x: Column, q: Column, m: Column) -> Column:
        return F.when(F.abs(x) > 1e-6, F.least(F.greatest((clip(x, q) - m["med"]) / m["iqr"], F.lit(-6.0)), F.lit(6.0))).otherwise(0.0)

    def whole(v: Column) -> Column:  # v: sorted voxels off 0; clipping keeps their order
        inner = lambda q: V.let(middle(F.transform(v, lambda x: clip(x, q))), lambda m: F.transform(volume, lambda x: scaled(x, q, m)))
        return F.when(F.size(v) < least, F.transform(volume, lambda x: F.lit(0.0))).otherwise(V.let(ends(v), inner))

    return V.let(F.array_sort(F.filter(volume, lambda x: F.abs(x) > 1e-6)), whole)


def robust_nmi(a: Column, b: Column, bins: int, least: int) -> Column:
    """NMI of robust volumes over the voxels off 0 in both, binned over the range of these; 0 under ``least`` of them."""
    off = lambda p: (F.abs(p["a"]) > 1e-6) & (F.abs(p["b"]) > 1e-6)
    both = F.filter(F.zip_with(a, b, lambda x, y: F.struct(x.alias("a"), y.alias("b"))), off)

    def binned(rows: Column, side: str) -> Column:
        def place(x: Column, r: Column) -> Column:
            flat = r["hi"] <= r["lo"]
            lo, wide = F.when(flat, r["lo"] - 0.5).otherwise(r["lo"]), F.when(flat, 1.0).otherwise(r["hi"] - r["lo"])
            return F.least(F.floor((x - lo) / wide * bins), F.lit(bins - 1))

        return V.let(F.transform(rows, lambda p: p[side]), lambda v: V.let(V.bounds(v), lambda r: F.transform(v, lambda x: place(x, r))))

    ratio = lambda h: h["each"] / F.greatest(h["both"], F.lit(1e-6))
    joint = lambda rows: F.zip_with(binned(rows, "a"), binned(rows, "b"), lambda x, y: x * bins + y)
    return V.let(both, lambda rows: F.when(F.size(rows) < least, 0.0).otherwise(V.let(joint(rows), lambda j: V.let(joint_entropies(j, bins), ratio))))


def robust_nmi_scores(queries: DataFrame, gallery: DataFrame, bins: int = 64, least: int = 64) -> DataFrame:
    q, t = queries.withColumn("qr", robust("qv", least)), gallery.withColumn("tr", robust("tv", least))
    return score_by(q.select(*POOL, "query_id", "qr"), t.select(*POOL, "target_id", "tr"), robust_nmi(F.col("qr"), F.col("tr"), bins, least))


def maxsim(q_slices: Column, t_slices: Column) -> Column:
    """Mean over query slices of the best dot product with any target slice."""
    best = F.transform(q_slices, lambda a: F.array_max(F.transform(t_slices, lambda b: V.dot(a, b))))
    return V.mean(best)


def neighbours(gallery: DataFrame, k: int) -> DataFrame:
    """Each target's ``k`` nearest targets of its pool by dot product, itself last (its score counts as -1)."""
    left = gallery.select(*POOL, F.col("target_id").alias("query_id"), F.col("tv").alias("qv"))
    from arbalest.operators.ranking import rank

    scores = dot_scores(left, gallery.select(*POOL, "target_id", "tv"))
    scores = scores.withColumn("score", F.when(F.col("query_id") == F.col("target_id"), -1.0).otherwise(F.col("score")))
    return rank(scores, k).select(*POOL, F.col("query_id").alias("target_id"), F.col("target_id").alias("neighbour"), "rank")


def _block_pairs(q: DataFrame, t: DataFrame) -> DataFrame:
    """Every query block with every target block of its pool. Query blocks are copied to the target blocks' numbers, so that a pool
    is as many tasks as it has target blocks."""
    last = t.groupBy(*POOL).agg(F.max("_b").alias("_last"))  # one row a pool
    q = q.drop("_b").join(last, POOL).withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_last").cast("bigint")))).drop("_last")
    return q.join(t, [*POOL, "_b"]).drop("_b")


def digits(volume: np.ndarray, bins: int) -> np.ndarray:
    """``digitize`` of one volume; -1 for null."""
    mask = volume > 0
    out = np.full(len(volume), -1, np.int16)
    if mask.any():
        inside = volume[mask]
        lo, hi = inside.min(), inside.max()
        out[mask] = np.minimum(np.rint((inside - lo) / (hi - lo) * (bins - 1)), bins - 1) if hi > lo else 0
    return out


def digits_nmi(a: np.ndarray, b: np.ndarray, bins: int) -> float:
    both = (a >= 0) & (b >= 0)
    if both.sum() < 2:
        return 1.0
    joint = np.bincount(a[both].astype(np.int64) * bins + b[both], minlength=bins * bins).reshape(bins, bins)
    h = [-(p * np.log(p)).sum() for p in (c[c > 0] / both.sum() for c in (joint.sum(axis=1), joint.sum(axis=0), joint.ravel()))]
    return 2.0 if h[2] < 1e-12 else float((h[0] + h[1]) / h[2])


def robust_histogram_nmi(a: np.ndarray, b: np.ndarray, bins: int, least: int) -> float:
    """``robust_nmi`` of one pair of robust volumes."""
    both = (np.abs(a) > 1e-6) & (np.abs(b) > 1e-6)
    n = int(both.sum())
    if n < least or not n:
        return 0.0

    def places(x: np.ndarray) -> np.ndarray:
        lo, hi = x.min(), x.max()
        lo, wide = (lo - 0.5, 1.0) if hi <= lo else (lo, hi - lo)
        return np.minimum(np.floor((x - lo) / wide * bins), bins - 1).astype(np.int64)

    joint = np.bincount(places(a[both]) * bins + places(b[both]), minlength=bins * bins).reshape(bins, bins)
    h = [-(p * np.log(p)).sum() for p in (c[c > 0] / n for c in (joint.sum(axis=1), joint.sum(axis=0), joint.ravel()))]
    return float((h[0] + h[1]) / max(h[2], 1e-6))


def _volume_block_scores(queries: DataFrame, gallery: DataFrame, prepare: Callable[[np.ndarray], np.ndarray], score: Callable[[np.ndarray, np.ndarray], float], kind: str, size: int) -> DataFrame:
    """Scores of whole volumes: each is prepared once, in Arrow batches; blocks of ``size`` volumes of both sides meet."""

    def coded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(vec=[prepare(np.asarray(v, np.float64)).astype(kind).tobytes() for v in frame.vec])

    def side(rows: DataFrame, name: str, vector: str) -> DataFrame:
        rows = rows.select(*POOL, F.col(name).alias("id"), F.col(vector).alias("vec")).mapInPandas(coded, "dataset string, split string, id string, vec binary")
        counts = rows.groupBy(*POOL).agg(F.ceil(F.count("*") / size).alias("_n"))  # one row a pool
        rows = rows.join(counts, POOL).withColumn("_b", F.pmod(F.xxhash64("id"), F.col("_n")))
        return rows.groupBy(*POOL, "_b").agg(F.collect_list(F.struct("id", "vec")).alias(f"{name}s"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                a, b = ([(e["id"], np.frombuffer(e["vec"], kind)) for e in block] for block in (row.query_ids, row.target_ids))
                out = [(x, y, score(u, v)) for x, u in a for y, v in b]
                yield pd.DataFrame(out, columns=["query_id", "target_id", "score"]).assign(dataset=row.dataset, split=row.split)[[*PAIR, "score"]]

    both = _block_pairs(side(queries, "query_id", "qv"), side(gallery, "target_id", "tv"))
    return both.mapInPandas(run, "dataset string, split string, query_id string, target_id string, score double")


def nmi_block_scores(queries: DataFrame, gallery: DataFrame, bins: int = 48, size: int = 16) -> DataFrame:
    """``nmi_scores`` for whole volumes; a pair costs one joint histogram by ``bincount``."""
    return _volume_block_scores(queries, gallery, lambda v: digits(v, bins), lambda a, b: digits_nmi(a, b, bins), "<i2", size)


def robust_nmi_block_scores(queries: DataFrame, gallery: DataFrame, bins: int = 64, least: int = 64, size: int = 16) -> DataFrame:
    """``robust_nmi_scores`` for whole volumes."""
    from arbalest.operators.kernels import robust as robust_volume

    return _volume_block_scores(queries, gallery, lambda v: robust_volume(v, least), lambda a, b: robust_histogram_nmi(a, b, bins, least), "<f8", size)


def block_dot_scores(queries: DataFrame, gallery: DataFrame, k: int, size: int | None = None) -> DataFrame:
    """``dot_scores`` cut to each query's ``k`` best, by matrix products of blocks; equal to it after rounding to 6 digits."""
    from arbalest.operators import blocks

    return blocks.best(blocks.dot(queries, gallery), k, size)
