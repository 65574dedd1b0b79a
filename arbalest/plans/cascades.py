"""Cascades of rankers: cheap scores over the whole pool, expensive ones over a shortlist."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbalest.operators import block_scorers, blocks, fusion, ranking, rerank, scoring
from arbalest.operators.kernels import descriptors
from arbalest.operators.ranking import QUERY
from arbalest.operators.rerank import TARGET
from arbalest.operators.scoring import PAIR
from arbalest.sources.staging import stage

#: An aligner moves the second volume towards the first.
Aligner = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: Voxels of the pairs that are described at a time.
VOXELS = 1 << 16


def descriptor_scores(queries: DataFrame, gallery: DataFrame, k: int, tau: float, rounds: int) -> DataFrame:
    """Sinkhorn of CSLS of cosine."""
    scores = rerank.csls(scoring.dot_scores(queries, gallery), k)
    return rerank.sinkhorn(scores, tau, rounds)


def no_alignment(fixed: np.ndarray, moving: np.ndarray) -> np.ndarray:
    return moving


@lru_cache(8)
def _shifted_places(shape: tuple[int, ...], reach: int) -> np.ndarray:
    """Voxel numbers under each shift, the shortest shifts first."""
    steps = range(-reach, reach + 1)
    shifts = sorted(((i, j, k) for i in steps for j in steps for k in steps), key=lambda s: (sum(map(abs, s)), s))
    places = np.arange(np.prod(shape)).reshape(shape)
    return np.stack([np.roll(places, s, (0, 1, 2)).ravel() for s in shifts])


def shift_alignment(fixed: np.ndarray, moving: np.ndarray, reach: int = 1) -> np.ndarray:
    """The integer shift within ``reach`` with the largest correlation. A stand-in, not affine registration."""
    moved = moving.ravel()[_shifted_places(moving.shape, reach)]
    return moved[np.round((moved * fixed.ravel()).sum(axis=1), 9).argmax()].reshape(moving.shape)


def histogram_nmi(a: np.ndarray, b: np.ndarray, bins: int, least: int) -> float:
    mask = (np.abs(a) > 1e-6) & (np.abs(b) > 1e-6)
    if mask.sum() < least:
        return 0.0
    joint = np.bincount(_bins(a[mask], bins) * bins + _bins(b[mask], bins), minlength=bins * bins).reshape(bins, bins) / mask.sum()
    h = lambda p: -(p[p > 0] * np.log(p[p > 0])).sum()
    return float((h(joint.sum(axis=1)) + h(joint.sum(axis=0))) / max(h(joint.ravel()), 1e-6))


def _bins(x: np.ndarray, bins: int) -> np.ndarray:
    """Places in the bins of ``np.histogram``, the last one closed."""
    edges = np.histogram_bin_edges(x, bins)
    return np.minimum(np.searchsorted(edges, x, side="right") - 1, bins - 1)


def aligned_scores(pairs: DataFrame, shape: tuple[int, int, int], aligner: Aligner, bins: int, least: int) -> DataFrame:
    """Descriptor dot product (score_d) and NMI (score_n) of each pair (qv, tv) after alignment; as many pairs at a time as have ``VOXELS``.
    Where pairs of one query stand together, it is described once for these."""
    step = max(1, VOXELS // int(np.prod(shape)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for at in range(0, len(whole), step):
                frame = whole.iloc[at : at + step]
                fixed, moving = (np.stack([np.asarray(v, np.float64).reshape(shape) for v in side]) for side in (frame.qv, frame.tv))
                moved = np.stack([aligner(a, b) for a, b in zip(fixed, moving)])
                once, place = {}, []
                for i, a in enumerate(fixed):
                    place.append(once.setdefault(a.tobytes(), (len(once), i))[0])
                own = descriptors(fixed[[i for _, i in once.values()]], least)[place]
                near = (own * descriptors(moved, least)).sum(axis=1)
                yield frame[PAIR].assign(score_d=near, score_n=[histogram_nmi(a, b, bins, least) for a, b in zip(fixed, moved)])

    return pairs.select(*PAIR, "qv", "tv").mapInPandas(run, "dataset string, split string, query_id string, target_id string, score_d double, score_n double")


def dataset2_ranking(
    queries: DataFrame, gallery: DataFrame, shape: tuple[int, int, int], k: int = 30, aligner: Aligner = shift_alignment, bins: int = 8, least: int = 32, rounds: int = 50
) -> DataFrame:
    """Prefilter, then descriptor and NMI ranks of the aligned shortlist fused by reciprocal ranks (weights 1, 2, 2), then
    the untouched tail. Pairs are rows in the result alone. (pair, rank)"""
    first = block_scorers.balanced(block_scorers.csls(blocks.dot(queries, gallery), 5), 0.1, rounds)
    short = stage(blocks.best(first, k).select(*PAIR, "rank"))  # tables: each shortlist is made, and each pair aligned, once
    pairs = short.join(gallery.select(*TARGET, "tv"), TARGET).join(queries.select(*QUERY, "qv"), QUERY)
    again = stage(aligned_scores(pairs, shape, aligner, bins, least))
    by = lambda c: ranking.rank(again.select(*PAIR, F.col(c).alias("score")))
    fused = fusion.reciprocal_rank_fusion([(short, 1.0), (by("score_d"), 2.0), (by("score_n"), 2.0)])
    place = F.struct((-F.round(F.col("score"), 9)).alias("score"), "rank")
    return blocks.shortlist_then_tail(first, fused.join(short, PAIR).select(*PAIR, place.alias("place")))
