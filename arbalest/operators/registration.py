"""Affine registration of volume pairs by mutual information, a pair at a time in Arrow batches.

An affine maps places of the fixed volume to places of the moving one: y = c + matrix (x - c) + shift, with c the fixed volume's centre, in voxels.
From coarse to fine, the moving volume is read at the mapped places by trilinear interpolation; a joint histogram (fixed values in hard bins,
moving ones shared between two) gives the mutual information and, with the interpolation's own derivative, its slope in all 12 parameters at
once. Steps go along the slope, with a length that is halved when it turns round. So intensities may differ in any way, as between
modalities, as long as one tells of the other. Pairs spread over tasks; a task holds two volumes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from arbalest.operators.kernels import gaussian, resample
from arbalest.operators.scoring import PAIR, digits, digits_nmi

BINS, POINTS, STEPS, SEED = 32, 20_000, 80, 2026
LEVELS = (4, 2, 1)
#: First step of a level and shortest one, in voxels of the level.
LONGEST, SHORTEST = 1.0, 0.01
#: Share of the places that must fall inside the moving volume.
OVERLAP = 0.25
#: A level is not coarser than this many voxels on its shortest side.
EDGE = 6


@dataclass(frozen=True)
class Affine:
    matrix: np.ndarray
    shift: np.ndarray

    def places(self, x: np.ndarray, centre: np.ndarray) -> np.ndarray:
        return centre + (x - centre) @ self.matrix.T + self.shift

    def values(self) -> list[float]:
        """Twelve numbers, the matrix by rows and then the shift."""
        return [*map(float, self.matrix.ravel()), *map(float, self.shift)]


def interpolate(volume: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, slopes along each axis, inside) of trilinear interpolation at places (n, 3); outside both are 0."""
    top = np.array(volume.shape) - 1
    inside = ((at >= 0) & (at <= top)).all(axis=1)
    lo = np.clip(np.floor(at), 0, np.maximum(top - 1, 0)).astype(np.int64)
    share = np.clip(at - lo, 0, 1)
    hi = np.minimum(lo + 1, top)
    value, slope = np.zeros(len(at)), np.zeros(at.shape)
    for corner in np.ndindex(2, 2, 2):
        place = [np.where(c, hi[:, a], lo[:, a]) for a, c in enumerate(corner)]
        v = volume[place[0], place[1], place[2]]
        w = [share[:, a] if c else 1 - share[:, a] for a, c in enumerate(corner)]
        value += v * w[0] * w[1] * w[2]
        for a, c in enumerate(corner):
            slope[:, a] += (1 if c else -1) * v * w[(a + 1) % 3] * w[(a + 2) % 3]
    return value * inside, slope * inside[:, None], inside


def warp(volume: np.ndarray, affine: Affine, shape: tuple[int, ...]) -> np.ndarray:
    """The moving volume on the fixed one's grid."""
    grid = np.stack(np.meshgrid(*map(np.arange, shape), indexing="ij"), axis=-1).reshape(-1, 3).astype(np.float64)
    return interpolate(volume, affine.places(grid, (np.array(shape) - 1) / 2))[0].reshape(shape)


def information(fixed: np.ndarray, moving: np.ndarray, span: tuple[float, float], bins: int = BINS) -> tuple[float, np.ndarray]:
    """Mutual information of binned fixed values with moving values, and its slope in each moving value."""
    lo, hi = span
    place = np.clip((moving - lo) / max(hi - lo, 1e-12) * (bins - 1), 0, bins - 1)
    low = np.minimum(place.astype(np.int64), bins - 2)
    share, code = place - low, fixed * bins + low
    joint = (np.bincount(code, 1 - share, bins * bins) + np.bincount(code + 1, share, bins * bins)).reshape(bins, bins) / max(len(moving), 1)
    log = np.log(np.maximum(joint, 1e-12)) - np.log(np.maximum(joint.sum(axis=1), 1e-12))[:, None] - np.log(np.maximum(joint.sum(axis=0), 1e-12))[None, :]
    flat = log.ravel()
    return float((joint * log)[joint > 0].sum()), (flat[code + 1] - flat[code]) * (bins - 1) / max(hi - lo, 1e-12) / max(len(moving), 1)


def _binned(values: np.ndarray, bins: int) -> np.ndarray:
    lo, hi = values.min(), values.max()
    return np.minimum(((values - lo) / max(hi - lo, 1e-12) * bins).astype(np.int64), bins - 1)


def _mass_centre(volume: np.ndarray) -> np.ndarray:
    mass = np.abs(volume - np.median(volume))
    total = mass.sum()
    if not total:
        return (np.array(volume.shape) - 1) / 2
    return np.array([(np.arange(n) * mass.sum(axis=tuple(b for b in range(3) if b != a))).sum() / total for a, n in enumerate(volume.shape)])


def register(fixed: np.ndarray, moving: np.ndarray, levels: tuple[int, ...] = LEVELS, steps: int = STEPS, bins: int = BINS) -> tuple[Affine, float, float]:
    """(affine, information where it starts, where it ends) of the finest level. Constant volumes stay where the centres of mass put them."""
    centre = (np.array(fixed.shape) - 1) / 2
    affine = Affine(np.eye(3), _mass_centre(moving) - _mass_centre(fixed))
    start = Affine(np.eye(3), np.zeros(3))
    random = np.random.default_rng(SEED)
    before = after = 0.0
    for factor in levels:
        shapes = [tuple(max(min(n, EDGE), round(n / factor)) for n in v.shape) for v in (fixed, moving)]
        f, m = (resample(gaussian(v, factor / 2) if factor > 1 else v, s, corners=False) for v, s in zip((fixed, moving), shapes))
        f_scale, m_scale = (np.array(v.shape) / s for v, s in zip((fixed, moving), shapes))
        grid = np.stack(np.meshgrid(*map(np.arange, f.shape), indexing="ij"), axis=-1).reshape(-1, 3)
        some = random.permutation(len(grid))[:POINTS]
        x, codes = (grid[some] + 0.5) * f_scale - 0.5, _binned(f.ravel(), bins)[some]
        radius = max(float(np.sqrt(((x - centre) ** 2).sum(axis=1).mean())), 1.0)
        span, unit = (float(m.min()), float(m.max())), float(max(f_scale.max(), m_scale.max()))

        def measure(a: Affine) -> tuple[float, np.ndarray]:
            value, slope, inside = interpolate(m, (a.places(x, centre) + 0.5) / m_scale - 0.5)
            if inside.sum() < max(OVERLAP * len(x), 2):
                return -np.inf, np.zeros(12)
            info, each = information(codes[inside], value[inside], span, bins)
            push = each[:, None] * slope[inside] / m_scale
            return info, np.concatenate([(push.T @ (x[inside] - centre)).ravel() / radius, push.sum(axis=0)])

        length, last = LONGEST * unit, None
        here, slope = measure(affine)
        before = measure(start)[0]
        for _ in range(steps):
            norm = float(np.sqrt((slope**2).sum()))
            if length < SHORTEST * unit or norm < 1e-12:
                break
            move = length * slope / norm
            there = Affine(affine.matrix + move[:9].reshape(3, 3) / radius, affine.shift + move[9:])
            info, new = measure(there)
            if info <= here or (last is not None and slope @ last < 0):
                length /= 2
            if info > here:
                affine, here, last, slope = there, info, slope, new
        after = here
    return affine, before, after


def affine_alignment(fixed: np.ndarray, moving: np.ndarray) -> np.ndarray:
    """An aligner for cascades: the moving volume, registered and put on the fixed one's grid."""
    return warp(moving, register(fixed, moving)[0], fixed.shape)


def registered(pairs: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """(pair, affine, before, after) of rows (pair, q_shape, qv, t_shape, tv): the affine's 12 numbers and the mutual information without
    and with it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for q, t, a, b in zip(frame.qv, frame.tv, frame.q_shape, frame.t_shape):
                affine, before, after = register(np.asarray(q, np.float64).reshape(a), np.asarray(t, np.float64).reshape(b), levels)
                rows.append((affine.values(), before, after))
            yield frame[PAIR].assign(**{c: [r[i] for r in rows] for i, c in enumerate(("affine", "before", "after"))})

    rows = pairs.select(*PAIR, "q_shape", "qv", "t_shape", "tv")
    return rows.mapInPandas(run, "dataset string, split string, query_id string, target_id string, affine array<double>, before double, after double")


def registered_nmi_scores(pairs: DataFrame, bins: int = 48, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """Registration, then digitised NMI, of the pairs (pair, q_shape, qv, t_shape, tv), a shortlist as a rule. A pair that fails, by a shape that
    does not fit, scores 0."""

    def score(q, t, a, b) -> float:
        try:
            fixed, moving = np.asarray(q, np.float64).reshape(a), np.asarray(t, np.float64).reshape(b)
        except (TypeError, ValueError):
            return 0.0
        moved = warp(moving, register(fixed, moving, levels)[0], fixed.shape)
        return digits_nmi(digits(fixed.ravel(), bins), digits(moved.ravel(), bins), bins)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[PAIR].assign(score=[score(*x) for x in zip(frame.qv, frame.tv, frame.q_shape, frame.t_shape)])

    rows = pairs.select(*PAIR, "q_shape", "qv", "t_shape", "tv")
    return rows.mapInPandas(run, "dataset string, split string, query_id string, target_id string, score double")
