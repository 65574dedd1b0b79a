"""Dense kernels on one volume or image (numpy), and the plans that apply them in Arrow batches.

Each entity is one row; Spark spreads the rows. Axes are x, y, z throughout.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def robust(volume: np.ndarray, least: int = 64) -> np.ndarray:
    mask = np.abs(volume) > 1e-6
    if mask.sum() < least:
        return np.zeros(volume.shape)
    inside = np.clip(volume[mask], *np.quantile(volume[mask], [0.01, 0.99]))
    q1, med, q3 = np.quantile(inside, [0.25, 0.5, 0.75])
    out = np.zeros(volume.shape)
    out[mask] = np.clip((inside - med) / max(q3 - q1, 1e-6), -6, 6)
    return out


def _along(volume: np.ndarray, axis: int, at: np.ndarray) -> np.ndarray:
    """Linear interpolation along one axis at fractional places, edges held."""
    n = volume.shape[axis]
    at = np.clip(at, 0, n - 1)
    lo = np.minimum(np.floor(at).astype(int), max(n - 2, 0))
    share = (at - lo).reshape([-1 if i == axis else 1 for i in range(volume.ndim)])
    return volume.take(lo, axis) * (1 - share) + volume.take(np.minimum(lo + 1, n - 1), axis) * share


def resample(volume: np.ndarray, shape: tuple[int, ...], corners: bool = True) -> np.ndarray:
    """Linear resampling to an exact shape. ``corners``: the end voxels' centres coincide; else half-pixel places."""
    for axis, m in enumerate(shape):
        n = volume.shape[axis]
        at = np.linspace(0, n - 1, m) if corners else (np.arange(m) + 0.5) * n / m - 0.5
        volume = _along(volume, axis, at)
    return volume


def smoothing_weights(n: int, m: int) -> np.ndarray:
    """(m, n) weights of a linear resize from n to m places: triangles at half-pixel places, as wide as the reduction, cut at the
    edges and normed. Without a reduction it is plain linear interpolation."""
    scale = max(n / m, 1.0)
    centres = (np.arange(m) + 0.5) * n / m
    weights = np.maximum(0.0, 1 - np.abs(np.arange(n)[None, :] + 0.5 - centres[:, None]) / scale)
    return weights / weights.sum(axis=1, keepdims=True)


def smooth_resize(image: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """Linear resize that averages what it leaves out, one axis after the other."""
    for axis, m in enumerate(shape):
        image = np.moveaxis(np.tensordot(smoothing_weights(image.shape[axis], m), image, (1, axis)), 0, axis)
    return image


def _filtered(volume: np.ndarray, weights: np.ndarray, axis: int) -> np.ndarray:
    """Correlation along one axis; the volume is mirrored at its edges, edge voxels included."""
    r = len(weights) // 2
    n = volume.shape[axis]
    places = np.arange(-r, n + r) % (2 * n)
    padded = volume.take(np.where(places < n, places, 2 * n - 1 - places), axis)
    return sum(w * padded.take(np.arange(i, i + n), axis) for i, w in enumerate(weights))


def gaussian(volume: np.ndarray, sigma: float = 1.0, first: int = 0) -> np.ndarray:
    """Along all axes from ``first`` on; those before count volumes."""
    r = int(4 * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    for axis in range(first, volume.ndim):
        volume = _filtered(volume, weights / weights.sum(), axis)
    return volume


def sobel(volume: np.ndarray, axis: int, first: int = 0) -> np.ndarray:
    for other in range(first, volume.ndim):
        volume = _filtered(volume, np.array([-1.0, 0, 1]) if other == axis else np.array([1.0, 2, 1]), other)
    return volume


def descriptors(volumes: np.ndarray, least: int = 64) -> np.ndarray:
    """Smoothed volume, gradient magnitude, and six self-similarities under unit shifts, as one centred unit vector for each volume."""
    n = len(volumes)
    smooth = gaussian(_robusts(volumes, least), first=1)
    parts = [smooth, np.sqrt(sum(sobel(smooth, axis, 1) ** 2 for axis in (1, 2, 3)))]
    for axis in (1, 2, 3):
        for step in (1, -1):
            diff = gaussian((smooth - np.roll(smooth, step, axis)) ** 2, first=1)
            parts.append(np.exp(-diff / (diff.reshape(n, -1).mean(axis=1) + 1e-6).reshape(n, 1, 1, 1)))
    out = np.concatenate([c.reshape(n, -1) for c in parts], axis=1)
    out -= out.mean(axis=1, keepdims=True)
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(size > 0, size, 1)


def _robusts(volumes: np.ndarray, least: int) -> np.ndarray:
    """``robust`` of each volume; those without a voxel at 0 all at once."""
    out, flat = np.empty(volumes.shape), volumes.reshape(len(volumes), -1)
    full = (np.abs(flat) > 1e-6).all(axis=1) & (flat.shape[1] >= least)
    for i in np.flatnonzero(~full):
        out[i] = robust(volumes[i], least)
    if full.any():
        inside = flat[full]
        inside = np.clip(inside, *(x[:, None] for x in np.quantile(inside, [0.01, 0.99], axis=1)))
        q1, med, q3 = (x[:, None] for x in np.quantile(inside, [0.25, 0.5, 0.75], axis=1))
        out[full] = np.clip((inside - med) / np.maximum(q3 - q1, 1e-6), -6, 6).reshape(-1, *volumes.shape[1:])
    return out


def descriptor(volume: np.ndarray, least: int = 64) -> np.ndarray:
    return descriptors(volume[None], least)[0]


def edge_distance(mask: np.ndarray, spacing: tuple[float, ...] = (1.0, 1.0, 1.0)) -> np.ndarray:
    """Euclidean distance, in units of ``spacing``, of each voxel of the mask to the nearest one off it, axis by axis. Of a mask without a
    voxel off it the outside counts."""
    if mask.all():
        return edge_distance(np.pad(mask, 1), spacing)[tuple(slice(1, -1) for _ in mask.shape)]
    square = np.where(mask, np.inf, 0.0)
    for axis, step in enumerate(spacing):
        n = mask.shape[axis]
        places = np.arange(n).reshape([-1 if i == axis else 1 for i in range(mask.ndim)])
        square = np.minimum.reduce([square.take([j], axis) + (step * (places - j)) ** 2 for j in range(n)])
    return np.sqrt(square)


def resect(volume: np.ndarray, radii: tuple[float, float, float], seed: int, spacing: tuple[float, ...] = (1.0, 1.0, 1.0)) -> np.ndarray:
    """An ellipsoid set to 0, centred on a voxel that is at least its radius inside the volume's foreground; if there is none,
    on one at half the largest depth or more. Radii are in units of ``spacing``."""
    if not (volume > 0).any():
        return volume
    depth = edge_distance(volume > 0, spacing)
    deep = np.argwhere(depth >= max(radii))
    deep = deep if len(deep) else np.argwhere(depth >= 0.5 * depth.max())
    centre = deep[np.random.default_rng(seed).integers(len(deep))]
    grid = np.indices(volume.shape)
    inside = sum(((grid[i] - centre[i]) * spacing[i] / radii[i]) ** 2 for i in range(3)) <= 1
    return np.where(inside, 0, volume)


def scanner_shift(volume: np.ndarray, seed: int, bias: float = 0.3, gamma: float = 0.2, gain: float = 0.1) -> np.ndarray:
    """A smooth multiplicative field, a gamma curve and a gain, on the foreground."""
    random = np.random.default_rng(seed)
    field = resample(random.uniform(1 - bias, 1 + bias, (2, 2, 2)), volume.shape)
    top = volume.max()
    if top <= 0:
        return volume
    curve = np.clip(volume / top, 0, None) ** (1 + random.uniform(-gamma, gamma))
    return np.where(volume > 0, curve * top * field * (1 + random.uniform(-gain, gain)), volume)


def augment(image: np.ndarray, seed: int) -> np.ndarray:
    """A random flip of each axis, a quarter turn, and brightness jitter of a 2-D image."""
    random = np.random.default_rng(seed)
    for axis in (0, 1):
        image = np.flip(image, axis) if random.random() < 0.5 else image
    return np.rot90(image, random.integers(4)) * random.uniform(0.9, 1.1)


def map_volumes(rows: DataFrame, kernel: Callable[[np.ndarray, str], np.ndarray]) -> DataFrame:
    """(id, shape, data) rows through a kernel of (volume, id), one Arrow batch at a time; other columns are dropped."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [kernel(np.asarray(v, np.float64).reshape(s), i) for i, s, v in zip(frame.id, frame["shape"], frame.data)]
            yield pd.DataFrame({"id": frame.id, "shape": [list(v.shape) for v in out], "data": [v.ravel() for v in out]})

    return rows.select("id", "shape", "data").mapInPandas(run, "id string, shape array<int>, data array<double>")
