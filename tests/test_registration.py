"""Affine registration: planted affines, slopes by differences, odd volumes, and the jobs around it."""

import numpy as np
import pytest

from arbalest.operators import ranking
from arbalest.operators import registration as R
from arbalest.operators.scoring import digits, digits_nmi
from arbalest.plans import cascades, registering, views


def blobs(shape, seed, n=14):
    random = np.random.default_rng(seed)
    grid = np.stack(np.meshgrid(*map(np.arange, shape), indexing="ij"), -1).astype(float)
    out = np.zeros(shape)
    for _ in range(n):
        centre, size = np.array(shape) * (0.25 + 0.5 * random.random(3)), np.mean(shape) * (0.06 + 0.08 * random.random())
        out += random.uniform(0.3, 1) * np.exp(-((grid - centre) ** 2).sum(-1) / 2 / size**2)
    return out


def pair(seed, edge=24):
    """A volume, another of inverted contrast and noise, and the affine between them."""
    fixed, shape = blobs((edge, edge, edge + 4), seed), (edge, edge + 2, edge + 4)
    planted = registering.planted(str(seed))
    true = R.Affine(planted.matrix, planted.shift * edge / 12)
    back = np.linalg.inv(true.matrix)
    offset = (np.array(shape) - np.array(fixed.shape)) / 2
    inverse = R.Affine(back, -back @ true.shift)
    grid = np.stack(np.meshgrid(*map(np.arange, shape), indexing="ij"), -1).reshape(-1, 3) - offset
    moving = R.interpolate(fixed, inverse.places(grid, (np.array(fixed.shape) - 1) / 2))[0].reshape(shape)
    moving = np.exp(-1.5 * moving) + 0.02 * np.random.default_rng(seed).normal(size=shape)
    return fixed, moving, R.Affine(true.matrix, true.shift + offset)


def error(fixed, found, true):
    grid = np.stack(np.meshgrid(*map(np.arange, fixed.shape), indexing="ij"), -1).reshape(-1, 3)[(fixed > 0.3).ravel()].astype(float)
    centre = (np.array(fixed.shape) - 1) / 2
    return np.linalg.norm(found.places(grid, centre) - true.places(grid, centre), axis=1).mean()


@pytest.mark.parametrize("seed", range(4))
def test_planted_affines_are_found(seed):
    fixed, moving, true = pair(seed)
    found, before, after = R.register(fixed, moving)
    assert error(fixed, found, true) < 0.6 < error(fixed, R.Affine(np.eye(3), np.zeros(3)), true) and after > before + 0.3
    again, *_ = R.register(fixed, moving)
    assert found.values() == again.values()


def test_slopes_by_differences():
    random = np.random.default_rng(3)
    volume, at = random.normal(size=(5, 6, 7)), random.uniform(0.1, 3.9, (40, 3))
    value, slope, inside = R.interpolate(volume, at)
    assert inside.all()
    for axis in range(3):
        step = np.zeros(3)
        step[axis] = 1e-6
        same = np.floor(at[:, axis]) == np.floor(at[:, axis] + 1e-6)
        assert np.allclose((R.interpolate(volume, at + step)[0] - value)[same] / 1e-6, slope[same, axis], atol=1e-4)
    codes, moving = random.integers(0, 6, 300), random.uniform(0, 1, 300)
    info, slopes = R.information(codes, moving, (0.0, 1.0), 6)
    for i in range(5):
        more = moving.copy()
        more[i] += 1e-7
        assert (R.information(codes, more, (0.0, 1.0), 6)[0] - info) / 1e-7 == pytest.approx(slopes[i], abs=1e-4)
    same = np.arange(6).repeat(50)
    assert R.information(same, same / 5.0, (0.0, 1.0), 6)[0] == pytest.approx(np.log(6))
    outside = R.interpolate(volume, np.array([[-1.0, 0, 0], [0, 0, 6.5]]))
    assert not outside[2].any() and (outside[0] == 0).all()


def test_odd_volumes():
    flat, thin = np.ones((6, 6, 6)), blobs((9, 8, 1), 1)
    for fixed, moving in ((flat, flat), (blobs((8, 8, 8), 2), flat), (thin, thin), (blobs((8, 8, 8), 3), blobs((14, 5, 9), 4)), (np.zeros((2, 2, 2)), np.zeros((1, 1, 1)))):
        found, *_ = R.register(fixed, moving)
        assert np.isfinite(found.values()).all() and R.warp(moving, found, fixed.shape).shape == fixed.shape


def test_registered_scores(spark):
    fixed, moving, true = pair(1, 12)
    rows = [("d", "val", "q", "t", list(fixed.shape), fixed.ravel().tolist(), list(moving.shape), moving.ravel().tolist()), ("d", "val", "q", "bad", list(fixed.shape), fixed.ravel().tolist(), [3, 3, 3], [1.0])]
    frame = spark.createDataFrame(rows, "dataset string, split string, query_id string, target_id string, q_shape array<int>, qv array<double>, t_shape array<int>, tv array<double>")
    got = {r.target_id: r.score for r in R.registered_nmi_scores(frame).collect()}
    moved = R.affine_alignment(fixed, moving)
    assert got == {"t": pytest.approx(digits_nmi(digits(fixed.ravel(), 48), digits(moved.ravel(), 48), 48)), "bad": 0.0}
    plain = digits_nmi(digits(fixed.ravel(), 48), digits(R.warp(moving, R.Affine(np.eye(3), np.zeros(3)), fixed.shape).ravel(), 48), 48)
    assert got["t"] > plain
    one = R.registered(frame.where("target_id = 't'")).first()
    assert len(one.affine) == 12 and one.after > one.before


def test_registration_query(spark):
    rows = registering.affine_registration(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 6 and sum(r.n for r in rows) == 250
    assert all(r.error_after < r.error_before / 2 and r.information_after > r.information_before for r in rows)


def test_cascade_through_registration(spark):
    """The shortlist goes through the solver, the tail stays as it was."""
    q, t = (f(spark, "/root/testdata/sf0.001").where("dataset = 'dataset1' and split = 'val'") for f in (views.queries, views.linked))
    got = cascades.dataset2_ranking(q, t, views.SHAPE, k=3, aligner=R.affine_alignment)
    first = ranking.rank(cascades.descriptor_scores(q, t, 5, 0.1, 50))
    n = q.count()
    assert got.count() == n * n
    old, new = ({(r.query_id, r.target_id): r["rank"] for r in x.collect()} for x in (first, got))
    assert all(new[k] == r for k, r in old.items() if r > 3) and {k for k, r in old.items() if r <= 3} == {k for k, r in new.items() if r <= 3}
