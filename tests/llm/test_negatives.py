"""Hard negatives against plain Python: ties, hot vectors, bad rows, bounds that must hold whatever the codebook."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbalest.llm import negatives


def brute(rows, positives=5, negatives_=5, low=80, high=100):
    whole = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            x = [min(max(math.floor(256 * c), -negatives.LARGEST), negatives.LARGEST) for c in v]
            whole[i] = min(whole.get(i, (label, x)), (label, x))
    capped = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    out = []
    for a, (label, q) in whole.items():
        if a % 10:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i, other) for i, (other, v) in whole.items() if i != a)
        for s, p, _ in [r for r in scored if r[2] == label][:positives]:
            inside = [(n, i) for n, i, other in scored if other != label and low * -s <= 100 * -n <= high * -s]
            out += [(a, p, k + 1, i, capped(-s), capped(-n)) for k, (n, i) in enumerate(inside[:negatives_])]
    return sorted(out)


def check(spark, rows, *settings):
    frame = spark.createDataFrame(rows, "id long, label int, vector array<double>").repartition(3).withColumns({c: F.lit("extra") for c in ("x", "codes", "slot", "windows", "a_ids", "rank", "a.b")})
    got = negatives.mine(frame, F.col("id") % 10 == 0, *settings)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute(rows, *settings)
    assert sorted(tuple(r) for r in got.collect()) == want
    return want


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 64)
    monkeypatch.setattr(negatives, "ANCHORS", 7)


def clustered(n, width=6, labels=4, seed=1):
    random = np.random.default_rng(seed)
    centers = random.normal(size=(labels, width))
    return [(i, i % labels, [float(x) for x in centers[i % labels] * 0.3 + random.normal(size=width)]) for i in range(n)]


def test_mined_rows_are_exact_over_many_blocks(spark, small_blocks):
    rows = clustered(400)
    rows += [(400 + i, i % 2, [0.5, -0.25, 0.75, 1.0, 0.0, 0.125]) for i in range(90)]  # a hot vector of two labels
    rows += [(500, 1, None), (510, 1, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (520, None, [1.0] * 6), (None, 2, [1.0] * 6), (530, 0, [float("nan")] * 6), (540, 0, [float("inf")] * 6)]
    rows += [rows[10], (20, 3, [9.0] * 6), (20, 2, [0.1] * 6), (600, 77, [1.0] * 6), (610, 3, [0.0] * 6)]  # repeated ids, a label of its own, a zero vector
    want = check(spark, rows)
    assert len(want) > 500 and any(r[0] >= 400 for r in want)
    check(spark, rows, 2, 9, 95, 100)


def test_odd_vectors(spark, small_blocks):
    rows = clustered(60, 3, 2) + [(100, 0, [1.0]), (110, 1, [2.0, -1.0]), (120, 0, []), (125, 1, [0.5] * 5)]
    rows += [(130, 0, [1e300, 2.0, 1e7]), (131, 0, [1e20, 1.0, 5e6]), (132, 1, [1e19, 0.0, 4e6]), (140, 1, [3e9, 1e12, -4.0]), (141, 1, [2.5e9, 1e12, 0.0]), (143, 0, [2e9, 9e11, 1.0])]
    want = check(spark, rows)
    assert any(r[4] == (1 << 63) - 1 for r in want)


def test_few_rows_and_none(spark):
    schema = "id long, label int, vector array<float>"
    assert negatives.mine(spark.createDataFrame([], schema), F.col("id") % 10 == 0).collect() == []
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.5]), (2, 2, [0.9, 0.0]), (3, 2, [0.5, 0.0]), (4, 3, [1.0, -4.0])]
    frame = spark.createDataFrame(rows, schema)
    assert [tuple(r) for r in negatives.mine(frame, F.col("id") % 10 == 0).orderBy("rank").collect()] == [(0, 1, 1, 4, 65536, 65536), (0, 1, 2, 2, 65536, 58880)]
    assert negatives.mine(frame, F.col("id") > 10).collect() == []


def test_bounds_hold(spark):
    random = np.random.default_rng(3)
    for scale in (1, 300, 1 << 40):
        x = (random.normal(size=(700, 8)) * scale * 256).astype(np.int64)
        book = negatives.Codebook(x[:300].tolist(), 8)
        lower, upper = book.bounds(x[:50], *book.encode(x))
        true = np.array([[sum(a * b for a, b in zip(q, v)) for v in x.tolist()] for q in x[:50].tolist()], object)
        assert all(lo <= t <= hi for lo, t, hi in zip(lower.ravel(), true.ravel(), upper.ravel()))
        assert (upper - lower).mean() < np.abs(true.astype(float)).max()  # and say something
