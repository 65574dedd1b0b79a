"""The inverted-file index against all pairs: exact results, recall with probes, hot cells and odd pools."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbalest.operators import inverted, scoring
from arbalest.operators.scoring import POOL

SIDE = "dataset string, split string, target_id string, tv array<double>"


def clustered(n, clusters, seed=3, width=16, spread=0.25):
    random = np.random.default_rng(seed)
    centers = random.normal(size=(clusters, width))
    return centers[random.integers(0, clusters, n)] + spread * random.normal(size=(n, width))


def gallery_of(spark, vectors, pools=2):
    return spark.createDataFrame([(f"d{i % pools}", "val", f"t{i:05d}", [float(x) for x in v]) for i, v in enumerate(vectors)], SIDE).repartition(3)


def rows(frame):
    return sorted((r.dataset, r.target_id, r["rank"], r.neighbour) for r in frame.collect())


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(inverted, "BLOCK", 20)
    monkeypatch.setattr(inverted, "QUERIES", 15)


def test_exact_lists(spark, small):
    vectors = np.concatenate([clustered(260, 9), np.tile(clustered(1, 1), (70, 1)), 5 * clustered(10, 2), np.zeros((3, 16)), -3 * np.ones((4, 16))])  # a hot vector, long ones, zeros
    gallery = gallery_of(spark, vectors)
    assert rows(inverted.neighbours(gallery, 7)) == rows(scoring.neighbours(gallery, 7))


def test_small_pools_and_none(spark):
    gallery = gallery_of(spark, clustered(5, 2), 3)
    assert rows(inverted.neighbours(gallery, 4)) == rows(scoring.neighbours(gallery, 4))
    one = gallery.limit(1)
    assert [r["rank"] for r in inverted.neighbours(one, 3).collect()] == [1]
    assert inverted.neighbours(gallery.where("false"), 3).collect() == []


def test_probes_reach_the_recall_with_few_pairs(spark):
    gallery = gallery_of(spark, clustered(1600, 40))
    queries = gallery.select(*POOL, F.col("target_id").alias("query_id"), F.col("tv").alias("qv"))
    index = inverted.build(gallery)
    probes = inverted.calibrated(index, queries, 11, 0.95)
    found = inverted.neighbours(gallery, 10, probes, index)
    shares = [r.recall for r in inverted.recall(found, scoring.neighbours(gallery, 10), [*POOL, "target_id", "neighbour"]).collect()]
    assert len(shares) == 2 and min(shares) >= 0.9
    for r in inverted.visited(index, queries, 11, probes).collect():
        assert r.n_pairs == 800 * 800 and r.n_scored < 0.25 * r.n_pairs
    assert inverted.calibrated(index, queries, 11, 1.0) >= probes


@pytest.mark.parametrize("dense", [0.0, 2.0])
def test_exact_search_forms_no_row_for_a_query_and_a_cell(spark, small, monkeypatch, dense):
    """Beyond the first cells, blocks meet; whether a block is scored in one product or cell by cell makes no difference."""
    visits, chosen = [], inverted._chosen
    monkeypatch.setattr(inverted, "DENSE", dense, raising=False)
    monkeypatch.setattr(inverted, "_chosen", lambda *a: visits.append(chosen(*a)) or visits[-1])
    gallery = gallery_of(spark, np.concatenate([clustered(90, 9), np.zeros((3, 16))]))
    assert rows(inverted.neighbours(gallery, 7)) == rows(scoring.neighbours(gallery, 7))
    assert sum(v.count() for v in visits) <= inverted.FIRST * 93
