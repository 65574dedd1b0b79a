"""Inverted-file index of galleries: nearest targets by dot product without the square of all pairs.

Centroids are fitted by k-means on a bounded sample, for all pools together; every target is filed under its nearest centroid (its cell), with
each pool's cells in blocks of about ``BLOCK`` vectors. With the farthest member of a cell at distance r from the centroid c, no
score of a query q in that cell exceeds q.c + |q| r.

* With ``probes``, a query meets its most promising cells (by q.c) only: approximate. ``calibrated`` finds the number of
  probes that reaches a recall on a bounded sample of queries.
* Without, it meets ``FIRST`` cells, and then every cell whose bound reaches its k-th best score there: exact.

With ``probes`` a query travels to its cells, in groups of ``QUERIES``; a cell's block is read once for each group. The exact search may have to
visit nearly all cells, so there blocks of queries meet blocks of targets (``blocks``), in which cells stand together and each is
scored with the queries alone whose bound it reaches: no row is formed for a query and a cell. Only centroids (``CELLS`` at most) and the sample
are on the driver. How much is skipped is the data's affair: of vectors without clusters little can be.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbalest.functions import vectors as V
from arbalest.operators import blocks
from arbalest.operators.ranking import QUERY, rank
from arbalest.operators.rerank import TARGET
from arbalest.operators.scoring import PAIR, POOL
from arbalest.sources.staging import in_small_batches, stage

SAMPLE, CELLS, BLOCK, QUERIES, FIRST = 1 << 14, 1 << 10, 512, 256, 2
#: Bounds are widened by this share of the norms, so that rounding cannot lose a target.
SLACK = 1e-9
#: Share of open cells of a block from which all its pairs are scored in one product.
DENSE = 0.25
CELL = [*POOL, "cell"]


@dataclass(frozen=True)
class Index:
    """``blocks``: (dataset, split, cell, block, target_ids, tvs); ``cells``: each pool's cells with radius and blocks, as arrays; ``homes``: (target, tv,
    cell)."""

    centroids: np.ndarray
    blocks: DataFrame
    cells: DataFrame
    homes: DataFrame


def build(gallery: DataFrame, cells: int | None = None, seed: int = 2026) -> Index:
    """The index of (dataset, split, target_id, tv); by default as many cells as the root of the largest pool's size."""
    rows = stage(gallery.select(*POOL, "target_id", V.doubles("tv").alias("tv")))
    most = rows.groupBy(*POOL).count().agg(F.max("count")).first()[0] or 1
    sample = rows.orderBy(F.xxhash64("target_id", F.lit(seed)), *POOL, "target_id").limit(SAMPLE).select(array_to_vector("tv").alias("features"))
    k = min(cells or max(1, round(most**0.5)), CELLS)
    centroids = np.array(KMeans(k=k, seed=seed, maxIter=10).fit(stage_vectors(sample)).clusterCenters()) if most > 1 and k > 1 else np.zeros((1, len(rows.first().tv) if not rows.isEmpty() else 0))

    def file(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = np.stack(frame.tv) if len(frame) else np.zeros((0, centroids.shape[1]))
            square = (x**2).sum(axis=1)[:, None] + (centroids**2).sum(axis=1)[None, :] - 2 * x @ centroids.T
            cell = square.argmin(axis=1)
            yield frame.assign(cell=cell.astype(np.int32), far=np.sqrt(((x - centroids[cell]) ** 2).sum(axis=1)))

    filed = stage(rows.mapInPandas(file, "dataset string, split string, target_id string, tv array<double>, cell int, far double"))
    sizes = filed.groupBy(*CELL).agg(F.max("far").alias("radius"), F.ceil(F.count("*") / BLOCK).cast("int").alias("n_blocks"))
    filled = filed.join(sizes.select(*CELL, "n_blocks"), CELL).withColumn("block", F.pmod(F.xxhash64("target_id"), F.col("n_blocks")).cast("int"))
    filled = filled.groupBy(*CELL, "block").agg(F.collect_list("target_id").alias("target_ids"), F.flatten(F.collect_list("tv")).alias("tvs"))  # about ``BLOCK`` vectors
    listed = sizes.groupBy(*POOL).agg(F.sort_array(F.collect_list(F.struct("cell", "radius", "n_blocks"))).alias("cells"))  # ``CELLS`` entries at most
    return Index(centroids, stage(filled), stage(listed), filed.select(*TARGET, "tv", "cell"))


def stage_vectors(sample: DataFrame) -> DataFrame:
    """A bounded sample that k-means reads many times."""
    return sample.sparkSession.createDataFrame(sample.collect(), sample.schema)


def _chosen(index: Index, queries: DataFrame, probes: int) -> DataFrame:
    """(query, cell, n_blocks) of the first ``probes`` cells."""
    centroids = index.centroids

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch["cells"]
            ids, n = (held.flatten().field(c).to_numpy() for c in ("cell", "n_blocks"))
            starts = held.offsets.to_numpy() - held.offsets[0].as_py()
            places = []
            for at, to, vector in zip(starts, starts[1:], batch["qv"]):
                near = centroids[ids[at:to]] @ np.asarray(vector.values.to_numpy(zero_copy_only=False))
                places.append(at + np.argsort(-near, kind="stable")[:probes])
            rows = pa.array(np.repeat(np.arange(len(places)), [len(x) for x in places]))
            at = np.concatenate(places).astype(np.int64) if places else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(batch[c].take(rows) for c in (*QUERY, "qv")), pa.array(ids[at]), pa.array(n[at])], names=[*QUERY, "qv", "cell", "n_blocks"])

    rows = in_small_batches(queries.join(index.cells, POOL)).select(*QUERY, "qv", "cells")
    return rows.mapInArrow(choose, "dataset string, split string, query_id string, qv array<double>, cell int, n_blocks int")


def _scored(index: Index, visits: DataFrame, k: int) -> DataFrame:
    """The k best targets of each query and block: (pair, score)."""
    visits = stage(visits)
    groups = visits.groupBy(*CELL).agg(F.ceil(F.count("*") / QUERIES).alias("_n"))
    grouped = visits.join(groups, CELL).withColumn("_g", F.pmod(F.xxhash64("query_id"), F.col("_n")))
    grouped = grouped.groupBy(*CELL, "n_blocks", "_g").agg(F.collect_list("query_id").alias("query_ids"), F.flatten(F.collect_list("qv")).alias("qvs"))  # about ``QUERIES`` vectors
    grouped = grouped.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).drop("n_blocks", "_g")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                a, b = (np.asarray(v, np.float64).reshape(len(ids), -1) for v, ids in ((row.qvs, row.query_ids), (row.tvs, row.target_ids)))
                names, targets = np.asarray(row.query_ids), np.asarray(row.target_ids)
                score = a @ b.T
                order = np.lexsort((np.broadcast_to(targets, score.shape), -np.round(score, 9)), axis=1)[:, :k]
                at = np.repeat(np.arange(len(a)), order.shape[1])
                yield pd.DataFrame({"dataset": row.dataset, "split": row.split, "query_id": names[at], "target_id": targets[order.ravel()], "score": score[at, order.ravel()]})

    return in_small_batches(grouped.join(index.blocks, [*CELL, "block"])).mapInPandas(run, "dataset string, split string, query_id string, target_id string, score double")


def _reached(index: Index, queries: DataFrame, k: int, size: int | None = None) -> DataFrame:
    """The k best targets of each query (with ``least``, null where nothing is known) and block, among cells whose bound reaches ``least``."""
    centroids = index.centroids
    ends = index.cells.select(*POOL, F.inline("cells")).select(*CELL, "radius")
    gallery = index.homes.join(ends, CELL).select(*TARGET, "tv", "cell", "radius")
    low = queries.withColumn("least", F.coalesce("least", F.lit(float("-inf"))))

    def run(unit: blocks.Unit, schema: pa.Schema) -> pa.Table:
        q, least, cell = unit.qf["qv"], unit.qf["least"], unit.tf["cell"]
        norm, mean = np.sqrt((q**2).sum(axis=1)), np.abs(centroids).sum() / max(len(centroids), 1)
        order = np.argsort(cell, kind="stable")
        starts = np.flatnonzero(np.r_[True, cell[order][1:] != cell[order][:-1]])
        ends = np.r_[starts[1:], len(order)]
        ids, radius = cell[order[starts]], unit.tf["radius"][order[starts]]
        found, step = [], max(1, blocks.CHUNK // len(order))
        for at in range(0, len(q), step):
            some = slice(at, at + step)
            near = q[some] @ centroids[ids].T
            reach = near + norm[some, None] * radius + SLACK * (1 + norm[some, None] * (mean + radius))
            open_ = reach >= least[some, None]
            score = np.full((len(near), len(order)), -np.inf)
            if open_.mean() > DENSE:  # one product is faster than many
                score = np.where(np.repeat(open_, ends - starts, axis=1)[:, np.argsort(order)], unit.scores(at, at + step), -np.inf)
            else:
                for c, (left, right) in enumerate(zip(starts, ends)):
                    rows = np.flatnonzero(open_[:, c])
                    if len(rows):
                        score[np.ix_(rows, order[left:right])] = q[some][rows] @ unit.tf["tv"][order[left:right]].T
            rows, cols = blocks.best_columns(score, k, blocks.SLACK)
            seen = np.isfinite(score[rows, cols])
            rows, cols = rows[seen], cols[seen]
            got = unit.pair_scores(rows + at, cols, score[rows, cols])
            keep = blocks._first(rows, cols, got, k)
            found.append((rows[keep] + at, cols[keep], got[keep]))
        rows, cols, got = (np.concatenate(x) for x in zip(*found))
        return unit.table(schema, query_id=unit.query_ids.take(pa.array(rows)), target_id=unit.target_ids.take(pa.array(cols)), score=got)

    scorer = blocks.dot(low, gallery)
    scorer = replace(scorer, t=("tv", "cell", "radius"))
    return blocks.met(scorer, run, "dataset string, split string, query_id string, target_id string, score double", ("least",), size)


def search(index: Index, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """Each query's (query_id, qv) ``k`` best targets of its pool as (pair, score, rank); exact without ``probes``."""
    queries = queries.select(*QUERY, V.doubles("qv").alias("qv"))
    first = _scored(index, _chosen(index, queries, probes or FIRST), k)
    if probes:
        return rank(first, k)
    bounds = stage(rank(first, k).where(F.col("rank") == k).select(*QUERY, (F.round("score", 9) - 1e-9).alias("least")))
    return rank(_reached(index, queries.join(bounds, QUERY, "left"), k), k)


def visited(index: Index, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """Pairs that ``search`` scores with so many probes, by pool, beside all pairs: (n_scored, n_pairs)."""
    sizes = index.homes.groupBy(*CELL).agg(F.count("*").alias("n"))
    asked = _chosen(index, queries.select(*QUERY, V.doubles("qv").alias("qv")), probes).groupBy(*CELL).agg(F.count("*").alias("q"))
    scored = asked.join(sizes, CELL).groupBy(*POOL).agg(F.sum(F.col("q") * F.col("n")).alias("n_scored"))
    both = queries.groupBy(*POOL).agg(F.count("*").alias("q")).join(sizes.groupBy(*POOL).agg(F.sum("n").alias("n")), POOL)
    return both.join(scored, POOL).select(*POOL, "n_scored", (F.col("q") * F.col("n")).alias("n_pairs"))


def calibrated(index: Index, queries: DataFrame, k: int, recall: float = 0.95, sample: int = 256, seed: int = 2026) -> int:
    """Probes that find the share ``recall`` of the exact k best targets of a sample of queries: the quantile of the places, in a query's order
    of cells, of the cells that hold them."""
    some = stage(queries.select(*QUERY, V.doubles("qv").alias("qv")).orderBy(F.xxhash64("query_id", F.lit(seed)), *QUERY).limit(sample))
    wanted = search(index, some, k).join(index.homes, [*POOL, "target_id"]).select(*QUERY, F.col("cell").alias("home"))
    centroids = index.centroids

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            at = []
            for row in frame.itertuples(index=False):
                ids = np.array([c["cell"] for c in row.cells])
                order = ids[np.argsort(-(centroids[ids] @ np.asarray(row.qv)), kind="stable")]
                at.append(int(np.flatnonzero(order == row.home)[0]) + 1)
            yield pd.DataFrame({"place": at})

    rows = wanted.join(some, QUERY).join(index.cells, POOL).select("qv", "home", "cells").mapInPandas(place, "place int")
    return int(np.ceil(rows.agg(F.percentile("place", F.lit(recall))).first()[0] or 1))


def neighbours(gallery: DataFrame, k: int, probes: int | None = None, index: Index | None = None) -> DataFrame:
    """``scoring.neighbours`` through the index (exact without ``probes``): each target's k nearest, itself with a score of -1."""
    index = index or build(gallery)
    found = search(index, gallery.select(*POOL, F.col("target_id").alias("query_id"), F.col("tv").alias("qv")), k + 1, probes)
    own = gallery.select(*POOL, F.col("target_id").alias("query_id"), "target_id", F.lit(-1.0).alias("score"))
    ranked = rank(found.where("query_id <> target_id").select(*PAIR, "score").unionByName(own), k)
    return ranked.select(*POOL, F.col("query_id").alias("target_id"), F.col("target_id").alias("neighbour"), "rank")


def recall(found: DataFrame, exact: DataFrame, keys: list[str]) -> DataFrame:
    """Share of the exact rows that were found, by pool."""
    hits = exact.join(found.select(*keys).distinct().withColumn("_hit", F.lit(1)), keys, "left")
    return hits.groupBy(*POOL).agg(F.round(F.avg(F.coalesce("_hit", F.lit(0))), 6).alias("recall"))
