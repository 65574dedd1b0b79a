"""Exact top-k by inner product with a pivot-distance index.

Vectors become integers, floor(scale * x). One more coordinate, sqrt(M - |x|^2) with M the largest squared norm (0 for a
query), turns the largest inner products into the nearest neighbours: |q - x|^2 = |q|^2 + M - 2 q.x. Every vector is keyed by its
nearest pivot and its distance to it, and the table is range-sorted by that key. Annuli are runs of at most ``BLOCK`` vectors
of one pivot in this order; a hot vector just fills more annuli. By the triangle inequality no vector of an annulus is
nearer to q than the gap between d(q, pivot) and the annulus's range of distances. Queries are sorted and blocked likewise.

1. Seeds: each query block is scored against its ``SEEDS`` nearest annuli; the k-th best score so far bounds each query.
2. Expansion: annuli are joined to a query block by pivot and range of distance, as far as the bounds reach, and
   scored as a matrix product; of each pair of blocks at most k rows a query are left, which are merged.

Ranges are widened by a slack that grows with the largest norm, so that rounding cannot lose a row; scores are exact integers. The
pivots are fitted on a bounded sample, the ``PIVOTS`` vectors whose ids hash lowest. Every vector is indexed.

Contract of ``search``:
* vectors that are null or hold a null or non-finite component take no part; all others do: shorter vectors count as
  filled up with zeros, an empty one has score 0 with all;
* a scaled component beyond a long counts as the nearest long, and so does a score, after ranking by its true value;
* of rows with one id the smallest vector counts; rows without an id take no part; a query is never its own candidate;
* ties go to the smaller id; a query with fewer than k candidates gets all; an empty table or no query gives an empty
  result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbalest.llm.common import stage

SCALE, K = 1024, 10
PIVOTS, BLOCK, QUERY_BLOCK, SEEDS = 32, 512, 128, 2
#: Pivots, nearest to a query block first, among whose annuli its seeds are chosen.
SEED_PIVOTS = 2
#: Widening of ranges: absolute, and as a share of the largest norm (rounding of a distance is under 1e-7 of it).
SLACK, ROUNDING = 1e-3, 1e-6
LONG = (1 << 63) - 1


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(id, x) from (id, vector): distinct ids with their integer vectors."""
    fit = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.where(F.col("id").isNotNull() & F.coalesce(fit, F.lit(False)))
    whole = F.transform("vector", lambda v: F.floor(v.cast("double") * scale).cast("long"))  # floor stops at the ends of a long
    return stage(rows.select(F.col("id").cast("long").alias("id"), whole.alias("x")).groupBy("id").agg(F.min("x").alias("x")))


def _matrix(lists: pa.Array) -> np.ndarray:
    """Lists as rows of one matrix, the shorter ones filled up with zeros."""
    sizes = lists.value_lengths().to_numpy()
    values = lists.flatten().to_numpy()
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return values.reshape(len(lists), width)
    out = np.zeros((len(lists), width), values.dtype)
    out[np.arange(width)[None, :] < sizes[:, None]] = values
    return out


def _block(batch: pa.RecordBatch, i: int, xs: str, ids: str) -> np.ndarray:
    return batch[xs][i].values.to_numpy().reshape(len(batch[ids][i].values), -1)


class Space:
    """Pivots in the lifted space. Norms are doubles: they only steer the search."""

    def __init__(self, rows: DataFrame):
        square = F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
        self.largest = float(rows.agg(F.max(square)).first()[0] or 0)
        picks = [r.x for r in rows.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).select("x").collect()]
        width = max(map(len, picks), default=0)
        self.pivots = np.unique(np.array([x + [0] * (width - len(x)) for x in picks], np.float64).reshape(len(picks), width), axis=0)
        self.lifts = np.sqrt(np.maximum(self.largest - (self.pivots**2).sum(axis=1), 0))
        self.slack = SLACK + ROUNDING * np.sqrt(self.largest)

    def distances(self, x: np.ndarray, query: bool) -> np.ndarray:
        x = x.astype(np.float64)
        norm, w = (x**2).sum(axis=1), min(x.shape[1], self.pivots.shape[1])
        lift = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.largest - norm, 0))
        inner = x[:, :w] @ self.pivots[:, :w].T + lift[:, None] * self.lifts[None, :]
        square = (norm + lift**2)[:, None] + ((self.pivots**2).sum(axis=1) + self.lifts**2)[None, :] - 2 * inner
        return np.sqrt(np.maximum(square, 0))


def _keyed(space: Space, query: bool):
    schema = pa.schema([("id", pa.int64()), ("x", pa.list_(pa.int64())), ("cell", pa.int32()), ("d", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = space.distances(_matrix(batch["x"]), query)
                cell = d.argmin(axis=1)
                yield pa.record_batch([batch["id"], batch["x"], pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], schema=schema)

    return run


def _blocks(size: int, by_cell: bool):
    """Runs of sorted rows as one row each."""
    schema = pa.schema([("block", pa.int64()), ("cell", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("ids", pa.list_(pa.int64())), ("xs", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            cell, d = batch["cell"].to_numpy(), batch["d"].to_numpy()
            starts = np.append(0, np.flatnonzero(cell[1:] != cell[:-1]) + 1) if by_cell else np.zeros(1, np.int64)
            for a, b in zip(starts, np.append(starts[1:], len(cell))):
                for lo in range(a, b, size):
                    n = min(size, b - lo)
                    ids, xs = batch["id"].slice(lo, n), pa.array(_matrix(batch["x"].slice(lo, n)).ravel())
                    lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (ids, xs)]
                    yield pa.record_batch([pa.array([block]), pa.array([cell[lo]]), pa.array([d[lo]]), pa.array([d[lo + n - 1]]), *lists], schema=schema)
                    block += 1

    return run


BLOCKS = "block long, cell int, low double, high double, ids array<long>, xs array<long>"


def blocks(rows: DataFrame, space: Space, query: bool, size: int) -> DataFrame:
    keyed = rows.mapInArrow(_keyed(space, query), "id long, x array<long>, cell int, d double")
    keyed = keyed.repartitionByRange("cell", "d", "id").sortWithinPartitions("cell", "d", "id")
    return stage(keyed.mapInArrow(_blocks(size, not query), BLOCKS))


def _reach(space: Space):
    """How far a query block reaches around each pivot: (block, cell, lo, hi). Without bounds: its own distances."""
    schema = pa.schema([("qblock", pa.int64()), ("cell", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q = _block(batch, i, "qxs", "qids").astype(np.float64)
                d, radius = space.distances(q, True), np.zeros(len(q))
                if "bounds" in batch.schema.names:
                    bound = batch["bounds"][i].values.to_numpy(zero_copy_only=False).astype(np.float64)  # null: nan
                    radius = np.sqrt(np.maximum((q**2).sum(axis=1) + space.largest - 2 * bound, 0)) + space.slack
                    radius[np.isnan(bound)] = np.inf
                n = d.shape[1]
                lo, hi = (d - radius[:, None]).min(axis=0) - space.slack, (d + radius[:, None]).max(axis=0) + space.slack
                yield pa.record_batch([pa.array(np.full(n, batch["qblock"][i].as_py())), pa.array(np.arange(n, dtype=np.int32)), pa.array(lo), pa.array(hi)], schema=schema)

    return run


def best(query_ids: np.ndarray, ids: np.ndarray, scores: np.ndarray, bounds: np.ndarray | None, k: int) -> tuple[np.ndarray, ...]:
    """(query id, id, score) of each query's k best candidates; ties to smaller ids."""
    order = np.argsort(ids, kind="stable")
    ids, scores = ids[order], scores[:, order]
    allowed = query_ids[:, None] != ids[None, :]
    if bounds is not None:
        allowed &= scores >= bounds[:, None]
    row, column = np.nonzero(allowed)
    score = scores[row, column]
    order = np.lexsort((column, -score, row))
    row, column, score = row[order], column[order], score[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = place < k
    return query_ids[row[keep]], ids[column[keep]], score[keep]


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products over the components that both have: doubles, longs or Python's integers, whichever hold them."""
    w = min(q.shape[1], x.shape[1])
    q, x = q[:, :w], x[:, :w]
    bound = max(abs(int(v)) for v in (q.min(initial=0), q.max(initial=0))) * max(abs(int(v)) for v in (x.min(initial=0), x.max(initial=0))) * max(w, 1)
    if bound < 1 << 52:
        return np.rint(q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return q @ x.T if bound < 1 << 62 else q.astype(object) @ x.T.astype(object)


def _scores(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("order", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                scores = products(_block(batch, i, "qxs", "qids"), _block(batch, i, "xs", "ids"))
                bounds = batch["bounds"][i].values.fill_null(-LONG - 1).to_numpy() if "bounds" in batch.schema.names else None
                *found, score = best(batch["qids"][i].values.to_numpy(), batch["ids"][i].values.to_numpy(), scores, bounds, k)
                order = pa.nulls(len(score), pa.string())
                if score.dtype == object:  # may be beyond a long
                    order = pa.array([str(v) if abs(v) > LONG else None for v in score])
                    score = np.array([min(max(v, -LONG - 1), LONG) for v in score], np.int64)
                yield pa.record_batch([*map(pa.array, found), pa.array(score), order], schema=schema)

    return run


def _scored(pairs: DataFrame, queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    sides = pairs.join(queries, "qblock").join(index.select("block", "ids", "xs"), "block").drop("qblock", "block")
    found = sides.mapInArrow(_scores(k), "query_id long, vec_id long, score long, order string")
    true = F.coalesce(F.col("order").cast("decimal(38,0)"), F.col("score").cast("decimal(38,0)"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), true.desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows (id, vector) for which ``is_query`` (of id) holds, against all others."""
    rows = integers(vectors, scale)
    space = Space(rows)
    index = blocks(rows, space, False, BLOCK)
    queries = blocks(rows.where(is_query), space, True, QUERY_BLOCK).select(F.col("block").alias("qblock"), F.col("ids").alias("qids"), F.col("xs").alias("qxs"))
    annuli = index.select("block", "cell", "low", "high")
    reach = lambda q: q.mapInArrow(_reach(space), "qblock long, cell int, lo double, hi double")

    own = F.row_number().over(Window.partitionBy("qblock").orderBy("lo", "cell"))
    near = reach(queries).withColumn("_p", own).where(F.col("_p") <= SEED_PIVOTS).drop("_p")  # without bounds a block's nearest pivots
    near = near.join(annuli, "cell").withColumn("gap", F.greatest(F.lit(0.0), F.col("low") - F.col("hi"), F.col("lo") - F.col("high")))
    order = F.row_number().over(Window.partitionBy("qblock").orderBy("gap", "block"))
    seeds = near.withColumn("_r", order).where(F.col("_r") <= SEEDS).select("qblock", "block")
    bounds = _scored(seeds, queries, index, k).where(F.col("rank") == k).select(F.col("query_id").alias("qid"), F.col("score").alias("bound"))
    placed = queries.select("qblock", F.posexplode("qids").alias("at", "qid")).join(bounds, "qid", "left")
    placed = placed.groupBy("qblock").agg(F.sort_array(F.collect_list(F.struct("at", "bound"))).alias("b"))  # QUERY_BLOCK entries at most
    queries = stage(queries.join(placed.select("qblock", F.col("b.bound").alias("bounds")), "qblock"))

    pairs = reach(queries).join(annuli, "cell").where((F.col("low") <= F.col("hi")) & (F.col("high") >= F.col("lo"))).select("qblock", "block")
    return _scored(pairs, queries, index, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
