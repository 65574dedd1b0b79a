"""Hard-negative mining by product quantisation with stored residual norms.

Vectors become integers, floor(scale * x), cut into subspaces of ``WIDTH`` components. Each subspace has up to ``CENTROIDS`` integer
centroids; the index keeps, for every row, the centroid's number and the norm of what it leaves over, in each subspace. For an anchor q,
a lookup table of the products with all centroids gives a row's approximate score by one addition a subspace, and
|score - approximation| <= sum over subspaces of |q part| * |residual part|. So every row has a certain lower and upper bound.

1. Index: rows are range-sorted by (label, id) and kept in blocks of at most ``BLOCK`` rows; a hot label fills more blocks.
2. Positives: anchor blocks meet the blocks whose labels overlap theirs. Rows whose upper bound stays under the k-th lower bound
   of their block go; integers rank the others, k rows an anchor and block are left, which are merged.
3. Negatives: anchors meet all blocks with their positives' windows. Rows whose bounds miss the window go, and those below the k-th
   lower bound of the rows surely inside it; integers decide and rank the others; k rows a window and block are merged.

Anchor blocks travel, once for each of ``slots`` groups of index blocks; an index block is shuffled once. The codebook is fitted on
the ``SAMPLE`` rows whose ids hash lowest; every row is indexed. Results do not depend on the codebook.

Contract of ``mine``:
* rows with a null id or label, a null vector, or a null or non-finite component take no part; shorter vectors count as filled up
  with zeros; of rows with one id the least (label, vector) counts; extra columns are ignored;
* a scaled component beyond 2^52 counts as 2^52, and a score beyond a long is returned as the nearest long, after being ranked and
  compared by its true value;
* ties go to the smaller id; an anchor with fewer positives, or a window with fewer negatives, gets all; anchors without either give
  no row; an empty table, or no anchor, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbalest.llm.common import stage
from arbalest.llm.topk import LONG, products

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 5, 80, 100
WIDTH, CENTROIDS, SAMPLE, ROUNDS = 2, 256, 2048, 8
#: Rows of an index block and of an anchor block at most, and components of either.
BLOCK, ANCHORS, CELLS = 4096, 256, 1 << 22
#: Groups of index blocks that anchors are sent to, at most.
SLOTS = 4096
#: Rows scored at a time, so that the sums stay in a processor's cache.
STEP = 512
LARGEST = 1 << 52
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
SCORE = pa.decimal128(38, 0)


def integers(vectors: DataFrame, scale: int) -> DataFrame:
    """(id, label, x) from (id, label, vector): distinct ids with their integer vectors."""
    fit = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fit, F.lit(False)))
    whole = F.transform("vector", lambda v: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(v.cast("double") * scale).cast("long"))))
    rows = rows.select(F.col("id").cast("long").alias("id"), F.struct(F.col("label").cast("long").alias("label"), whole.alias("x")).alias("v"))
    return stage(rows.groupBy("id").agg(F.min("v").alias("v")).select("id", "v.label", "v.x"))


class Codebook:
    """Integer centroids of each subspace, fitted by Lloyd's rounds on a bounded sample."""

    def __init__(self, sample: list[list[int]], width: int):
        self.parts = -(-max(width, 1) // WIDTH)
        points = self.split(_filled([np.array(x, np.int64) for x in sample], self.parts * WIDTH)).astype(np.float64)
        self.centroids = np.zeros((self.parts, CENTROIDS, WIDTH), np.int64)
        random = np.random.default_rng(13)
        for m in range(self.parts):
            mine = np.unique(points[:, m], axis=0)
            centers = mine[random.permutation(len(mine))[:CENTROIDS]] if len(mine) else np.zeros((1, WIDTH))
            for _ in range(ROUNDS if len(mine) > CENTROIDS else 0):
                nearest = _nearest(points[:, m], centers)
                n = np.bincount(nearest, minlength=len(centers))
                sums = np.stack([np.bincount(nearest, points[:, m, j], len(centers)) for j in range(WIDTH)], axis=1)
                centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
            self.centroids[m, : len(centers)] = np.rint(centers)
            self.centroids[m, len(centers) :] = self.centroids[m, 0]

    def split(self, x: np.ndarray) -> np.ndarray:
        return x.reshape(len(x), self.parts, WIDTH)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, residual norms, rounded up) of the rows of ``x`` in each subspace."""
        split = self.split(x)
        codes = np.stack([_nearest(split[:, m].astype(np.float64), self.centroids[m].astype(np.float64)) for m in range(self.parts)], axis=1)
        rest = (split - self.centroids[np.arange(self.parts)[None, :], codes]).astype(np.float64)
        return codes.astype(np.uint8), np.nextafter(np.sqrt((rest**2).sum(axis=2)).astype(np.float32), np.float32(np.inf))

    def bounds(self, q: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) bounds of the scores of each anchor (row of ``q``) with each encoded row."""
        parts = self.split(q).astype(np.float64)
        tables = [(self.centroids[m] @ parts[:, m].T).astype(np.float32) for m in range(self.parts)]  # (centroid, anchor)
        lengths = np.sqrt((parts**2).sum(axis=2))
        rounding = (self.parts + 2) * 2.0**-23 * sum(np.abs(t).max(axis=0).astype(np.float64) for t in tables)
        lower, upper = np.empty((len(q), len(codes))), np.empty((len(q), len(codes)))
        for a in range(0, len(codes), STEP):
            b = min(a + STEP, len(codes))
            score = tables[0][codes[a:b, 0]]
            for m in range(1, self.parts):
                score += tables[m][codes[a:b, m]]
            slack = norms[a:b].astype(np.float64) @ lengths.T * (1 + 1e-9) + rounding[None, :]
            lower[:, a:b], upper[:, a:b] = (score - slack).T, (score + slack).T
        return lower, upper


def _nearest(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers**2).sum(axis=1)[None, :] - 2 * points @ centers.T).argmin(axis=1)


def _filled(vectors: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for row, x in zip(out, vectors):
        row[: len(x)] = x
    return out


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    sizes, values = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = values
    return out


def _packed(x: np.ndarray) -> tuple[bytes, str]:
    """A matrix of integers as bytes of the narrowest type that holds them."""
    kind = next(k for k in ("<i1", "<i2", "<i4", "<i8") if not x.size or np.iinfo(k).min <= x.min() and x.max() <= np.iinfo(k).max)
    return x.astype(kind).tobytes(), kind


class Block:
    """A row of an index or anchor table."""

    def __init__(self, batch: pa.RecordBatch, i: int, prefix: str = ""):
        at = lambda name: batch[prefix + name][i]
        self.ids, self.labels = at("ids").values.to_numpy(), at("labels").values.to_numpy()
        self.x = np.frombuffer(at("xs").as_buffer(), at("kind").as_py()).reshape(len(self.ids), -1).astype(np.int64)
        if not prefix:
            self.codes = np.frombuffer(at("codes").as_buffer(), np.uint8).reshape(len(self.ids), -1)
            self.norms = np.frombuffer(at("norms").as_buffer(), np.float32).reshape(len(self.ids), -1)


INDEX = "block long, first_label long, last_label long, ids array<long>, labels array<long>, xs binary, kind string, codes binary, norms binary"


def _blocks(book: Codebook, size: int):
    """Runs of at most ``size`` sorted rows as one row each."""
    kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2 + [pa.binary(), pa.string(), pa.binary(), pa.binary()]
    schema = pa.schema(list(zip(("block", "first_label", "last_label", "ids", "labels", "xs", "kind", "codes", "norms"), kinds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for rows in _runs(batches, size):
            labels, x = rows["label"], _matrix(rows["x"], book.parts * WIDTH)
            (xs, kind), (codes, norms) = _packed(x), book.encode(x)
            values = [number, labels[0].as_py(), labels[-1].as_py(), rows["id"].to_pylist(), labels.to_pylist(), xs, kind, codes.tobytes(), norms.tobytes()]
            yield pa.record_batch([pa.array([v], t) for v, t in zip(values, kinds)], schema=schema)
            number += 1

    return run


def _runs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in runs of ``size``; the last may be shorter."""
    held, n = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, size - n)
            held.append(part)
            n, at = n + part.num_rows, at + part.num_rows
            if n == size:
                yield pa.concat_batches(held)
                held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    order = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i])) if scores.dtype == object else np.lexsort((ids, -scores))
    return np.asarray(order[:k], np.int64)


def _reduced(upper: np.ndarray, lower: np.ndarray, sure: np.ndarray, mask: np.ndarray, k: int) -> np.ndarray:
    """Places in ``mask`` whose upper bound reaches the k-th lower bound of the ``sure`` rows."""
    certain = lower[sure]
    if len(certain) > k:
        mask = mask & (upper >= np.partition(certain, len(certain) - k)[len(certain) - k])
    return np.flatnonzero(mask)


FOUND = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", SCORE)])
MINED = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", SCORE), ("negative_id", pa.int64()), ("negative_score", SCORE)])


def _positives(book: Codebook, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                anchors, block = Block(batch, i, "a_"), Block(batch, i)
                lower, upper = book.bounds(anchors.x, block.codes, block.norms)
                found = []
                for a, (name, label) in enumerate(zip(anchors.ids.tolist(), anchors.labels)):
                    same = (block.labels == label) & (block.ids != name)
                    at = _reduced(upper[a], lower[a], same, same, k)
                    score = products(anchors.x[a : a + 1], block.x[at])[0]
                    found += [(name, int(block.ids[at[j]]), int(score[j])) for j in _best(block.ids[at], score, k)]
                yield _batch(found, FOUND)

    return run


def _mined(book: Codebook, k: int, low: int, high: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                anchors, block, windows = Block(batch, i, "a_"), Block(batch, i), batch["windows"][i].as_py()
                lower, upper = book.bounds(anchors.x, block.codes, block.norms)
                found = []
                for a, (name, label, mine) in enumerate(zip(anchors.ids.tolist(), anchors.labels, windows)):
                    other = block.labels != label
                    for positive, score in (w.values() for w in mine or ()):
                        least, most = -(-low * int(score) // 100), high * int(score) // 100
                        if least > most:
                            continue
                        mask = other & (upper[a] >= least) & (lower[a] <= most)
                        at = _reduced(upper[a], lower[a], mask & (lower[a] >= least) & (upper[a] <= most), mask, k)
                        exact = products(anchors.x[a : a + 1], block.x[at])[0]
                        inside = np.flatnonzero((exact >= least) & (exact <= most))
                        at, exact = at[inside], exact[inside]
                        found += [(name, positive, int(score), int(block.ids[at[j]]), int(exact[j])) for j in _best(block.ids[at], exact, k)]
                yield _batch(found, MINED)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _first(found: DataFrame, group: list[str], score: str, name: str, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(score), name))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _long(score: str) -> Column:
    return F.greatest(F.lit(-LONG - 1).cast("decimal(38,0)"), F.least(F.lit(LONG).cast("decimal(38,0)"), F.col(score))).cast("long").alias(score)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows (id, label, vector) for which
    ``is_anchor`` (of id) holds: of each of its first ``positives`` rows of the same label, the first ``negatives`` rows of other labels
    whose score is ``low`` to ``high`` hundredths of the positive's."""
    rows = integers(vectors, scale)
    width = rows.agg(F.max(F.size("x"))).first()[0]
    book = Codebook([r.x for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("x").collect()], width or 1)
    size = max(1, min(BLOCK, CELLS // (book.parts * WIDTH)))
    blocks = lambda part, n: stage(part.repartitionByRange("label", "id").sortWithinPartitions("label", "id").mapInArrow(_blocks(book, n), INDEX))
    index, anchors = blocks(rows, size), blocks(rows.where(is_anchor), min(size, ANCHORS)).drop("codes", "norms")
    anchors = anchors.select(*(F.col(c).alias(f"a_{c}") for c in anchors.columns))
    slots = max(1, min(index.count(), SLOTS))
    index = index.withColumn("slot", F.pmod(F.xxhash64("block"), F.lit(slots).cast("long"))).repartition(slots, "slot")
    sent = lambda a: a.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long")))).repartition(slots, "slot")

    overlap = (F.col("a_first_label") <= F.col("last_label")) & (F.col("a_last_label") >= F.col("first_label"))
    found = sent(anchors).join(index, "slot").where(overlap).mapInArrow(_positives(book, positives), "anchor_id long, positive_id long, positive_score decimal(38,0)")
    first = _first(found, ["anchor_id"], "positive_score", "positive_id", positives)
    windows = first.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("positive_id", "positive_score"))).alias("of"))  # ``positives`` entries at most
    placed = anchors.select("a_block", F.posexplode("a_ids").alias("at", "anchor_id")).join(windows, "anchor_id", "left")
    placed = placed.groupBy("a_block").agg(F.sort_array(F.collect_list(F.struct("at", "of"))).alias("w")).select("a_block", F.col("w.of").alias("windows"))
    anchors = stage(anchors.join(placed, "a_block"))

    alone = (F.col("a_first_label") == F.col("a_last_label")) & (F.col("first_label") == F.col("last_label")) & (F.col("a_first_label") == F.col("first_label"))
    found = sent(anchors).join(index, "slot").where(~alone)
    found = found.mapInArrow(_mined(book, negatives, low, high), "anchor_id long, positive_id long, positive_score decimal(38,0), negative_id long, negative_score decimal(38,0)")
    best = _first(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return best.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", _long("positive_score"), _long("negative_score"))
