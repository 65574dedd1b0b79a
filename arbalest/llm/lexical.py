"""Ranked lexical search: document-at-a-time merges over compressed postings, shard by shard.

1. Index: a task cuts its documents into shards of about ``SHARD_BYTES`` of text, in ascending order of doc_id within a shard. A shard is
   one row: its documents' ids and numbers of terms, and for each term a list of (gap to the next document, occurrences) as
   variable-length integers. Only terms that the items hold are indexed while those are at most ``VOCABULARY``; else all are, with
   equal results.
2. Statistics: documents, terms and document frequencies are sums over shards; they give each item's terms their weights.
3. Search: every shard meets the items, ``BLOCK_TERMS`` of their terms at a time. An item's lists are merged by a heap of their next
   documents. Lists whose best contributions together cannot lift a document over the k-th best score are left out of the merge and only
   looked into for documents that the others bring (as long as these could still get there). A heap of k results, keyed by score
   and then doc_id, gives the k-th score; before it is full, k documents scored ahead give a bound.
4. The k best of each shard are merged.

The only shuffles are of sums by term and of k rows an item and shard. A hot term is a longer list in each shard.

Contract of ``search``:
* documents: each row is one, also repeated rows; a null text, and one without terms, is none; a null doc_id comes after all others;
* items: of rows with one item_id (null is one) the least text counts; an item without terms, or whose terms no document holds, gives
  no row;
* equal scores go to the smaller doc_id, and rows of one doc_id in any order; scores are exact integers; extra columns are ignored;
* an empty table on either side gives an empty result.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbalest.llm import kernels as K
from arbalest.llm.common import in_small_batches, lower_ascii, stage

TOP = 20
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SHARD_BYTES = 8 << 20
#: Distinct terms of all items, and their bytes, up to which they are sent to the tasks that build the index.
VOCABULARY, VOCABULARY_BYTES = 1 << 18, 1 << 23
#: About so many (item, term) pairs are sent to a search task at once.
BLOCK_TERMS = 1 << 17

BREAKS = np.ones(256, bool)
BREAKS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(f"({TERM})"), 1)


def packed(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Integers of seven bits a byte, all but a value's last byte with the eighth bit set; and where each ends."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        more = values >= np.uint64(1 << 7 * k)
        if not more.any():
            break
        size += more
    ends = np.cumsum(size)
    out, starts = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8), ends - size
    for k in range(int(size.max(initial=0))):
        at = np.flatnonzero(size > k)
        out[starts[at] + k] = (values[at] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8) | np.where(size[at] - 1 > k, 128, 0).astype(np.uint8)
    return out.tobytes(), ends


def unpacked(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data < 128) + 1
    starts = np.append(0, ends[:-1])
    size, out = ends - starts, np.zeros(len(ends), np.int64)
    for k in range(int(size.max(initial=0))):
        at = np.flatnonzero(size > k)
        out[at] |= (data[starts[at] + k] & 127).astype(np.int64) << 7 * k
    return out


INDEX = "shard long, n_documents long, n_terms long, ids array<long>, sizes array<long>, terms array<binary>, counts array<long>, ends array<long>, postings binary"
_LONGS = pa.list_(pa.int64())
_INDEX = pa.schema([("shard", pa.int64()), ("n_documents", pa.int64()), ("n_terms", pa.int64()), ("ids", _LONGS), ("sizes", _LONGS), ("terms", pa.list_(pa.binary())), ("counts", _LONGS), ("ends", _LONGS), ("postings", pa.binary())])


class _Shard:
    """Documents and postings on the way into a shard."""

    def __init__(self, vocabulary: pa.Array | None):
        self.vocabulary, self.bytes, self.n = vocabulary, 0, 0
        self.ids, self.sizes, self.docs, self.terms, self.times, self.names = [], [], [], [], [], []

    def add(self, ids: pa.Array, data: np.ndarray, places: np.ndarray) -> None:
        starts, ends, counts = K.words(K.LOWER[data], places, BREAKS)
        words = K.word_array(K.LOWER[data], starts, ends)
        if self.vocabulary is None:
            coded = words.dictionary_encode()
            term, names = coded.indices.to_numpy().astype(np.int64) + sum(map(len, self.names)), coded.dictionary.cast(pa.binary())
            self.names.append(names)
        else:
            term = pc.fill_null(pc.index_in(words.cast(pa.binary()), self.vocabulary), -1).to_numpy().astype(np.int64)
        holding = np.flatnonzero(counts)
        doc = np.repeat(np.cumsum(counts > 0) - 1, counts)
        known = np.flatnonzero(term >= 0)
        pair, times = np.unique(doc[known] << 32 | term[known], return_counts=True)
        self.ids.append(ids.take(pa.array(holding)))
        self.sizes.append(counts[holding])
        self.docs.append((pair >> 32) + self.n)
        self.terms.append(pair & 0xFFFFFFFF)
        self.times.append(times)
        self.n += len(holding)
        self.bytes += len(data)

    def row(self, number: int) -> pa.RecordBatch:
        ids = pa.concat_arrays(self.ids)
        order = pc.array_sort_indices(ids, order="ascending", null_placement="at_end").to_numpy().astype(np.int64)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        sizes, doc, term, times = np.concatenate(self.sizes), place[np.concatenate(self.docs)], np.concatenate(self.terms), np.concatenate(self.times)
        names = self.vocabulary
        if names is None:
            coded = pa.concat_arrays(self.names).dictionary_encode()
            term, names = coded.indices.to_numpy().astype(np.int64)[term], coded.dictionary
        by = np.lexsort((doc, term))
        doc, term, times = doc[by], term[by], times[by]
        firsts = np.flatnonzero(np.diff(term, prepend=-1))
        gaps = np.diff(doc, prepend=-1)
        gaps[firsts] = doc[firsts] + 1
        data, ends = packed(np.stack([gaps, times], axis=1).ravel())
        lasts = np.append(firsts[1:], len(term)) - 1
        lists = [ids.take(pa.array(order)), pa.array(sizes[order]), names.take(pa.array(term[firsts])), pa.array(np.diff(np.append(firsts, len(term)))), pa.array(ends[2 * lasts + 1] if len(ends) else np.zeros(0, np.int64))]
        rows = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in lists]
        return pa.record_batch([pa.array([number]), pa.array([self.n]), pa.array([int(sizes.sum())]), *rows, pa.array([data], pa.binary())], schema=_INDEX)


def build(docs: DataFrame, vocabulary: list[bytes] | None = None) -> DataFrame:
    """The index of (doc_id, text): a row for each shard, of the terms in ``vocabulary`` or of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, known = TaskContext.get().partitionId() << 32, None if vocabulary is None else pa.array(vocabulary, pa.binary())
        shard = _Shard(known)
        for batch in batches:
            for row, end, data, places in K.slices(batch["text"], min(K.SLICE_BYTES, SHARD_BYTES)):
                shard.add(batch["doc_id"].slice(row, end - row), data, places)
                if shard.bytes >= SHARD_BYTES:
                    if shard.n:
                        yield shard.row(number)
                    shard, number = _Shard(known), number + 1
        if shard.n:
            yield shard.row(number)

    return stage(in_small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, INDEX))


class _Postings:
    """A term's documents in a shard, with what each adds to a score before the term's weight."""

    def __init__(self, data: np.ndarray, m: np.ndarray, k: int):
        gaps, times = unpacked(data).reshape(-1, 2).T
        docs = np.cumsum(gaps) - 1
        parts = 1_000_000_000 * times // (1000 * times + 12 * m[docs])
        self.docs, self.parts, self.most = memoryview(docs), memoryview(np.ascontiguousarray(parts.astype(np.int64))), int(parts.max())
        self.top = docs[np.argpartition(-parts, k - 1)[:k]].tolist() if len(docs) > k else docs.tolist()


def ranked(lists: list[tuple[_Postings, int]], k: int) -> list[tuple[int, int]]:
    """The k best (score, document) of documents with a score above 0, equal scores to the earlier document."""
    lists = sorted(lists, key=lambda x: x[0].most * x[1])
    docs, parts, weights = [x.docs for x, _ in lists], [x.parts for x, _ in lists], [w for _, w in lists]
    n, sizes, at, bounds, total = len(lists), [len(d) for d in docs], [0] * len(lists), [], 0
    for x, w in lists:
        total += x.most * w
        bounds.append(total)  # what this list and those before it can add

    ahead: set[int] = set()
    for x, _ in reversed(lists):
        ahead.update(x.top)
        if len(ahead) >= k:
            break
    floor = 0  # scores up to it are out
    if len(ahead) >= k:
        scores = []
        for doc in ahead:
            score = 0
            for i in range(n):
                p = bisect_left(docs[i], doc)
                if p < sizes[i] and docs[i][p] == doc:
                    score += weights[i] * parts[i][p]
            scores.append(score)
        floor = max(0, heapq.nlargest(k, scores)[-1] - 1)

    best: list[tuple[int, int]] = []
    first = 0  # lists before it are left out of the merge
    while first < n and bounds[first] <= floor:
        first += 1
    queue = [docs[i][0] * n + i for i in range(first, n)]
    heapq.heapify(queue)
    while queue:
        doc, i = divmod(queue[0], n)
        score = 0
        while i < n:  # the lists that stand at this document
            p = at[i]
            score += weights[i] * parts[i][p]
            at[i] = p = p + 1
            if p < sizes[i]:
                heapq.heapreplace(queue, docs[i][p] * n + i)
            else:
                heapq.heappop(queue)
                if not queue:
                    break
            i = queue[0] - doc * n
        for i in range(first - 1, -1, -1):
            if score + bounds[i] <= floor:
                break
            p = at[i] = bisect_left(docs[i], doc, at[i])
            if p < sizes[i] and docs[i][p] == doc:
                score += weights[i] * parts[i][p]
        if score <= floor:
            continue
        (heapq.heapreplace if len(best) == k else heapq.heappush)(best, (score, -doc))
        if len(best) == k and best[0][0] > floor:
            floor = best[0][0]
            if first < n and bounds[first] <= floor:
                while first < n and bounds[first] <= floor:
                    first += 1
                queue = [docs[i][at[i]] * n + i for i in range(first, n) if at[i] < sizes[i]]
                heapq.heapify(queue)
    return [(score, -doc) for score, doc in sorted(best, reverse=True)]


FOUND = "item_id long, doc_id long, score long"


def _search(items: list[tuple[int | None, list[bytes], list[int]]], n: int, total: int, k: int):
    schema = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = sorted({t for _, terms, _ in items for t in terms})
        wanted = pa.array(names, pa.binary())
        for batch in batches:
            for r in range(batch.num_rows):
                place = pc.index_in(wanted, batch["terms"][r].values).to_pylist()
                where = dict(zip(names, place))
                ids, sizes, ends = batch["ids"][r].values, batch["sizes"][r].values.to_numpy(), batch["ends"][r].values.to_numpy()
                if 25 * int(sizes.max(initial=0)) * n < 1 << 62:
                    m = 75 + 25 * sizes * n // total
                else:
                    m = np.array([75 + 25 * int(s) * n // total for s in sizes], np.int64)
                data, held, found = np.frombuffer(batch["postings"][r].as_buffer(), np.uint8), {}, []
                for item, terms, weights in items:
                    lists = []
                    for term, weight in zip(terms, weights):
                        if (at := where[term]) is not None:
                            if at not in held:
                                held[at] = _Postings(data[ends[at - 1] if at else 0 : ends[at]], m, k)
                            lists.append((held[at], weight))
                    if lists:
                        best = ranked(lists, k)
                        found += [(item, doc, score) for score, doc in best]
                if found:
                    item, doc, score = zip(*found)
                    yield pa.record_batch([pa.array(item, pa.int64()), ids.take(pa.array(doc, pa.int64())), pa.array(score, pa.int64())], schema=schema)

    return run


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents (doc_id, text) with the highest scores for each of the items (item_id, text)."""
    items = items.groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.min("text").alias("text"))
    asked = stage(items.select("item_id", F.explode(terms_of(F.col("text"))).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("times")))
    names = asked.select(F.col("term").cast("binary").alias("term")).distinct()
    size = names.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("bytes")).first()
    bounded = size.n <= VOCABULARY and size.bytes <= VOCABULARY_BYTES
    index = build(docs, sorted(bytes(r.term) for r in names.collect()) if bounded else None)

    sums = index.agg(F.coalesce(F.sum("n_documents"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("total")).first()
    counted = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).select(F.col("t.terms").cast("string").alias("term"), F.col("t.counts").alias("count"))
    df = counted.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("count").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * sums.n + 2) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    asked = stage(asked.join(df, "term").select("item_id", F.col("term").cast("binary").alias("term"), (weight * F.col("times")).alias("weight")).where("weight > 0"))

    n_blocks = -(-asked.count() // BLOCK_TERMS)
    placed = asked.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(max(1, n_blocks))))
    found = []
    for block in range(n_blocks):  # each is bounded by its share of the items' terms
        of: dict[int | None, tuple[list[bytes], list[int]]] = {}
        for r in placed.where(F.col("block") == block).orderBy("item_id", "term").collect():
            terms, weights = of.setdefault(r.item_id, ([], []))
            terms.append(bytes(r.term))
            weights.append(r.weight)
        found.append(index.mapInArrow(_search([(item, *v) for item, v in of.items()], sums.n, sums.total, k), FOUND))
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return reduce(DataFrame.unionAll, found).withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
