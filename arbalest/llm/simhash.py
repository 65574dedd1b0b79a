"""SimHash near-duplicates with pivot distance tables.

Distances to fixed reference fingerprints (pivots) obey the triangle inequality: fingerprints within r bits of each
other differ by at most r in every pivot distance. Inside a bucket the fingerprints are sorted by their distance to
the first pivot, pairs are taken only while that coordinate is within r, the other coordinates discard most of the
rest, and the survivors are verified bit by bit. Random fingerprints all lie near 32 from any pivot, so pivots alone
would leave a quadratic number of pairs to discard; the buckets are therefore exact pigeonhole keys: of r + 2 bit blocks at
least 2 agree in any pair within r bits, and a fingerprint is filed under all pairs of its blocks (15 for r = 4, of 21 bits
each). From ``WIDER`` distinct fingerprints on, keys of 3 of r + 3 blocks, then of 4 of r + 4, keep buckets small.

A bucket of more than ``BLOCK`` fingerprints is cut into blocks by hash, and each pair of blocks is one unit of work, so
that neither a task nor memory grows with a bucket. A unit emits the edges of a spanning forest, never all its pairs.
Components come from alternating large-star and small-star rounds, each written as a table.

Contract of ``near_duplicates``:
* A-Z are lower-cased; shingles are ``width`` consecutive words (runs of anything but space and \\x09-\\x0D), joined by a
  space, repeats included; fewer words form one shingle; a text without words, or null, has the fingerprint 0, which is
  linked like any other;
* a bit is set if it is set in over half of the shingles' XXH64 (seed 42);
* fingerprints within ``radius`` = 4 bits are linked; a component's id is its smallest document id (null ids are not
  counted; a component of null ids has a null id); one result row for each input row; an empty table gives an empty
  result; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbalest.llm.common import in_small_batches, stage
from arbalest.llm.kernels import U, mix

WIDTH, RADIUS, SEED = 4, 4, 42
PIVOTS = mix(np.arange(1, 17, dtype=U))
BLOCK = 1024
#: Numbers of fingerprints from which keys take one block more: 2**25 meet 21 bits 16 times, 2**31 meet 27 bits as often.
WIDER = (1 << 25, 1 << 31)
NO_ID = (1 << 63) - 1


def _masks(radius: int = RADIUS, agree: int = 2) -> list[int]:
    """Masks of all choices of ``agree`` of ``radius`` + ``agree`` bit blocks; two fingerprints within the radius agree under one of
    them."""
    ends = [round(64 * i / (radius + agree)) for i in range(radius + agree + 1)]
    blocks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in itertools.pairwise(ends)]
    return [sum(choice) for choice in itertools.combinations(blocks, agree)]


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.append(0, ends[:-1] + 1)
    last = max(0, len(words) - width)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[: last + 1].tolist(), ends[min(width, len(words)) - 1 :].tolist())), U, last + 1)
    counts = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(U)[0])


def _fingerprints(width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.fromiter((fingerprint((t.as_py() or "").encode(), width) for t in batch["text"]), U, batch.num_rows)
            yield pa.record_batch([batch["doc_id"], batch["th"], pa.array(got.view(np.int64))], schema=schema)

    return run


def _forest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest member of each node's component, given edges (x, y) among n nodes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while (up := label[label] < label).any():
            label = np.where(up, label[label], label)
        if (before == label).all():
            return label


def linked(group: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of the links within each group: places of both ends."""
    table = np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    order = np.lexsort((table[:, 0], group))
    group, fps, table = group[order], fps[order], table[order]
    live, shift, label, xs, ys, held = np.arange(len(fps) - 1), 1, np.arange(len(fps)), [], [], 0
    while len(live):
        live = live[live + shift < len(fps)]
        far = live + shift
        live = live[(group[live] == group[far]) & (table[far, 0] - table[live, 0] <= radius)]  # sorted: later shifts fail too
        near = live
        for k in range(1, len(PIVOTS)):
            near = near[np.abs(table[near, k] - table[near + shift, k]) <= radius]
            if not len(near):
                break
        near = near[np.bitwise_count(fps[near] ^ fps[near + shift]) <= radius]
        xs.append(near)
        ys.append(near + shift)
        held += len(near)
        if held > 4 * len(fps) + 1_000_000 or not len(live):
            label = _forest(len(fps), np.concatenate([*xs, np.arange(len(fps))]), np.concatenate([*ys, label]))
            xs, ys, held = [], [], 0
        shift += 1
    some = np.flatnonzero(label != np.arange(len(fps)))
    return order[some], order[label[some]]


def _links(radius: int):
    """Rows sorted by unit of work; a unit may go on in the next batch, so its rows are carried over."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: list[np.ndarray] | None = None

        def edges(columns: list[np.ndarray]) -> pa.RecordBatch:
            fresh = np.any([c[1:] != c[:-1] for c in columns[:-1]], axis=0)
            x, y = linked(np.append(0, np.cumsum(fresh)), columns[-1].view(U), radius)
            return pa.record_batch([pa.array(columns[-1][x]), pa.array(columns[-1][y])], schema=schema)

        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            if carry is not None:
                columns = [np.concatenate(pair) for pair in zip(carry, columns)]
            if not len(columns[0]):
                continue
            fresh = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[:-1]], axis=0))
            last = int(fresh[-1]) + 1 if len(fresh) else 0
            carry = [c[last:].copy() for c in columns]
            if last:
                yield edges([c[:last] for c in columns])
        if carry is not None:
            yield edges(carry)

    return run


def links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK, agree: int | None = None) -> DataFrame:
    """Edges (u, v) that connect the distinct fingerprints ``fp`` as their links within ``radius`` bits do, whatever ``agree`` is."""
    if agree is None:
        n = fps.count()
        agree = 2 + sum(n >= least for least in WIDER)
    keys = F.array(*[F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(m if m < 1 << 63 else m - (1 << 64))).alias("part")) for i, m in enumerate(_masks(radius, agree))])
    filed = fps.select("fp", F.explode(keys).alias("k")).select("k.band", "k.part", "fp")
    counts = filed.groupBy("band", "part").agg(F.count("*").alias("_n")).where("_n > 1")
    filed = filed.join(counts, ["band", "part"]).withColumn("_b", F.ceil(F.col("_n") / block).cast("int"))
    own = F.pmod(F.xxhash64("fp", F.lit("block")), F.col("_b")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_b") - 1)).alias("_t")
    units = filed.withColumn("_s", own).select("band", "part", "fp", "_s", other)
    units = units.select("band", "part", F.least("_s", "_t").alias("i"), F.greatest("_s", "_t").alias("j"), "fp")
    units = units.repartition("band", "part", "i", "j").sortWithinPartitions("band", "part", "i", "j")
    return units.mapInArrow(_links(radius), "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges, the root being its component's smallest node."""
    edges, seen = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()), None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = stage(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def labelled(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """(doc_id, th, fp, root) of every row; th: hash of the text; root: the component's smallest fingerprint."""
    rows = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    rows = stage(rows.mapInArrow(_fingerprints(width), "doc_id long, th long, fp long"))
    roots = stage(components(links(stage(rows.select("fp").distinct()), radius)).withColumnRenamed("node", "fp"))
    return rows.join(roots, "fp", "left").select("doc_id", "th", "fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    rows = labelled(docs, width, radius)
    firsts = stage(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")))  # a table: the join can split a hot root
    return rows.join(firsts, "root").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def rows_of(docs: DataFrame, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """(row, id, th) of the rows of ``docs`` that are (or, with left_anti, are not) among the keys (id, th), whatever their columns are called."""
    keyed = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    return keyed.join(keys.distinct(), ["id", "th"], how)


def keep_one(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row of the smallest id stays (null ids come
    last; of equal ids the smallest text hash, of equal rows one)."""
    kept = labelled(docs, width, radius).groupBy("root").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "th")).alias("k"))
    return rows_of(docs, kept.select("k.id", "k.th")).dropDuplicates(["id", "th"]).select("row.*")
