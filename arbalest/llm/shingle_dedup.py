"""Near-duplicates by overlap of word shingles: Jaccard similarity ``SIMILAR`` or more.

At similarity 0.8 two 64-bit SimHash fingerprints lie ten bits apart on average, and a radius that wide has no selective
pigeonhole keys. So candidates come from MinHash: ``BANDS`` keys of ``ROWS`` minima each; a pair of similarity 0.8 shares
none of them with probability 0.0004. Every candidate is verified by the overlap of the shingle sets, as sets of 64-bit hashes under
a secret key of the job: texts cannot be made to collide, and by chance two shingles do with probability 2^-62 or so. In
each bucket all members are first held against one hub, in linear work. Where buckets still hold several components, the members
outside a bucket's largest component (the strays) are held against that whole component and against each other, exactly: blocks of
``BLOCK`` sets meet inside a task, which counts overlaps through an inverted index and gives at most one link for each stray and
component, so that no pair of texts is ever a row.

Contract of ``keep_one``:
* A-Z are lower-cased; shingles are the distinct runs of ``WIDTH`` words (words: runs of anything but space and
  \\x09-\\x0D); fewer words form one shingle; texts without words, or null, are copies of each other;
* texts are linked if their shingle sets have a Jaccard similarity of at least 0.8; of each component one row stays, that of the
  smallest id (null ids come last; of equal ids the smallest text hash, of equal rows one); extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbalest.llm import kernels as K
from arbalest.llm.common import in_small_batches, stage
from arbalest.llm.simhash import components, rows_of

U = np.uint64
WIDTH, BANDS, ROWS = 5, 20, 5
#: Similarity as a fraction: i common shingles of a and b ones suffice if i (4 + 5) >= 4 (a + b).
SIMILAR = (4, 5)
FACTORS = K.mix(np.arange(1, BANDS * ROWS + 1, dtype=U)) | U(1)
NO_ID = (1 << 63) - 1
BLOCK = 256


def shingles(data: np.ndarray, places: np.ndarray, width: int = WIDTH, key: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, count of each text) of the distinct shingles; a text without words has one shingle of its own kind."""
    low = K.LOWER[data]
    starts, ends, counts = K.words(low, places)
    firsts = np.cumsum(counts) - counts
    size = np.minimum(counts, width)
    many = counts - size + 1
    owner = np.repeat(np.arange(len(counts)), many)
    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + firsts[owner]
    value = K.word_hashes(low, starts, ends, key) if len(starts) else np.zeros(0, U)
    found = K.Ranges(value).of(at, at + size[owner])
    order = np.lexsort((found, owner))
    owner, found = owner[order], found[order]
    fresh = np.append(True, (owner[1:] != owner[:-1]) | (found[1:] != found[:-1]))
    return found[fresh], np.bincount(owner[fresh], minlength=len(counts))


def signatures(found: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(name of each shingle set, its band keys)."""
    firsts = np.cumsum(counts) - counts
    names = K.mix(np.add.reduceat(K.mix(found), firsts) + counts.astype(U))
    keys = np.empty((len(counts), BANDS), U)
    for band in range(BANDS):
        key = np.full(len(counts), U(band))
        for factor in FACTORS[band * ROWS : (band + 1) * ROWS]:
            key = K.mix(key + np.minimum.reduceat(found * factor, firsts))
        keys[:, band] = key
    return names, keys


def _signed(key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, places in K.slices(batch["text"]):
                found, counts = shingles(data, places, key=key)
                names, keys = signatures(found, counts)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), K.signed(keys.ravel()))
                yield pa.record_batch([batch["doc_id"][row:end], batch["th"][row:end], K.signed(names), pa.array(counts.astype(np.int32)), lists], ["doc_id", "th", "node", "n", "bands"])

    return run


def _sets(key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, places in K.slices(batch["text"]):
                found, counts = shingles(data, places, key=key)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), K.signed(found))
                yield pa.record_batch([batch["node"][row:end], lists], ["node", "set"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose shingle sets overlap enough."""
    both = pairs.join(sets.select(F.col("node").alias("v"), F.col("set").alias("y")), "v").join(sets.select(F.col("node").alias("u"), F.col("set").alias("x")), "u")
    a, b = SIMILAR
    return both.where(F.size(F.array_intersect("x", "y")) * (a + b) >= a * (F.size("x") + F.size("y"))).select("u", "v")


def _alike(m: str, n: str):
    """Sets of these sizes can be similar enough."""
    return F.least(m, n) * SIMILAR[1] >= F.greatest(m, n) * SIMILAR[0]


def labelled(docs: DataFrame, also: DataFrame | None = None) -> DataFrame:
    """(doc_id, th, root) of every row; th: hash of the text; root: the component's smallest shingle set. ``also`` files rows (doc_id, th) under
    further keys (key), as components of another method; their pairs are verified like any other."""
    keyed = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    secret = K.fresh_key()
    rows = stage(keyed.mapInArrow(_signed(secret), "doc_id long, th long, node long, n int, bands array<long>"))
    filed = rows.dropDuplicates(["node"]).select("node", "n", F.explode("bands").alias("key"))  # a band's number is part of its keys
    if also is not None:
        ids = lambda rows: rows.withColumn("_id", F.coalesce("doc_id", F.lit(NO_ID)))
        keys = ids(also).select("_id", "th", F.xxhash64(F.lit("also"), "key").alias("key")).distinct()
        filed = filed.unionByName(ids(rows).join(keys, ["_id", "th"]).select("node", "n", "key").distinct())
    hubs = filed.groupBy("key").agg(F.min(F.struct("node", "n")).alias("hub"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    filed = stage(filed.join(hubs, "key").select("key", "node", "n", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n")))
    # texts of the sets in shared buckets, one for each set
    firsts = rows.groupBy("node").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), "th")).alias("k"))  # before the join: a set may have many copies
    wanted = firsts.join(filed.select("node").distinct(), "node", "left_semi")
    texts = keyed.withColumn("_id", F.coalesce("doc_id", F.lit(NO_ID))).join(wanted.select("node", "k._id", "k.th"), ["_id", "th"])
    sets = stage(texts.select("node", "text").mapInArrow(_sets(secret), "node long, set array<long>").dropDuplicates(["node"]))
    stars = filed.where((F.col("hub") != F.col("node")) & _alike("n", "hub_n")).select(F.col("hub").alias("u"), F.col("node").alias("v")).distinct()
    edges = stage(_verified(stars, sets))
    found = components(edges)
    roots = stage(filed.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root")))
    parts = filed.select("key", "node").join(roots, "node").groupBy("key", "root").agg(F.count("*").alias("c"))
    mixed = parts.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("largest"), F.count("*").alias("_n")).where("_n > 1").select("key", "largest")
    strays = filed.select("key", "node").join(stage(mixed), "key").join(roots, "node").where("root <> largest").select("largest", "node", "root").distinct()
    roots, _ = _merged(roots, _across(stage(strays), roots, sets))
    return rows.select("doc_id", "th", "node").join(roots, "node", "left").select("doc_id", "th", F.coalesce("root", "node").alias("root"))


def _across(strays: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) of strays (largest, node, root) with the members of that component and with each other."""
    if strays.isEmpty():
        return strays.select(F.col("node").alias("u"), F.col("root").alias("v"))
    asked = strays.select("largest").distinct()
    held = roots.join(asked, F.col("root") == F.col("largest")).select("largest", "node", "root").unionByName(strays)
    block = lambda n: F.pmod(F.xxhash64("node", F.lit("block")), F.col(n)).cast("int")
    counts = lambda rows, n: rows.groupBy("largest").agg(F.ceil(F.count("*") / BLOCK).alias(n))
    n_held, n_strays = stage(counts(held, "_h")), stage(counts(strays, "_s"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    left = strays.join(n_held, "largest").join(n_strays, "largest").withColumn("j", block("_s")).withColumn("i", every("_h")).withColumn("stray", F.lit(True))
    right = held.join(n_held, "largest").join(n_strays, "largest").withColumn("i", block("_h")).withColumn("j", every("_s")).withColumn("stray", F.lit(False))
    units = left.select("largest", "i", "j", "stray", "node", "root").unionByName(right.select("largest", "i", "j", "stray", "node", "root"))
    units = units.join(sets, "node").select("largest", "i", "j", "stray", "node", "root", "set")
    return units.repartition("largest", "i", "j").sortWithinPartitions("largest", "i", "j").mapInArrow(_unit_links, "u long, v long").distinct()


def _unit_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by unit of work; a unit may go on in the next batch, so its rows are carried over."""
    carry: list[pa.RecordBatch] = []
    unit = None

    def links() -> pa.RecordBatch:
        rows = pa.Table.from_batches(carry)
        stray = rows["stray"].combine_chunks().to_numpy(zero_copy_only=False)
        node, root, found = (rows[c].combine_chunks() for c in ("node", "root", "set"))
        return pa.record_batch([pa.array(x, pa.int64()) for x in overlaps(node.to_numpy(), root.to_numpy(), found, np.flatnonzero(stray), np.flatnonzero(~stray))], ["u", "v"])

    for batch in batches:
        names = [batch[c].to_numpy() for c in ("largest", "i", "j")]
        edges = np.append(0, np.flatnonzero(np.any([c[1:] != c[:-1] for c in names], axis=0)) + 1) if batch.num_rows else []
        for lo, hi in zip(edges, np.append(edges[1:], batch.num_rows).astype(int)):
            now = tuple(int(c[lo]) for c in names)
            if carry and now != unit:
                yield links()
                carry = []
            unit = now
            carry.append(batch.slice(int(lo), int(hi - lo)))
    if carry:
        yield links()


def overlaps(node: np.ndarray, root: np.ndarray, sets: pa.Array, strays: np.ndarray, others: np.ndarray) -> tuple[list[int], list[int]]:
    """(stray, other) links, one for each stray and component of the others."""
    sizes = sets.value_lengths().to_numpy()
    values, firsts = sets.flatten().to_numpy(), np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(others)), sizes[others])
    filed = np.concatenate([values[firsts[k] : firsts[k] + sizes[k]] for k in others]) if len(others) else np.zeros(0, np.int64)
    order = np.argsort(filed, kind="stable")
    filed, owner = filed[order], owner[order]
    a, b = SIMILAR
    us, vs = [], []
    for k in strays:
        mine = values[firsts[k] : firsts[k] + sizes[k]]
        lo, hi = np.searchsorted(filed, mine, "left"), np.searchsorted(filed, mine, "right")
        n = hi - lo
        take = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        common = np.bincount(owner[take], minlength=len(others))
        alike = np.flatnonzero((common * (a + b) >= a * (sizes[k] + sizes[others])) & (root[others] != root[k]))
        _, one = np.unique(root[others[alike]], return_index=True)
        us += [int(node[k])] * len(one)
        vs += node[others[alike[one]]].tolist()
    return us, vs


def _merged(roots: DataFrame, links: DataFrame) -> tuple[DataFrame, bool]:
    """(node, root) after the links (u, v), and whether there were any. Only roots are joined up, not all nodes again."""
    if links.isEmpty():
        return roots, False
    side = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    between = links.join(side("u"), "u").join(side("v"), "v").select(F.col("u_root").alias("u"), F.col("v_root").alias("v")).distinct()
    found = components(between).select(F.col("node").alias("root"), F.col("root").alias("least"))
    return stage(roots.join(found, "root", "left").select("node", F.coalesce("least", "root").alias("root"))), True


def keep_one(docs: DataFrame, also: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` without near-duplicates."""
    kept = labelled(docs, also).groupBy("root").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "th")).alias("k"))
    return rows_of(docs, kept.select("k.id", "k.th")).dropDuplicates(["id", "th"]).select("row.*")
