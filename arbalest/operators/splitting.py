"""Seeded splits, shards and derangements. Orders come from salted hashes, never from a driver-side shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbalest.functions.text import hash_order
from arbalest.sources import staging

HEAD_DIGITS = 4


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``row_no`` from 0 in the given order of unique keys, by a range sort and the partitions' counts."""
    return staging.numbered(rows.repartitionByRange(*order).sortWithinPartitions(*order))


def _smallest(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows of smallest hex hash ``_h``. Counts by its first digits find the bucket of the n-th; that bucket alone is sorted."""
    head = F.substring("_h", 1, HEAD_DIGITS)
    held, last, before = 0, "", 0
    for r in sorted(rows.groupBy(head.alias("k")).agg(F.count("*").alias("n")).collect(), key=lambda r: r.k):  # 16**HEAD_DIGITS rows at most
        held, last, before = held + r.n, r.k, held
        if held >= n:
            break
    rest = rows.where(head == last).orderBy("_h").limit(max(n - before, 0))
    return rows.where(head < last).unionByName(rest)


def hold_out(pairs: DataFrame, n: int, seed: int, key: str = "pair_id") -> DataFrame:
    """``pairs`` with ``held_out``: true for the n pairs whose salted hashes are smallest; 0 < n < all pairs."""
    total = pairs.count()
    if not 0 < n < total:
        raise ValueError(f"hold-out of {n} from {total}")
    shuffled = pairs.withColumn("_h", hash_order(seed, F.col(key).cast("string")))
    last = _smallest(shuffled.select("_h"), n).agg(F.max("_h")).first()[0]
    return shuffled.withColumn("held_out", F.col("_h") <= last).drop("_h")


def round_robin(queries: DataFrame, shards: int, key: str = "query_id") -> DataFrame:
    """``shard`` = place in the sorted list mod ``shards``, from 1."""
    return numbered(queries, key).withColumn("shard", (F.col("row_no") % shards + 1).cast("int")).drop("row_no")


def derangement(pairs: DataFrame, seed: int) -> DataFrame:
    """A wrong partner for each pair (query_id, target_id): the next pair's target in a seeded cyclic order."""
    order = numbered(pairs.withColumn("_h", hash_order(seed, F.col("query_id"))), "_h").drop("_h")
    n = order.agg(F.max("row_no") + 1).first()[0] or 1
    nexts = order.select(F.pmod(F.col("row_no") - 1, F.lit(n)).alias("row_no"), F.col("target_id").alias("wrong_id"))
    return order.join(nexts, "row_no").drop("row_no")


def seeded_sample(rows: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    return _smallest(rows.withColumn("_h", hash_order(seed, F.col(key).cast("string"))), n).drop("_h")


def view_pairs(pairs: DataFrame, views: int) -> DataFrame:
    """All combinations of query and target views of each pair."""
    every = F.sequence(F.lit(0), F.lit(views - 1))
    return pairs.withColumn("query_view", F.explode(every)).withColumn("target_view", F.explode(every))
