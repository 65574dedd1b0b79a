"""Jump consistent hashing: shards without a ring table.

Contract of ``shard``:
* a row's shard depends on its id and the shard count alone; going from n to n+1 shards moves rows only
  into shard n, about one row in n+1;
* null ids take the key 0; null texts count as empty (size 1, crc32 0); repeated rows are all kept, in the
  same shard, each with a slot of its own; an empty table gives an empty result; extra columns are ignored;
* slots run from 0 without gaps in each shard, in the order (digest bucket, id, crc, size).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbalest.llm.common import id_text, utf8_size

#: Fixed multiplier of the published jump consistent hash.
JUMP_MULTIPLIER = 2862933555777941757
#: Hex digits of the digest that forms the slot buckets: 16**3 buckets a shard.
BUCKET_DIGITS = 3


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key, for all keys at once."""
    key = keys.astype(np.uint64)
    b = np.zeros(len(key), np.int64)
    j = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        b[live] = j[live]
        key[live] = key[live] * np.uint64(JUMP_MULTIPLIER) + np.uint64(1)
        j[live] = ((b[live] + 1) * (2.0**31 / ((key[live] >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
        live = live[j[live] < shards]
    return b


def assign(docs: DataFrame, shards: int) -> DataFrame:
    """``docs`` with ``shard`` (of ``shards``) and ``grown_shard`` (of one more); no shuffle."""

    @F.pandas_udf("shard int, grown_shard int")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for ids in batches:
            keys = ids.to_numpy(np.int64)
            yield pd.DataFrame({"shard": jump_hash(keys, shards), "grown_shard": jump_hash(keys, shards + 1)}, dtype="int32")

    return docs.withColumn("_jump", both(F.coalesce(F.col("doc_id"), F.lit(0)).cast("long"))).withColumns(
        {"shard": F.col("_jump.shard"), "grown_shard": F.col("_jump.grown_shard")}
    ).drop("_jump")


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Shard, slot and size of each document.

    Only (id, size, crc) rows are shuffled, once, by (shard, digest bucket); slots come from per-bucket counts
    (shards x 4096 rows at most) and a window inside each bucket, so that no task holds a whole shard.
    """
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (utf8_size() + 1).alias("size"), crc.alias("text_crc32"))
    digest = F.substring(F.md5(F.concat(id_text(), F.lit(":"), F.col("text_crc32").cast("string"))), 1, BUCKET_DIGITS)
    rows = assign(rows, shards).withColumn("_bucket", digest)
    counts = rows.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_first"))
    within = Window.partitionBy("shard", "_bucket").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("_row", F.row_number().over(within))
        .join(firsts.hint("merge"), ["shard", "_bucket"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
            (F.col("_first") + F.col("_row") - 1).cast("long").alias("slot"), "grown_shard",
        )
    )
