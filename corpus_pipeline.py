"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of ``documents``, under
whatever names and in their order; columns beside doc_id, text, lang and source are carried and never read. In every stage rows
with null ids, repeated rows and texts of any length take part, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbalest.llm import decontamination, language_id, mixing, sharding, shingle_dedup, simhash
from arbalest.llm.common import fresh_path, id_remainder, remove

SHARDS = 16


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found with enough margin stay; dictionaries come from two thirds of the ids. Texts that
    are null or without a letter go; a null ``lang`` is not learned from; of languages that compress alike the first in code
    point order wins, with margin 0, so the document goes."""
    return language_id.keep_identified(docs, language_id.fit(docs.where(id_remainder(3) != 1)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Candidates are the SimHash components of ``op10`` (4 of 64 bits) and, for copies further apart, MinHash buckets; an exact check
    follows. One document of each component of five-word shingle similarity 0.8 or more stays, that of the smallest id (null ids
    last, then the smallest text hash; of repeated rows one). Null texts and texts without words are copies of each other."""
    alike = simhash.labelled(docs).select("doc_id", "th", F.col("root").alias("key"))
    return shingle_dedup.keep_one(docs, alike)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or with other slot values, go. Null texts, and an empty benchmark, lose
    nothing; repeated rows share their fate."""
    return decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, range-sorted by training position (ties by digest). A null source is a source;
    documents without words are never taken."""
    return mixing.curriculum(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each row; a null id counts as 0, repeated rows get slots of their own in one shard."""
    return sharding.shard(docs, SHARDS)


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix_sources),
    ("sharding", shard),
]

#: Compression and fingerprints have no SQL form; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet to the shared folder and read again, and goes when the
    next one is written. Nulls, ties, repeated rows, empty tables and further columns: as each stage says."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, step in STAGES:
        path = fresh_path(spark, "pipeline")
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
