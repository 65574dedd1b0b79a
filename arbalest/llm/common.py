"""Helpers that several corpus operators share: staged tables, batch sizes and key expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbalest.sources.staging import BATCH_BYTES, fresh_path, in_small_batches, numbered, remove, stage, stage_and_free

__all__ = ["BATCH_BYTES", "WORD", "documents", "fresh_path", "free_name", "id_remainder", "id_text", "in_small_batches", "lower_ascii", "numbered", "remove", "stage", "stage_and_free", "utf8_size"]

WORD = r"[^\x20\x09-\x0D]+"


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def id_text(col: str = "doc_id") -> Column:
    """An id as text; a null id counts as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def id_remainder(n: int, col: str = "doc_id") -> Column:
    """crc32(id as text) mod n, the fold rule of the query contracts."""
    return F.crc32(id_text(col)) % n


def utf8_size(col: str = "text") -> Column:
    return F.coalesce(F.octet_length(F.col(col)), F.lit(0)).cast("long")


def lower_ascii(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
