"""Aggregation of slice or view vectors to one vector for each entity, with map-side partial sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbalest.functions import vectors as V


def pooled(rows: DataFrame, keys: list[str], vector: str, **how) -> DataFrame:
    """Component-wise aggregates of ``vector`` by ``keys``; ``how`` maps names to aggregate functions of a column."""
    parts = rows.select(*keys, F.posexplode(vector).alias("_i", "_x")).groupBy(*keys, "_i").agg(*[f("_x").alias(n) for n, f in how.items()])
    ordered = lambda n: F.transform(F.sort_array(F.collect_list(F.struct("_i", n))), lambda s: s[n])
    lists = [ordered(n).alias(n) for n in how]
    return parts.groupBy(*keys).agg(*lists)


def mean_pool(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Mean vector, normalised."""
    return pooled(rows, keys, vector, _mean=F.avg).select(*keys, V.unit("_mean").alias("vec"))


def mean_max(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Mean and maximum, concatenated."""
    return pooled(rows, keys, vector, _mean=F.avg, _max=F.max).select(*keys, F.concat("_mean", "_max").alias("vec"))


def project(vector: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """One linear layer: rows of ``weights`` are outputs."""
    rows = [V.dot(vector, F.array(*[F.lit(float(x)) for x in row])) + F.lit(float(b)) for row, b in zip(weights, bias)]
    return F.array(*rows)


def gelu(vector: Column) -> Column:
    """Gaussian error linear unit, tanh form."""
    return F.transform(vector, lambda x: 0.5 * x * (1 + F.tanh(0.7978845608028654 * (x + 0.044715 * x * x * x))))
