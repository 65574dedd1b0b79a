"""Fusion of several rankings or score frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbalest.operators.ranking import rank
from arbalest.operators.rerank import scaled
from arbalest.operators.scoring import PAIR


def reciprocal_rank_fusion(rankings: list[tuple[DataFrame, float]], k: float = 60.0) -> DataFrame:
    """Sum over rankings of weight / (k + rank)."""
    parts = [r.select(*PAIR, (F.lit(float(w)) / (F.lit(k) + F.col("rank"))).alias("score")) for r, w in rankings]
    return reduce(DataFrame.unionByName, parts).groupBy(*PAIR).agg(F.sum("score").alias("score"))


def weighted_ensemble(a: DataFrame, b: DataFrame, weight: float, datasets: tuple[str, ...]) -> DataFrame:
    """weight * min-max(a) + (1 - weight) * min-max(b) in the named datasets; b elsewhere."""
    both = a.select(*PAIR, F.col("score").alias("_a")).join(b.select(*PAIR, F.col("score").alias("_b")), PAIR)
    mixed = F.lit(weight) * scaled("_a") + F.lit(1 - weight) * scaled("_b")
    return both.select(*PAIR, F.when(F.col("dataset").isin(*datasets), mixed).otherwise(F.col("_b")).alias("score"))


def rank_ensemble(a: DataFrame, b: DataFrame, weight: float = 0.5) -> DataFrame:
    """Weighted reciprocal ranks; a target that one ranking lacks gets 0 from it."""
    both = a.select(*PAIR, F.col("rank").alias("_a")).join(b.select(*PAIR, F.col("rank").alias("_b")), PAIR, "full_outer")
    share = lambda c, w: F.lit(w) * F.coalesce(1.0 / F.col(c), F.lit(0.0))
    return both.select(*PAIR, (share("_a", weight) + share("_b", 1 - weight)).alias("score"))


def pseudo_pairs(scores: DataFrame, least: float, datasets: tuple[str, ...]) -> DataFrame:
    """Best targets with a score of ``least`` or more, as training pairs."""
    return rank(scores, 1).where((F.round("score", 9) >= least) & F.col("dataset").isin(*datasets)).drop("rank")


def hard_negatives(scores: DataFrame, truth: DataFrame, k: int = 3) -> DataFrame:
    """Each query's best ``k`` targets that are not its own."""
    return rank(scores.join(truth.select(*PAIR), PAIR, "left_anti"), k)

