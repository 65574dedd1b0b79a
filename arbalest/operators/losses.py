"""Values of training losses on given embeddings, and the learning-rate schedule."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbalest.operators.ranking import QUERY
from arbalest.operators.rerank import TARGET
from arbalest.operators.scoring import PAIR, POOL


def info_nce(scores: DataFrame, truth: DataFrame, temperature: float = 0.07) -> DataFrame:
    """Symmetric cross entropy of each pool's logits against its true pairs."""
    logits = scores.withColumn("_z", F.col("score") / temperature)

    def side(keys: list[str]) -> DataFrame:
        tops = logits.groupBy(*keys).agg(F.max("_z").alias("_m"))
        sums = logits.join(tops, keys).groupBy(*keys, "_m").agg(F.sum(F.exp(F.col("_z") - F.col("_m"))).alias("_s"))
        log_sums = sums.select(*keys, (F.col("_m") + F.log("_s")).alias("_l"))
        return logits.join(truth, PAIR).join(log_sums, keys).groupBy(*POOL).agg(F.avg(F.col("_l") - F.col("_z")).alias("_loss"))

    both = side(QUERY).withColumnRenamed("_loss", "_q").join(side(TARGET).withColumnRenamed("_loss", "_t"), POOL)
    return both.select(*POOL, F.round((F.col("_q") + F.col("_t")) / 2, 6).alias("loss"))


def triplet(scores: DataFrame, truth: DataFrame, negatives: DataFrame, margin: float = 0.2) -> DataFrame:
    """Mean hinge of (negative - positive + margin) by pool."""
    positive = scores.join(truth, PAIR).select(*QUERY, F.col("score").alias("_p"))
    rows = negatives.select(*QUERY, "score").join(positive, QUERY)
    return rows.groupBy(*POOL).agg(F.round(F.avg(F.greatest(F.col("score") - F.col("_p") + margin, F.lit(0.0))), 6).alias("loss"), F.count("*").alias("n_triplets"))


def binary_cross_entropy(scores: DataFrame, truth: DataFrame, scale: float = 1.0) -> DataFrame:
    """Mean over all pairs of a pool, with the true pairs as ones; scale * score are the logits."""
    z, y = F.col("score") * scale, F.col("_true").isNotNull().cast("double")
    marked = scores.join(truth.select(*PAIR, F.lit(True).alias("_true")), PAIR, "left")
    loss = F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))
    return marked.groupBy(*POOL).agg(F.round(F.avg(loss), 6).alias("loss"), F.count("*").alias("n_pairs"))


def warmup_cosine(epoch: Column, warmup: int, epochs: int) -> Column:
    progress = (epoch - warmup) / max(1, epochs - warmup)
    return F.when(epoch < warmup, (epoch + 1) / warmup).otherwise(0.5 * (1 + F.cos(F.lit(math.pi) * progress)))


def weighted_mean(rows: DataFrame, value: str, weight: str) -> DataFrame:
    return rows.agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"))
