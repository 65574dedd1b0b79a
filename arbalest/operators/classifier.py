"""Pair probability: a multilayer perceptron on the products and distances of both sides' components, each scaled to unit
deviation, trained on true pairs and wrong partners.

Wrong partners are the targets of the next ``negatives`` pairs in a seeded cyclic order, as other pairs of one batch would be; no
square of pairs is formed. Training and prediction are Spark ML on the executors, the model is weights alone.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbalest.functions import vectors as V
from arbalest.functions.text import hash_order
from arbalest.operators.scoring import PAIR, pairs
from arbalest.operators.splitting import numbered

NEGATIVES, HIDDEN, ROUNDS, SEED = 7, (16,), 60, 2026


def labelled_pairs(linked: DataFrame, negatives: int = NEGATIVES, seed: int = SEED) -> DataFrame:
    """(query_id, qv, tv, label) from true pairs (query_id, target_id, qv, tv). With n pairs at most n - 1 wrong partners."""
    order = numbered(linked.withColumn("_h", hash_order(seed, F.concat_ws(" ", "query_id", "target_id"))), "_h").drop("_h")
    n = order.count()
    if n < 2:
        raise ValueError(f"{n} pairs leave no wrong partner")
    shifts = F.explode(F.sequence(F.lit(0), F.lit(min(negatives, n - 1))))
    sides = order.select("query_id", "target_id", "qv", "row_no", shifts.alias("shift")).withColumn("row_no", F.pmod(F.col("row_no") + F.col("shift"), F.lit(n)))
    others = order.select("row_no", F.col("target_id").alias("other_id"), "tv")
    rows = sides.join(others, "row_no").where((F.col("shift") == 0) | (F.col("target_id") != F.col("other_id")))
    return rows.select("query_id", "qv", "tv", (F.col("shift") == 0).cast("double").alias("label"))


def _features(rows: DataFrame) -> DataFrame:
    q, t = V.doubles("qv"), V.doubles("tv")
    both = F.concat(F.zip_with(q, t, lambda x, y: x * y), F.zip_with(q, t, lambda x, y: F.abs(x - y)))
    return rows.withColumn("raw", array_to_vector(both))


def fit(linked: DataFrame, negatives: int = NEGATIVES, hidden: tuple[int, ...] = HIDDEN, rounds: int = ROUNDS, seed: int = SEED) -> PipelineModel:
    rows = _features(labelled_pairs(linked, negatives, seed)).select("raw", "label")
    width = rows.select(F.max(F.size(vector_to_array("raw")))).first()[0]
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True)
    return Pipeline(stages=[scaler, MultilayerPerceptronClassifier(layers=[width, *hidden, 2], maxIter=rounds, seed=seed)]).fit(rows)


def probability_scores(queries: DataFrame, gallery: DataFrame, model: PipelineModel) -> DataFrame:
    """Every query against its pool's gallery, scored by the probability that they belong together."""
    rows = model.transform(_features(pairs(queries, gallery)))
    return rows.select(*PAIR, vector_to_array("probability")[1].alias("score"))
