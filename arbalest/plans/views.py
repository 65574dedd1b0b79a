"""The working view: retrieval pools derived from the ``embeddings`` table, in Spark and in SQL.

Even vectors are queries, odd ones targets, and vectors 2p and 2p + 1 belong together. A linked gallery mixes each target
with its query, so that rankings carry signal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbalest.functions import vectors as V
from arbalest.operators import block_scorers, blocks, scoring
from arbalest.operators.ranking import rank
from arbalest.operators.scoring import POOL

LINK = (0.6, 0.8)
SHAPE = (4, 4, 4)


def entities(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.floor(F.col("vec_id") / 2).alias("p"), V.doubles("embedding").alias("v"))
    split = F.when(F.floor(F.col("p") / 3) % 7 < 2, "val").otherwise("test")
    return rows.withColumns({"dataset": F.concat(F.lit("dataset"), (F.col("p") % 3 + 1).cast("string")), "split": split})


def _name(prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.lpad(F.col("p").cast("string"), 6, "0"))


def queries(spark: SparkSession, d: str) -> DataFrame:
    return entities(spark, d).where("vec_id % 2 = 0").select(*POOL, _name("q_").alias("query_id"), "p", F.col("v").alias("qv"))


def gallery(spark: SparkSession, d: str) -> DataFrame:
    return entities(spark, d).where("vec_id % 2 = 1").select(*POOL, _name("g_").alias("target_id"), "p", F.col("v").alias("tv"))


def linked(spark: SparkSession, d: str) -> DataFrame:
    both = gallery(spark, d).join(queries(spark, d).select("p", "qv"), "p")
    return both.select(*POOL, "target_id", "p", V.unit(V.combine("qv", "tv", *LINK)).alias("tv"))


def truth(spark: SparkSession, d: str) -> DataFrame:
    q, t = queries(spark, d).select(*POOL, "query_id", "p"), gallery(spark, d).select("target_id", "p")
    return q.join(t, "p").select(*POOL, "query_id", "target_id")


def scores(spark: SparkSession, d: str) -> DataFrame:
    return scoring.dot_scores(queries(spark, d), linked(spark, d))


def raw_scores(spark: SparkSession, d: str) -> DataFrame:
    return scoring.dot_scores(queries(spark, d), gallery(spark, d))


def scorer(spark: SparkSession, d: str) -> blocks.Scorer:
    """``scores`` as blocks, for results that need no row a pair."""
    return blocks.dot(queries(spark, d), linked(spark, d))


def raw_scorer(spark: SparkSession, d: str) -> blocks.Scorer:
    return blocks.dot(queries(spark, d), gallery(spark, d))


def true_ranks(spark: SparkSession, d: str) -> DataFrame:
    return block_scorers.true_ranks(queries(spark, d), linked(spark, d), truth(spark, d))


def ranked(spark: SparkSession, d: str) -> DataFrame:
    return rank(scores(spark, d))


def volumes(spark: SparkSession, d: str) -> DataFrame:
    """(id, vec) of 4x4x4 volumes, one for each vector."""
    return entities(spark, d).select(F.col("vec_id").alias("id"), F.col("v").alias("vec"))


def slices(rows: DataFrame, vector: str, name: str) -> DataFrame:
    """``rows`` with the vector as 4 normalised slices of 16."""
    return rows.withColumn(name, F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: V.unit(F.slice(vector, i * 16 + 1, 16))))


#: The same views as common table expressions; queries go on after it.
SQL = """
WITH e AS (
  SELECT vec_id, vec_id // 2 AS p, list_transform(embedding, lambda x: x::DOUBLE) AS v,
         'dataset' || (vec_id // 2 % 3 + 1)::VARCHAR AS dataset, CASE WHEN (vec_id // 2 // 3) % 7 < 2 THEN 'val' ELSE 'test' END AS split FROM embeddings),
q AS (SELECT dataset, split, 'q_' || lpad(p::VARCHAR, 6, '0') AS query_id, p, v AS qv FROM e WHERE vec_id % 2 = 0),
g AS (SELECT dataset, split, 'g_' || lpad(p::VARCHAR, 6, '0') AS target_id, p, v AS tv FROM e WHERE vec_id % 2 = 1),
lm AS (SELECT g.dataset, g.split, target_id, p, list_transform(range(1, len(tv) + 1), lambda i: 0.6::DOUBLE * qv[i] + 0.8::DOUBLE * tv[i]) AS m FROM g JOIN (SELECT p, qv FROM q) USING (p)),
lk AS (SELECT dataset, split, target_id, p, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS tv FROM lm),
truth AS (SELECT q.dataset, q.split, query_id, target_id FROM q JOIN (SELECT p, target_id FROM g) USING (p)),
s AS (SELECT dataset, split, query_id, target_id, list_dot_product(qv, tv) AS score FROM q JOIN lk USING (dataset, split)),
s0 AS (SELECT dataset, split, query_id, target_id, list_dot_product(qv, tv) AS score FROM q JOIN g USING (dataset, split)),
r AS (SELECT *, row_number() OVER (PARTITION BY dataset, split, query_id ORDER BY round(score, 9) DESC, target_id) AS rank FROM s),
r0 AS (SELECT *, row_number() OVER (PARTITION BY dataset, split, query_id ORDER BY round(score, 9) DESC, target_id) AS rank FROM s0),
tr AS (SELECT truth.*, r.rank FROM truth LEFT JOIN r USING (dataset, split, query_id, target_id)),
sub AS (SELECT dataset, split, query_id, string_agg(target_id, ' ' ORDER BY rank) AS target_id_ranking FROM r GROUP BY dataset, split, query_id),
vox AS (SELECT id, (i // 16)::INT AS x, (i // 4 % 4)::INT AS y, (i % 4)::INT AS z, value FROM (SELECT vec_id AS id, unnest(v) AS value, unnest(range(64)) AS i FROM e))
"""
