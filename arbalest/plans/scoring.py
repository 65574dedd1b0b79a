"""Queries on pair scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbalest.functions import vectors as V
from arbalest.operators import block_scorers, blocks, classifier, evaluation, ranking, scoring
from arbalest.operators.scoring import POOL
from arbalest.plans import views
from arbalest.plans.catalogue import query
from arbalest.plans.views import SQL

RANK = "row_number() OVER (PARTITION BY dataset, split, query_id ORDER BY round(score, 9) DESC, target_id)"
BINS = 8


def shown(scores: DataFrame | blocks.Scorer, k: int = 5) -> DataFrame:
    """The ``k`` best of each query, from a scorer by blocks."""
    best = blocks.best(scores, k) if isinstance(scores, blocks.Scorer) else ranking.rank(scores, k)
    return best.select(*scoring.PAIR, F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def top(scores: str, k: int = 5) -> str:
    """SQL for ``shown`` over a scores relation."""
    return f" SELECT dataset, split, query_id, target_id, round(score, 6) AS score, rank FROM (SELECT *, {RANK} AS rank FROM {scores}) WHERE rank <= {k}"


def affine_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The first 16 components as affines, and shapes from two of them."""
    shape = lambda v: F.array(*[F.floor(F.abs(F.col(v)[i]) * 100).cast("int") for i in (0, 1, 2)])
    q = views.queries(spark, d).select(*POOL, "query_id", F.slice("qv", 1, 16).alias("qa"), shape("qv").alias("qs"))
    t = views.linked(spark, d).select(*POOL, "target_id", F.slice("tv", 1, 16).alias("ta"), shape("tv").alias("ts"))
    return q, t


AFFINE = SQL + """, fs AS (SELECT dataset, split, query_id, target_id, -sqrt(list_sum(list_transform(range(1, 17), lambda i: (qv[i] - tv[i]) * (qv[i] - tv[i])))) AS score FROM q JOIN lk USING (dataset, split))
"""


@query(SQL + ", n AS (SELECT dataset, split, query_id, list_transform(qv, lambda x: x / greatest(sqrt(list_dot_product(qv, qv)), 0.000001::DOUBLE)) AS a FROM q), m AS (SELECT dataset, split, target_id, list_transform(tv, lambda x: x / greatest(sqrt(list_dot_product(tv, tv)), 0.000001::DOUBLE)) AS b FROM g), c AS (SELECT dataset, split, query_id, target_id, list_dot_product(a, b) AS score FROM n JOIN m USING (dataset, split))" + top("c"))
def cosine_raw_topk(spark, d):
    return shown(block_scorers.cosine(views.queries(spark, d), views.gallery(spark, d)))


@query(SQL + top("s", 10))
def block_cosine_topk(spark, d):
    got = scoring.block_dot_scores(views.queries(spark, d), views.linked(spark, d), 10)
    return got.select(*scoring.PAIR, F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(AFFINE + top("fs", 1))
def frobenius_argmin(spark, d):
    return shown(block_scorers.affine(*affine_sides(spark, d)), 1)


@query(SQL + """, gs AS (SELECT dataset, split, query_id, target_id,
  -(list_sum(list_transform(range(1, 4), lambda i: abs(floor(abs(qv[i]) * 100) - floor(abs(tv[i]) * 100)))) + list_sum(list_transform(range(1, 17), lambda i: abs(round(qv[i], 4) - round(tv[i], 4))))) AS score FROM q JOIN lk USING (dataset, split))""" + top("gs"))  # fmt: skip
def geometry_l1_rank(spark, d):
    return shown(block_scorers.geometry(*affine_sides(spark, d)))


@query(SQL + "SELECT dataset, split, count(*) FILTER (floor(abs(qv[1]) * 100) = floor(abs(tv[1]) * 100) AND floor(abs(qv[2]) * 100) = floor(abs(tv[2]) * 100) AND floor(abs(qv[3]) * 100) = floor(abs(tv[3]) * 100)) AS n_same FROM q JOIN lk USING (dataset, split) GROUP BY ALL")
def shape_equality(spark, d):
    return scoring.shape_equal(*affine_sides(spark, d)).groupBy(*POOL).agg(F.count_if("same_shape").alias("n_same"))


@query(AFFINE + f""", o AS (SELECT *, {RANK} AS rank FROM fs), b AS (SELECT dataset, split, query_id, -max(score) FILTER (rank = 1) AS best, max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2) AS gap, max(target_id) FILTER (rank = 1) AS t FROM o GROUP BY ALL),
c AS (SELECT dataset, split, round(min(best), 6) AS best_min, round(quantile_cont(best, 0.5), 6) AS best_median, round(max(best), 6) AS best_max, round(min(gap), 6) AS gap_min, round(quantile_cont(gap, 0.5), 6) AS gap_median, round(max(gap), 6) AS gap_max,
  count(*) FILTER (best < 0.001) AS near_zero, count(*) FILTER (gap > 0.01) AS wide_gap, count(*) AS n_queries, count(DISTINCT t) AS chosen FROM b GROUP BY ALL),
n AS (SELECT dataset, split, count(*) AS n_targets FROM g GROUP BY ALL)
SELECT c.* EXCLUDE (chosen), chosen = n_queries AND n_queries = n_targets AS is_bijection, chosen = n_queries AND n_queries = n_targets AND near_zero >= 0.9 * n_queries AND wide_gap >= 0.9 * n_queries AS is_leak FROM c JOIN n USING (dataset, split)""")  # fmt: skip
def nn_gap_summary(spark, d):
    return evaluation.gap_summary(block_scorers.affine(*affine_sides(spark, d)))


def digit_sql(source: str, name: str, vector: str, bins: int = BINS) -> str:
    keys = f"dataset, split, {source}"
    return (
        f"{name} AS (SELECT {keys}, list_transform(v, lambda x: CASE WHEN x > 0 THEN (CASE WHEN hi > lo THEN round_even((x - lo) / (hi - lo) * {bins - 1}, 0) ELSE 0 END)::INT END) AS d FROM "
        f"(SELECT {keys}, {vector} AS v, list_min(list_filter({vector}, lambda x: x > 0)) AS lo, list_max(list_filter({vector}, lambda x: x > 0)) AS hi FROM {'q' if source == 'query_id' else 'lk'}))"
    )


@query(SQL + ", " + digit_sql("query_id", "dq", "qv") + " SELECT dataset, split, query_id, bin, count(*) AS n FROM (SELECT dataset, split, query_id, unnest(d) AS bin FROM dq) WHERE bin IS NOT NULL GROUP BY ALL")
def digitize_hist(spark, d):
    rows = views.queries(spark, d).select(*POOL, "query_id", F.explode(scoring.digitize("qv", BINS)).alias("bin"))
    return rows.where("bin is not null").groupBy(*POOL, "query_id", "bin").agg(F.count("*").alias("n"))


JOINT = """
h1 AS (SELECT dataset, split, query_id, target_id, c, count(*) AS n FROM jt GROUP BY ALL),
tot AS (SELECT dataset, split, query_id, target_id, sum(n) AS t, -sum(n / t0 * ln(n / t0)) AS hab FROM (SELECT *, (sum(n) OVER (PARTITION BY dataset, split, query_id, target_id))::DOUBLE AS t0 FROM h1) GROUP BY ALL),
ha AS (SELECT dataset, split, query_id, target_id, -sum(n / t * ln(n / t)) AS h FROM (SELECT *, (sum(n) OVER (PARTITION BY dataset, split, query_id, target_id))::DOUBLE AS t FROM (SELECT dataset, split, query_id, target_id, c // {bins} AS a, sum(n) AS n FROM h1 GROUP BY ALL)) GROUP BY ALL),
hb AS (SELECT dataset, split, query_id, target_id, -sum(n / t * ln(n / t)) AS h FROM (SELECT *, (sum(n) OVER (PARTITION BY dataset, split, query_id, target_id))::DOUBLE AS t FROM (SELECT dataset, split, query_id, target_id, c % {bins} AS b, sum(n) AS n FROM h1 GROUP BY ALL)) GROUP BY ALL),
"""


@query(SQL + ", " + digit_sql("query_id", "dq", "qv") + ", " + digit_sql("target_id", "dt", "tv") + f""",
jt AS (SELECT dataset, split, query_id, target_id, unnest(list_filter(list_transform(range(1, 65), lambda i: a.d[i] * {BINS} + b.d[i]), lambda x: x IS NOT NULL)) AS c FROM dq a JOIN dt b USING (dataset, split)),
{JOINT.format(bins=BINS)}
ns AS (SELECT dataset, split, query_id, target_id, CASE WHEN coalesce(t, 0) < 2 THEN 1.0::DOUBLE WHEN hab < 1e-12 THEN 2.0 ELSE (ha.h + hb.h) / hab END AS score
  FROM s LEFT JOIN tot USING (dataset, split, query_id, target_id) LEFT JOIN ha USING (dataset, split, query_id, target_id) LEFT JOIN hb USING (dataset, split, query_id, target_id))""" + top("ns"))  # fmt: skip
def nmi_rank(spark, d):
    return shown(block_scorers.nmi(views.queries(spark, d), views.linked(spark, d), BINS))


@query(SQL + ", " + digit_sql("query_id", "dq", "qv") + ", " + digit_sql("target_id", "dt", "tv") + f""",
jt AS (SELECT dataset, split, query_id, target_id, unnest(list_filter(list_transform(range(1, 65), lambda i: a.d[i] * {BINS} + b.d[i]), lambda x: x IS NOT NULL)) AS c FROM dq a JOIN dt b USING (dataset, split)),
{JOINT.format(bins=BINS)}
ns AS (SELECT dataset, split, query_id, target_id, CASE WHEN coalesce(t, 0) < 2 THEN 1.0::DOUBLE WHEN hab < 1e-12 THEN 2.0 ELSE (ha.h + hb.h) / hab END AS score
  FROM s LEFT JOIN tot USING (dataset, split, query_id, target_id) LEFT JOIN ha USING (dataset, split, query_id, target_id) LEFT JOIN hb USING (dataset, split, query_id, target_id))""" + top("ns"))  # fmt: skip
def nmi_block_rank(spark, d):
    return shown(block_scorers.nmi_volumes(views.queries(spark, d), views.linked(spark, d), BINS))


@query(SQL + "SELECT vec_id, round(list_sum(list_transform(v, lambda x: CASE WHEN x > 2 THEN 0 ELSE x END)), 6) AS total FROM e")
def clean_vectors(spark, d):
    """Components over 2 are made infinite or NaN first, and cleaned."""
    spoilt = lambda x: F.when(x > 2.5, F.lit(float("nan"))).when(x > 2, F.lit(float("inf"))).otherwise(x)
    rows = views.volumes(spark, d).withColumn("vec", F.transform("vec", spoilt))
    return rows.select(F.col("id").alias("vec_id"), F.round(V.total(V.clean("vec")), 6).alias("total"))


def robust_sql(source: str, name: str, vector: str) -> str:
    keys = f"dataset, split, {source}"
    table = "q" if source == "query_id" else "lk"
    return f"""
{name}1 AS (SELECT {keys}, unnest(range(64)) AS i, unnest({vector}) AS x FROM {table}),
{name}2 AS (SELECT {keys}, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi, count(*) AS n FROM {name}1 WHERE abs(x) > 1e-6 GROUP BY ALL),
{name}3 AS (SELECT {keys}, i, x, least(greatest(x, lo), hi) AS c, n FROM {name}1 JOIN {name}2 USING ({keys})),
{name}4 AS (SELECT {keys}, quantile_cont(c, 0.5) AS med, quantile_cont(c, 0.75) - quantile_cont(c, 0.25) AS iqr FROM {name}3 WHERE abs(x) > 1e-6 GROUP BY ALL),
{name} AS (SELECT {keys}, i, CASE WHEN abs(x) > 1e-6 AND n >= 32 THEN least(greatest((c - med) / greatest(iqr, 1e-6), -6.0), 6.0) ELSE 0.0 END AS r FROM {name}3 JOIN {name}4 USING ({keys}))"""


@query(SQL + "," + robust_sql("query_id", "rq", "qv") + " SELECT query_id, i::INT AS i, round(r, 6) AS value FROM rq")
def robust_normalize(spark, d):
    rows = views.queries(spark, d).withColumn("r", scoring.robust("qv", 32))
    return rows.select("query_id", F.posexplode("r").alias("i", "value")).withColumn("value", F.round("value", 6))


def robust_nmi_rank(spark, d):
    """Without SQL: bin edges depend on the last bit of interpolated quantiles."""
    return shown(block_scorers.robust_nmi(views.queries(spark, d), views.linked(spark, d), 8, 32))


def robust_nmi_block_rank(spark, d):
    """The same through the block form for whole volumes."""
    return shown(block_scorers.robust_nmi_volumes(views.queries(spark, d), views.linked(spark, d), 8, 32))


query()(robust_nmi_rank)
query()(robust_nmi_block_rank)

Z = "list_transform({v}, lambda x: (x - list_sum({v}) / 64) / (sqrt(list_sum(list_transform({v}, lambda y: (y - list_sum({v}) / 64) * (y - list_sum({v}) / 64))) / 64) + 0.000001::DOUBLE))"
NCC = SQL + f", zq AS (SELECT dataset, split, query_id, {Z.format(v='qv')} AS a FROM q), zt AS (SELECT dataset, split, target_id, {Z.format(v='tv')} AS b FROM lk), nc AS (SELECT dataset, split, query_id, target_id, list_dot_product(a, b) / 64 AS score FROM zq JOIN zt USING (dataset, split))"


@query(NCC + top("nc"))
def ncc_rank(spark, d):
    return shown(block_scorers.ncc(views.queries(spark, d), views.linked(spark, d)))


def min_max_sql(table: str) -> str:
    w = "OVER (PARTITION BY dataset, split, query_id)"
    return f"(SELECT *, CASE WHEN max(score) {w} > min(score) {w} THEN (score - min(score) {w}) / (max(score) {w} - min(score) {w}) ELSE 0 END AS m FROM {table})"


@query(NCC + f", en AS (SELECT a.dataset, a.split, a.query_id, a.target_id, CASE WHEN a.dataset = 'dataset1' THEN 0.7::DOUBLE * a.m + 0.3::DOUBLE * b.m ELSE b.score END AS score FROM {min_max_sql('nc')} a JOIN {min_max_sql('s')} b USING (dataset, split, query_id, target_id))" + top("en"))
def ncc_ensemble(spark, d):
    q, t = views.queries(spark, d), views.linked(spark, d)
    return shown(block_scorers.mixed(block_scorers.ncc(q, t, "qz", "tz"), blocks.dot(q, t), 0.7, ("dataset1",)))


@query()
def pair_probability_rank(spark, d):
    """Trained on the pairs of the validation split; the test split is ranked."""
    queries, gallery = views.queries(spark, d), views.linked(spark, d)
    known = queries.where("split = 'val'").join(gallery.select("p", "target_id", "tv"), "p").select("query_id", "target_id", "qv", "tv")
    return shown(block_scorers.probability(queries.where("split = 'test'"), gallery.where("split = 'test'"), classifier.fit(known)))
