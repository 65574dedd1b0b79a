"""Queries on re-ranking and fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbalest.operators import block_scorers, blocks, fusion, inverted, ranking, rerank, scoring
from arbalest.operators.scoring import POOL
from arbalest.plans import cascades, catalogue, views
from arbalest.plans.catalogue import query
from arbalest.plans.scoring import NCC, RANK, shown, top
from arbalest.plans.views import SQL
from arbalest.sources import staging

KEYS = "dataset, split, query_id, target_id"
#: Sinkhorn rounds of the rankers.
ROUNDS = 50


def listed(ranked):
    return ranked.select(*scoring.PAIR, F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


CSLS = """, qn AS (SELECT dataset, split, query_id, avg(score) AS a FROM (SELECT *, row_number() OVER (PARTITION BY dataset, split, query_id ORDER BY score DESC, target_id) AS k FROM s) WHERE k <= 5 GROUP BY ALL),
tn AS (SELECT dataset, split, target_id, avg(score) AS b FROM (SELECT *, row_number() OVER (PARTITION BY dataset, split, target_id ORDER BY score DESC, query_id) AS k FROM s) WHERE k <= 5 GROUP BY ALL),
cs AS (SELECT dataset, split, query_id, target_id, 2 * score - a - b AS score FROM s JOIN qn USING (dataset, split, query_id) JOIN tn USING (dataset, split, target_id))
"""


@query(SQL + CSLS + top("cs"))
def csls_rank(spark, d):
    return shown(block_scorers.csls(views.scorer(spark, d), 5))


def sinkhorn_sql(source: str, rounds: int, tau: float) -> str:
    out = f", k0 AS (SELECT {KEYS}, exp(score / {tau}::DOUBLE - max(score / {tau}::DOUBLE) OVER (PARTITION BY dataset, split)) AS score FROM {source})"
    for i in range(rounds):
        a, b, c = f"k{2 * i}", f"k{2 * i + 1}", f"k{2 * i + 2}"
        out += f", {b} AS (SELECT {KEYS}, score / (sum(score) OVER (PARTITION BY dataset, split, query_id) + 1e-12) AS score FROM {a})"
        out += f", {c} AS (SELECT {KEYS}, score / (sum(score) OVER (PARTITION BY dataset, split, target_id) + 1e-12) AS score FROM {b})"
    return out


@query(SQL + sinkhorn_sql("s", 3, 0.1) + top("k6"))
def sinkhorn3_rank(spark, d):
    return listed(block_scorers.sinkhorn(views.scorer(spark, d), 0.1, 3, 5))


@query(SQL + sinkhorn_sql("s", ROUNDS, 0.1) + top(f"k{2 * ROUNDS}"))
def sinkhorn_rank(spark, d):
    return listed(block_scorers.sinkhorn(views.scorer(spark, d), 0.1, ROUNDS, 5))


@query(SQL + CSLS + sinkhorn_sql("cs", ROUNDS, 0.1) + top(f"k{2 * ROUNDS}"))
def descriptor_cascade(spark, d):
    return listed(block_scorers.sinkhorn(block_scorers.csls(views.scorer(spark, d), 5), 0.1, ROUNDS, 5))


@query(NCC + f", rn AS (SELECT *, {RANK} AS rank FROM nc), f AS (SELECT {KEYS}, 1.0::DOUBLE / (60 + rank) AS w FROM r UNION ALL SELECT {KEYS}, 2.0::DOUBLE / (60 + rank) FROM rn), rf AS (SELECT {KEYS}, sum(w) AS score FROM f GROUP BY ALL)" + top("rf"))
def rrf_fusion(spark, d):
    q, t = views.queries(spark, d), views.linked(spark, d)
    return listed(block_scorers.fused([(blocks.dot(q, t), 1.0), (block_scorers.ncc(q, t), 2.0)], 60, 5))


@query(SQL + f", re AS (SELECT {KEYS}, 0.5::DOUBLE * coalesce(1.0::DOUBLE / a.rank, 0) + 0.5::DOUBLE * coalesce(1.0::DOUBLE / b.rank, 0) AS score FROM r a FULL JOIN r0 b USING ({KEYS}))" + top("re"))
def rank_ensemble(spark, d):
    return listed(block_scorers.fused([(views.scorer(spark, d), 0.5), (views.raw_scorer(spark, d), 0.5)], 0, 5))


@query(SQL + """, b AS (SELECT r.dataset, r.split, query_id, i, avg(x) AS m FROM (SELECT * FROM r WHERE rank <= 5) r JOIN (SELECT target_id, unnest(tv) AS x, unnest(range(64)) AS i FROM lk) USING (target_id) GROUP BY ALL),
c AS (SELECT dataset, split, query_id, list(0.5::DOUBLE * qv[i + 1] + 0.5::DOUBLE * m ORDER BY i) AS c FROM b JOIN (SELECT query_id, qv FROM q) USING (query_id) GROUP BY ALL),
x AS (SELECT dataset, split, query_id, target_id, list_dot_product(c, tv) / sqrt(list_dot_product(c, c)) AS score FROM c JOIN lk USING (dataset, split))""" + top("x"))  # fmt: skip
def alpha_qe(spark, d):
    q, t = views.queries(spark, d), views.linked(spark, d)
    return shown(blocks.dot(rerank.expanded_queries(q, t, blocks.best(blocks.dot(q, t), 5)), t))


@query(SQL + """, gg AS (SELECT a.dataset, a.split, a.target_id, b.target_id AS nb, CASE WHEN a.target_id = b.target_id THEN -1.0::DOUBLE ELSE list_dot_product(a.tv, b.tv) END AS s FROM lk a JOIN lk b USING (dataset, split)),
kn AS (SELECT dataset, split, target_id, list(nb ORDER BY k) AS knn FROM (SELECT *, row_number() OVER (PARTITION BY dataset, split, target_id ORDER BY round(s, 9) DESC, nb) AS k FROM gg) WHERE k <= 20 GROUP BY ALL),
b AS (SELECT * FROM r WHERE rank <= 20), own AS (SELECT dataset, split, query_id, list(target_id) AS own FROM b GROUP BY ALL),
mu AS (SELECT b.*, knn, len(list_intersect(own, knn)) >= 10 AS ok FROM b JOIN own USING (dataset, split, query_id) JOIN kn USING (dataset, split, target_id)),
ch AS (SELECT * FROM mu JOIN (SELECT dataset, split, query_id, bool_or(ok) AS any_ok FROM mu GROUP BY ALL) USING (dataset, split, query_id) WHERE CASE WHEN any_ok THEN ok ELSE rank <= 6 END),
st AS (SELECT dataset, split, query_id, list_distinct(flatten(list(list_prepend(target_id, knn[1:6])))) AS st FROM ch GROUP BY ALL),
x AS (SELECT s.dataset, s.split, s.query_id, s.target_id, 0.35::DOUBLE * score + 0.65::DOUBLE * (len(list_intersect(st, knn)) / (len(st) + len(knn) - len(list_intersect(st, knn)) + 1e-10)) AS score
      FROM s JOIN st USING (dataset, split, query_id) JOIN kn USING (dataset, split, target_id))""" + top("x"))  # fmt: skip
def k_reciprocal(spark, d):
    return listed(block_scorers.k_reciprocal(views.queries(spark, d), views.linked(spark, d), 5))


SLICED = """, qs AS (SELECT dataset, split, query_id, k, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) AS a FROM (SELECT dataset, split, query_id, k, qv[k * 16 + 1:k * 16 + 16] AS w FROM q, (SELECT unnest(range(4)) AS k))),
ts AS (SELECT dataset, split, target_id, k, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) AS b FROM (SELECT dataset, split, target_id, k, tv[k * 16 + 1:k * 16 + 16] AS w FROM lk, (SELECT unnest(range(4)) AS k))),
b AS (SELECT * FROM r WHERE rank <= 10), ms AS (SELECT dataset, split, query_id, target_id, avg(m) AS m FROM (SELECT b.dataset, b.split, b.query_id, b.target_id, qs.k, max(list_dot_product(a, ts.b)) AS m FROM b JOIN qs USING (dataset, split, query_id) JOIN ts USING (dataset, split, target_id) GROUP BY ALL) GROUP BY ALL),
x AS (SELECT s.dataset, s.split, s.query_id, s.target_id, CASE WHEN m IS NULL THEN score ELSE 0.6::DOUBLE * score + 0.4::DOUBLE * m END AS score FROM s LEFT JOIN ms USING (dataset, split, query_id, target_id))
"""


@query(SQL + SLICED + top("x"))
def maxsim_blend(spark, d):
    q = views.slices(views.queries(spark, d), "qv", "q_slices").select(*POOL, "query_id", "q_slices")
    t = views.slices(views.linked(spark, d), "tv", "t_slices").select(*POOL, "target_id", "t_slices")
    """The 10 best get new scores, the others keep theirs, so that the best 5 are among the first 15."""
    return shown(rerank.maxsim_blend(blocks.best(views.scorer(spark, d), 15).drop("rank"), q, t, 10))


@query(NCC + f", x AS (SELECT r.dataset, r.split, r.query_id, r.target_id, row_number() OVER (PARTITION BY r.dataset, r.split, r.query_id ORDER BY r.rank > 10, CASE WHEN r.rank <= 10 THEN -round(nc.score, 9) END, r.rank) AS rank FROM r JOIN nc USING ({KEYS})) SELECT * FROM x WHERE rank <= 15")
def shortlist_tail(spark, d):
    q, t = views.queries(spark, d), views.linked(spark, d)
    first = staging.stage(blocks.best(blocks.dot(q, t), 15))  # the tail stays where it is
    ncc = block_scorers.ncc(q, t, "qz", "tz")
    short = first.where("rank <= 10").select(*scoring.PAIR).join(ncc.queries.select(*ranking.QUERY, "qz"), ranking.QUERY).join(ncc.gallery.select(*rerank.TARGET, "tz"), rerank.TARGET)
    out = ranking.shortlist_then_tail(first, block_scorers.single_scores(ncc, short))
    return out.select(*scoring.PAIR, F.col("rank").cast("long").alias("rank"))


@query(SQL + f"SELECT {KEYS}, round(score, 6) AS score FROM r WHERE rank = 1 AND round(score, 9) >= 0.65::DOUBLE AND dataset IN ('dataset2', 'dataset3')")
def pseudo_pairs(spark, d):
    return fusion.pseudo_pairs(blocks.best(views.scorer(spark, d), 1).drop("rank"), 0.65, ("dataset2", "dataset3")).withColumn("score", F.round("score", 6))


@query(SQL + f", n AS (SELECT *, {RANK} AS k FROM s ANTI JOIN truth USING ({KEYS})) SELECT {KEYS}, round(score, 6) AS score, k AS rank FROM n WHERE k <= 3")
def hard_negatives(spark, d):
    got = block_scorers.but(views.scorer(spark, d), views.truth(spark, d), 3)
    return got.select(*scoring.PAIR, F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(NCC + f""", fs AS (SELECT {KEYS}, -sqrt(list_sum(list_transform(range(1, 17), lambda i: (qv[i] - tv[i]) * (qv[i] - tv[i])))) AS score FROM q JOIN lk USING (dataset, split)),
x AS (SELECT {KEYS}, score FROM s WHERE dataset = 'dataset1' UNION ALL SELECT {KEYS}, score FROM nc WHERE dataset = 'dataset2' UNION ALL SELECT {KEYS}, score FROM fs WHERE dataset = 'dataset3')""" + top("x"))  # fmt: skip
def dataset_dispatch(spark, d):
    q, t = views.queries(spark, d), views.linked(spark, d)
    sides = q.withColumn("qa", F.slice("qv", 1, 16)), t.withColumn("ta", F.slice("tv", 1, 16))
    rankers = {"dataset1": blocks.dot(q, t), "dataset2": block_scorers.ncc(q, t), "dataset3": block_scorers.affine(*sides)}
    return shown(ranking.dispatch({name: blocks.best(s.where(F.col("dataset") == name), 5).drop("rank") for name, s in rankers.items()}))


@query()
def shortlist_cascade(spark, d):
    """Whole rankings, a shortlist of 30 and the tail. Without SQL: it goes through the aligner's kernel; the tests hold it against numpy."""
    got = cascades.dataset2_ranking(views.queries(spark, d), views.linked(spark, d), views.SHAPE)
    return got.select(*scoring.PAIR, F.col("rank").cast("long").alias("rank"))


NEIGHBOURS = SQL + ", n AS (SELECT dataset, split, target_id, b.target_id AS neighbour, row_number() OVER (PARTITION BY dataset, split, a.target_id ORDER BY round(CASE WHEN a.target_id = b.target_id THEN -1.0::DOUBLE ELSE list_dot_product(a.tv, b.tv) END, 9) DESC, b.target_id) AS rank FROM lk a JOIN (SELECT dataset, split, target_id, tv FROM lk) b USING (dataset, split)) SELECT * FROM n WHERE rank <= 6".replace("dataset, split, target_id, b.target_id AS", "a.dataset, a.split, a.target_id, b.target_id AS").replace("PARTITION BY dataset, split, a.", "PARTITION BY a.dataset, a.split, a.")


@query(NEIGHBOURS)
def gallery_neighbours(spark, d):
    return block_scorers.neighbours(views.linked(spark, d), 6).withColumn("rank", F.col("rank").cast("long"))


@query(NEIGHBOURS)
def indexed_neighbours(spark, d):
    """The same lists from the inverted-file index, whose bounds make them exact."""
    return inverted.neighbours(views.linked(spark, d), 6).withColumn("rank", F.col("rank").cast("long"))


@query(catalogue.SQL["k_reciprocal"])
def indexed_k_reciprocal(spark, d):
    gallery = views.linked(spark, d)
    return listed(block_scorers.k_reciprocal(views.queries(spark, d), gallery, 5, near=inverted.neighbours(gallery, 20)))


@query()
def probed_neighbours(spark, d):
    """Recall of the index by pool with as many probes as a recall of 0.95 takes on a sample, and the share of pairs that it scores. Without
    SQL: the cells are learned. The fixtures' vectors have no clusters, so most cells are probed; the tests plant some."""
    gallery = views.linked(spark, d)
    index = inverted.build(gallery)
    queries = gallery.select(*POOL, F.col("target_id").alias("query_id"), F.col("tv").alias("qv"))
    probes = inverted.calibrated(index, queries, 21)
    got = inverted.recall(inverted.neighbours(gallery, 20, probes, index), block_scorers.neighbours(gallery, 20), [*POOL, "target_id", "neighbour"])
    return got.join(inverted.visited(index, queries, 21, probes), POOL).withColumn("probes", F.lit(probes))
