"""Queries that train: heads on pairs, with mined negatives, and by self-training rounds.

The gallery of these queries is turned: its vectors hold their queries' components in reverse order, so raw vectors rank poorly and heads have
something to learn. Without SQL; the tests hold training against a numpy loop.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbalest.functions import vectors as V
from arbalest.operators import block_scorers, evaluation, heads
from arbalest.operators.scoring import POOL
from arbalest.plans import views
from arbalest.plans.catalogue import query
from arbalest.sources import staging


def turned(spark, d):
    both = views.gallery(spark, d).join(views.queries(spark, d).select("p", F.reverse("qv").alias("qv")), "p")
    return both.select(*POOL, "target_id", V.unit(V.combine("qv", "tv", 0.7, 0.7)).alias("tv"))


def sides(spark, d):
    return [staging.stage(x) for x in (views.queries(spark, d).select(*POOL, "query_id", "qv"), turned(spark, d), views.truth(spark, d))]


def mrr(queries, gallery, truth, trained=None):
    if trained:
        queries, gallery = (staging.stage(heads.projected(*x)) for x in ((queries, "qv", trained.query), (gallery, "tv", trained.target)))
    return evaluation.pool_mrr(block_scorers.true_ranks(queries, gallery, truth))


def held_out(spark, d, settings):
    """MRR of the val pools before and after training on the pairs of the test pools, with the first and last loss."""
    q, t, truth = sides(spark, d)
    done = heads.train(q, t, truth.where("split = 'test'"), settings)
    q, t, truth = (x.where("split = 'val'") for x in (q, t, truth))
    got = mrr(q, t, truth).withColumnRenamed("mrr", "mrr_raw").join(mrr(q, t, truth, done.heads).drop("n_queries"), POOL)
    return got.withColumns({"loss_first": F.lit(round(done.losses[0], 4)), "loss_last": F.lit(round(done.losses[-1], 4)), "n_mined": F.lit(len(done.mined))})


@query()
def contrastive_training(spark, d):
    return held_out(spark, d, heads.Settings())


@query()
def mined_training(spark, d):
    """Triplets of negatives that are mined anew every 10 steps weigh 0.4 beside the contrastive loss."""
    return held_out(spark, d, heads.Settings(triplet_weight=0.4))


@query()
def self_training(spark, d):
    """Labels of dataset1 only; each round's pseudo-pairs in the other datasets, how many are right, and the MRR by pool there."""
    q, t, truth = sides(spark, d)
    rounds = heads.self_train(q, t, truth.where("dataset = 'dataset1'"), ("dataset2", "dataset3"), staging.fresh_path(spark, "rounds"))
    others = "dataset <> 'dataset1'"

    def row(r: heads.Round) -> DataFrame:
        right = r.pseudo.join(truth, [*POOL, "query_id", "target_id"], "left_semi").groupBy(*POOL).agg(F.count("*").alias("n_right"))
        counts = r.pseudo.groupBy(*POOL).agg(F.count("*").alias("n_pseudo")).join(right, POOL, "left")
        got = mrr(*(x.where(others) for x in (q, t, truth)), r.heads).join(counts, POOL, "left")
        return got.select(F.lit(r.number).alias("round"), *POOL, "mrr", F.coalesce("n_pseudo", F.lit(0)).alias("n_pseudo"), F.coalesce("n_right", F.lit(0)).alias("n_right"))

    return reduce(DataFrame.unionByName, map(row, rounds))
