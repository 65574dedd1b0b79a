"""Re-ranking: score frames to score frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbalest.functions import vectors as V
from arbalest.operators.ranking import QUERY, rank
from arbalest.operators.scoring import PAIR, POOL, maxsim, neighbours
from arbalest.sources.staging import stage

TARGET = [*POOL, "target_id"]
#: Pairs of a pool that one worker normalises as a matrix: 32 MB of doubles.
MATRIX = 1 << 22


def csls(scores: DataFrame, k: int) -> DataFrame:
    """2s - mean of the query's k best - mean of the target's k best; k <= 0: s."""
    if k <= 0:
        return scores

    out = scores
    for side, other, name in ((QUERY, "target_id", "_q"), (TARGET, "query_id", "_t")):  # one shuffle each; scores are made once
        whole = Window.partitionBy(*side)
        out = out.withColumn("_r", F.row_number().over(whole.orderBy(F.desc("score"), other)))
        out = out.withColumn(name, F.avg(F.when(F.col("_r") <= k, F.col("score"))).over(whole))
    return out.select(*PAIR, (2.0 * F.col("score") - F.col("_q") - F.col("_t")).alias("score"))


def _weights(scores: DataFrame, tau: float) -> DataFrame:
    """exp((score - the pool's largest) / tau) of each pair; the maximum is an aggregate, joined back."""
    part = scores.select(*PAIR, (F.col("score") / max(tau, 1e-6)).alias("_z"))
    top = part.groupBy(*POOL).agg(F.max("_z").alias("_top"))
    return part.join(top, POOL).select(*PAIR, F.exp(F.col("_z") - F.col("_top")).alias("score"))


def sinkhorn_steps(scores: DataFrame, tau: float, rounds: int) -> DataFrame:
    """A few Sinkhorn rounds as windows of one query or one target; for many use ``sinkhorn``."""
    out = _weights(scores, tau)
    for _ in range(rounds):
        for side in (QUERY, TARGET):
            out = out.withColumn("score", F.col("score") / (F.sum("score").over(Window.partitionBy(*side)) + 1e-12))
    return out.select(*PAIR, "score")


def _whole_pools(frame: pd.DataFrame, rounds: int) -> pd.DataFrame:
    out = frame.pivot(index="query_id", columns="target_id", values="score").to_numpy()
    for _ in range(rounds):
        out = out / (out.sum(axis=1, keepdims=True) + 1e-12)
        out = out / (out.sum(axis=0, keepdims=True) + 1e-12)
    q, t = np.sort(frame.query_id.unique()), np.sort(frame.target_id.unique())
    return pd.DataFrame({"dataset": frame.dataset.iloc[0], "split": frame.split.iloc[0], "query_id": np.repeat(q, len(t)), "target_id": np.tile(t, len(q)), "score": out.ravel()})


def _by_factors(weights: DataFrame, rounds: int) -> DataFrame:
    """Sinkhorn by one factor for each query and each target: the matrix is never rewritten. A half round is a join with the other
    side's factors and a sum that is added up before the shuffle; factors are tables, so lineage stays short."""
    u = weights.select(*QUERY).distinct().withColumn("u", F.lit(1.0))
    v = weights.select(*TARGET).distinct().withColumn("v", F.lit(1.0))
    u, v = stage(u), stage(v)
    for _ in range(rounds):
        sums = weights.join(v, TARGET).groupBy(*QUERY).agg(F.sum(F.col("score") * F.col("v")).alias("_s"))
        u = stage(u.join(sums, QUERY).select(*QUERY, (F.col("u") / (F.col("u") * F.col("_s") + 1e-12)).alias("u")))
        sums = weights.join(u, QUERY).groupBy(*TARGET).agg(F.sum(F.col("score") * F.col("u")).alias("_s"))
        v = stage(v.join(sums, TARGET).select(*TARGET, (F.col("v") / (F.col("v") * F.col("_s") + 1e-12)).alias("v")))
    return weights.join(u, QUERY).join(v, TARGET).select(*PAIR, (F.col("score") * F.col("u") * F.col("v")).alias("score"))


def sinkhorn(scores: DataFrame, tau: float, rounds: int, most: int = MATRIX) -> DataFrame:
    """Sinkhorn normalisation of each pool. Pools of up to ``most`` pairs are one matrix each in a worker; larger ones go by
    factors, with the same result but for rounding."""
    weights = stage(_weights(scores, tau))
    sizes = weights.groupBy(*POOL).agg(F.count("*").alias("_n"))  # one row a pool
    marked = weights.join(sizes, POOL)
    small, large = marked.where(F.col("_n") <= most).drop("_n"), marked.where(F.col("_n") > most).drop("_n")
    shape = "dataset string, split string, query_id string, target_id string, score double"
    out = small.groupBy(*POOL).applyInPandas(lambda frame: _whole_pools(frame, rounds), shape)
    return out if large.isEmpty() else out.unionByName(_by_factors(stage(large), rounds))


def scaled(score: str = "score") -> Column:
    """A score scaled to 0..1 within its query; 0 in a constant row."""
    w = Window.partitionBy(*QUERY)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return F.when(hi > lo, (F.col(score) - lo) / (hi - lo)).otherwise(0.0)


def row_min_max(scores: DataFrame) -> DataFrame:
    return scores.select(*PAIR, scaled().alias("score"))


def mean_vector(vectors: Column) -> Column:
    """Component means of an array of vectors, summed in order."""
    first = lambda vs: F.transform(F.element_at(vs, 1), lambda x: F.lit(0.0))
    sums = lambda vs: F.aggregate(vs, first(vs), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return V.let(vectors, lambda vs: F.transform(sums(vs), lambda x: x / F.size(vs)))


def expanded_queries(queries: DataFrame, gallery: DataFrame, scores: DataFrame, k: int = 5, alpha: float = 0.5) -> DataFrame:
    """Alpha query expansion: alpha * q + (1 - alpha) * mean of its k best targets, normalised."""
    best = rank(scores, k).join(gallery.select(*TARGET, "tv"), TARGET)
    best = best.groupBy(*QUERY).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "tv"))), lambda x: x["tv"]).alias("_t"))
    out = queries.join(best, QUERY)
    return out.withColumn("qv", V.unit(V.combine("qv", mean_vector(F.col("_t")), alpha, 1 - alpha))).drop("_t")


def neighbour_lists(near: DataFrame) -> DataFrame:
    """(target, _knn): each target's neighbours in their order."""
    return near.groupBy(*TARGET).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "neighbour"))), lambda x: x["neighbour"]).alias("_knn"))


def reciprocal_sets(best: DataFrame, lists: DataFrame, k1: int, k2: int, name: str = "target_id") -> DataFrame:
    """(query, _set) from the queries' ``k1`` best and the targets' lists, both of which name targets by ``name``."""
    own = best.groupBy(*QUERY).agg(F.collect_list(name).alias("_own"))
    mutual = best.join(own, QUERY).join(lists, TARGET).withColumn("_ok", F.size(F.array_intersect("_own", "_knn")) >= k1 / 2)
    some = mutual.groupBy(*QUERY).agg(F.max("_ok").alias("_any"))
    chosen = mutual.join(some, QUERY).where(F.when(F.col("_any"), F.col("_ok")).otherwise(F.col("rank") <= k2))
    wide = F.concat(F.array(name), F.slice("_knn", 1, k2))
    return chosen.groupBy(*QUERY).agg(F.array_distinct(F.flatten(F.collect_list(wide))).alias("_set"))


def k_reciprocal(scores: DataFrame, gallery: DataFrame, k1: int = 20, k2: int = 6, lam: float = 0.35, near: DataFrame | None = None) -> DataFrame:
    """lam * s + (1 - lam) * Jaccard overlap of the query's reciprocal set with each target's neighbours.

    The set has the query's k1 best targets whose own k1 neighbours share at least k1 / 2 with them (else its k2 best), and
    their k2 nearest neighbours. Lists are k1 long at most, so each step is an equi-join and an array function. ``near`` has the targets'
    neighbour lists where they are known already, as from ``inverted.neighbours``.
    """
    lists = neighbour_lists(neighbours(gallery, k1) if near is None else near)
    sets = reciprocal_sets(rank(scores, k1), lists, k1, k2)
    out = scores.join(sets, QUERY).join(lists, TARGET).withColumn("_n", F.size(F.array_intersect("_set", "_knn")))
    jaccard = F.col("_n") / (F.size("_set") + F.size("_knn") - F.col("_n") + 1e-10)
    return out.select(*PAIR, (F.lit(lam) * F.col("score") + F.lit(1 - lam) * jaccard).alias("score"))


def maxsim_blend(scores: DataFrame, query_slices: DataFrame, target_slices: DataFrame, k: int = 50, blend: float = 0.4) -> DataFrame:
    """(1 - blend) * s + blend * MaxSim for each query's k best targets; the others keep s."""
    best = rank(scores, k).join(query_slices, QUERY).join(target_slices, TARGET)
    new = best.select(*PAIR, (F.lit(1 - blend) * F.col("score") + F.lit(blend) * maxsim(F.col("q_slices"), F.col("t_slices"))).alias("_new"))
    return scores.join(new, PAIR, "left").select(*PAIR, F.coalesce("_new", "score").alias("score"))
