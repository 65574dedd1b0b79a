"""Retrieval quality and reports on rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbalest.functions import rules
from arbalest.functions import vectors as V
from arbalest.operators import blocks
from arbalest.operators.ranking import QUERY, pick_two, rank
from arbalest.operators.scoring import PAIR, POOL, pairs


def true_rank(ranked: DataFrame, truth: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Rank of each query's true target; null if absent, or the pool's gallery size + 1 with ``sizes`` (n_targets)."""
    out = truth.join(ranked.select(*PAIR, "rank"), PAIR, "left")
    out = out.select(*PAIR, F.col("rank").cast("long").alias("rank"))
    return out if sizes is None else absent_last(out, sizes)


def counted_ranks(queries: DataFrame, gallery: DataFrame, truth: DataFrame, score: Column) -> DataFrame:
    """``true_rank`` without a ranking: each query's targets that beat the true one are counted as the pairs are scored, so the
    score matrix is neither shuffled nor sorted. ``score`` is an expression over both sides' columns."""
    at = F.round(score, 9)
    own = truth.select(*PAIR).join(queries, QUERY).join(gallery, [*POOL, "target_id"]).select(*QUERY, F.col("target_id").alias("_true"), at.alias("_best"))
    rows = pairs(queries.join(own, QUERY), gallery).select(*PAIR, "_true", "_best", at.alias("_score"))
    beats = (F.col("_score") > F.col("_best")) | ((F.col("_score") == F.col("_best")) & (F.col("target_id") < F.col("_true")))
    counts = rows.groupBy(*QUERY, "_true").agg((F.count_if(beats) + 1).alias("rank")).withColumnRenamed("_true", "target_id")
    return truth.select(*PAIR).join(counts, PAIR, "left")


def absent_last(ranks: DataFrame, sizes: DataFrame) -> DataFrame:
    """Null ranks become the pool's gallery size + 1 (sizes: n_targets)."""
    return ranks.join(sizes, POOL).select(*PAIR, F.coalesce("rank", F.col("n_targets") + 1).cast("long").alias("rank"))


def pool_mrr(ranks: DataFrame) -> DataFrame:
    """Mean of 1 / rank of each pool; null ranks count as 0."""
    return ranks.groupBy(*POOL).agg(F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"), F.count("*").alias("n_queries"))


def macro_of(ranks: DataFrame) -> DataFrame:
    """Mean of the pools' MRR; without a pool the query fails."""
    pools = ranks.groupBy(*POOL).agg(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"))
    mean = F.when(F.count("*") == 0, F.raise_error(F.lit("no pool to average")).cast("double")).otherwise(F.round(F.avg("mrr"), 6))
    return pools.agg(mean.alias("macro_mrr"), F.count("*").alias("n_pools"))


def recall_of(ranks: DataFrame, ks: tuple[int, ...] = (5, 10, 15, 20, 25, 30)) -> DataFrame:
    rows = ranks.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    return rows.groupBy(*POOL, "k").agg(F.round(F.avg(F.coalesce((F.col("rank") <= F.col("k")).cast("double"), F.lit(0.0))), 6).alias("recall"))


def reciprocal_ranks(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """1 / rank of the true target; 0 for a missing query or target."""
    return true_rank(ranked, truth).withColumn("rr", F.coalesce(1.0 / F.col("rank"), F.lit(0.0)))


def mrr_by_pool(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    return pool_mrr(true_rank(ranked, truth))


def macro_mrr(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    return macro_of(true_rank(ranked, truth))


def recall_at(ranked: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (5, 10, 15, 20, 25, 30)) -> DataFrame:
    return recall_of(true_rank(ranked, truth), ks)


def method_table(methods: dict[str, DataFrame], truth: DataFrame) -> DataFrame:
    """MRR of each method by pool as columns, one for each pool of the truth, and their mean as ``macro``. A method is its whole ranking, or
    the true targets' ranks alone."""
    rows = None
    for name, ranked in methods.items():
        part = reciprocal_ranks(ranked, truth).withColumn("method", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    pools = sorted(r.pool for r in truth.select(F.concat_ws("_", "dataset", "split").alias("pool")).distinct().collect())  # columns of the result
    wide = rows.withColumn("pool", F.concat_ws("_", "dataset", "split")).groupBy("method", "pool").agg(F.avg("rr").alias("mrr"))
    macro = wide.groupBy("method").agg(F.round(F.avg("mrr"), 6).alias("macro"))
    return wide.groupBy("method").pivot("pool", pools).agg(F.round(F.first("mrr"), 6)).join(macro, "method")


def delta_table(base: DataFrame, other: DataFrame) -> DataFrame:
    """Change of each pool's MRR and its reading, from two frames of true ranks."""
    a, b = (pool_mrr(r).select(*POOL, F.col("mrr").alias(n)) for r, n in ((base, "base_mrr"), (other, "other_mrr")))
    delta = F.round(F.col("other_mrr") - F.col("base_mrr"), 6)
    return a.join(b, POOL).withColumn("delta", delta).withColumn("reading", rules.delta_reading(F.col("delta")))


def bijection(scores: DataFrame | blocks.Scorer) -> DataFrame:
    """Whether the best targets of a pool's queries are all different and cover its gallery."""
    count = lambda rows, c: rows.groupBy(*POOL).agg(F.count_distinct(c).alias("n_queries" if c == "query_id" else "n_targets"))
    one, two = (scores.queries, scores.gallery) if isinstance(scores, blocks.Scorer) else (scores, scores)
    sizes = count(one, "query_id").join(count(two, "target_id"), POOL)
    best = shortlist(scores, 1).groupBy(*POOL).agg(F.count_distinct("target_id").alias("n_chosen"))
    same = (F.col("n_chosen") == F.col("n_queries")) & (F.col("n_queries") == F.col("n_targets"))
    return sizes.join(best, POOL).withColumn("is_bijection", same)


def shortlist(scores: DataFrame | blocks.Scorer, k: int) -> DataFrame:
    return blocks.best(scores, k) if isinstance(scores, blocks.Scorer) else rank(scores, k)


def collisions(scores: DataFrame) -> DataFrame:
    """Targets that are the best of more than one query."""
    return rank(scores, 1).groupBy(*POOL, "target_id").agg(F.count("*").alias("n_queries")).where("n_queries > 1")


def gap_summary(distances: DataFrame | blocks.Scorer, near: float = 1e-3, wide: float = 1e-2) -> DataFrame:
    """Per pool: best distances, gaps to the runner-up, near-zero and wide counts, and the leak flag. ``distances`` are scores
    of opposite sign."""
    two = pick_two(shortlist(distances, 2)).select(*QUERY, "target_id", (-F.col("best")).alias("best"), "gap")
    six = lambda c: F.round(c, 6)
    out = two.groupBy(*POOL).agg(
        six(F.min("best")).alias("best_min"), six(F.percentile("best", F.lit(0.5))).alias("best_median"), six(F.max("best")).alias("best_max"),
        six(F.min("gap")).alias("gap_min"), six(F.percentile("gap", F.lit(0.5))).alias("gap_median"), six(F.max("gap")).alias("gap_max"),
        F.count_if(F.col("best") < near).alias("near_zero"), F.count_if(F.col("gap") > wide).alias("wide_gap"), F.count("*").alias("n_queries"),
    )
    leak = (F.col("near_zero") >= 0.9 * F.col("n_queries")) & (F.col("wide_gap") >= 0.9 * F.col("n_queries"))
    return out.join(bijection(distances).select(*POOL, "is_bijection"), POOL).withColumn("is_leak", F.col("is_bijection") & leak)


def field_leaks(true: DataFrame, wrong: DataFrame, fields: dict[str, str]) -> DataFrame:
    """How often each header field agrees in true and in wrong pairs (columns q_<field>, t_<field>); ``fields`` names each
    field's kind: 'array' compares within 1e-4, 'value' exactly."""

    def agreement(rows: DataFrame, name: str) -> DataFrame:
        same = {f: V.close(F.col(f"q_{f}"), F.col(f"t_{f}")) if kind == "array" else F.col(f"q_{f}") == F.col(f"t_{f}") for f, kind in fields.items()}
        shares = rows.agg(*[F.avg(F.coalesce(c, F.lit(False)).cast("double")).alias(f) for f, c in same.items()])
        return shares.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias(name)) for f in fields])).alias("x")).select("x.*")

    out = agreement(true, "at_true").join(agreement(wrong, "at_wrong"), "field")
    out = out.withColumn("leak", F.col("at_true") * (1 - F.col("at_wrong")))
    out = out.withColumn("verdict", rules.leak_verdict(F.col("leak"), F.col("at_true"), F.col("at_wrong")))
    return out.select("field", *[F.round(c, 6).alias(c) for c in ("at_true", "at_wrong", "leak")], "verdict")


def cost_projection(sizes: DataFrame, seconds: float, shortlist: int | None = None) -> DataFrame:
    """Pairs to register and seconds for each pool (n_queries, n_targets)."""
    per = F.col("n_targets") if shortlist is None else F.least("n_targets", F.lit(shortlist))
    return sizes.withColumn("n_pairs", F.col("n_queries") * per).withColumn("seconds", F.round(F.col("n_pairs") * F.lit(seconds), 6))


def sanity(scores: DataFrame | blocks.Scorer) -> DataFrame:
    """Best three and worst score of each query, and whether they are too close to tell."""
    if isinstance(scores, blocks.Scorer):
        ranked = blocks.best(scores, 3).unionByName(blocks.last(scores))
    else:
        ranked = rank(scores)
    pick = lambda r: F.max(F.when(F.col("rank") == r, F.col("score")))
    six = lambda c: F.round(c, 6)
    out = ranked.groupBy(*QUERY).agg(six(pick(1)).alias("first"), six(pick(2)).alias("second"), six(pick(3)).alias("third"), six(F.max_by("score", "rank")).alias("worst"))
    return out.withColumn("degenerate", rules.is_degenerate(F.col("first"), F.col("worst")))


def result_status(ranked: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Of each query's shown ``k`` best: status and the true target's rank among them."""
    shown = ranked.where(F.col("rank") <= k)
    queries = shown.select(*QUERY).distinct().join(truth.withColumnRenamed("target_id", "true_id"), QUERY, "left")
    at = shown.select(*QUERY, F.col("target_id").alias("true_id"), "rank")
    out = queries.join(at, [*QUERY, "true_id"], "left")
    return out.select(*QUERY, F.col("rank").cast("long").alias("rank"), rules.result_status(F.col("true_id"), F.col("rank")).alias("status"))
