"""Rankings: scores rounded to 9 digits, ties to the smaller target id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbalest.operators.scoring import PAIR, POOL

QUERY = [*POOL, "query_id"]


def by_score(*first: Column) -> Window:
    return Window.partitionBy(*QUERY).orderBy(*first, F.round("score", 9).desc(), "target_id")


def rank(scores: DataFrame, k: int | None = None) -> DataFrame:
    """``scores`` with rank from 1; with ``k`` the shortlist (all, if the gallery is smaller)."""
    ranked = scores.withColumn("rank", F.row_number().over(by_score()))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def submission(ranked: DataFrame) -> DataFrame:
    """(query_id, target_id_ranking): all targets of a query, space-joined."""
    order = F.sort_array(F.collect_list(F.struct("rank", "target_id")))
    return ranked.groupBy(*QUERY).agg(F.array_join(F.transform(order, lambda x: x["target_id"]), " ").alias("target_id_ranking"))


def stand_ins(queries: DataFrame, gallery: DataFrame) -> DataFrame:
    """The rows of ``submission`` of all pairs, with one name (a blank one, if the pool has no other) in place of each ranking: for checks of rows,
    which no order of names changes. A query of a pool without targets has no row, as there."""
    blank = F.coalesce(F.length(F.trim("target_id")), F.lit(0)) == 0
    names = gallery.groupBy(*POOL).agg(F.coalesce(F.max(F.when(~blank, F.col("target_id"))), F.lit("")).alias("target_id_ranking"))
    return queries.select(*QUERY).distinct().join(names, POOL)


def best_two(scores: DataFrame) -> DataFrame:
    """The best target of each query, its score, the runner-up's, and the gap."""
    return pick_two(rank(scores, 2))


def pick_two(two: DataFrame) -> DataFrame:
    pick = lambda r, c: F.max(F.when(F.col("rank") == r, F.col(c)))
    out = two.groupBy(*QUERY).agg(pick(1, "target_id").alias("target_id"), pick(1, "score").alias("best"), pick(2, "score").alias("second"))
    return out.withColumn("gap", F.col("best") - F.col("second"))


def shortlist_then_tail(first: DataFrame, again: DataFrame) -> DataFrame:
    """``first`` (ranked), its targets scored in ``again`` moved to the head in the order of that score."""
    new = again.select(*PAIR, F.col("score").alias("_new"))
    both = first.join(new, PAIR, "left")
    order = Window.partitionBy(*QUERY).orderBy(F.col("_new").isNull(), F.round("_new", 9).desc(), "rank")
    return both.withColumn("rank", F.row_number().over(order)).drop("_new")


def random_ranking(pairs: DataFrame, seed: int) -> DataFrame:
    """A seeded shuffle of each query's gallery."""
    key = F.sha2(F.concat_ws(":", F.lit(str(seed)), "query_id", "target_id"), 256)
    return pairs.select(*PAIR).withColumn("rank", F.row_number().over(Window.partitionBy(*QUERY).orderBy(key, "target_id")))


def dispatch(rankers: dict[str, DataFrame]) -> DataFrame:
    """Each dataset's rows from its own score frame."""
    parts = [scores.where(F.col("dataset") == name).select(*PAIR, "score") for name, scores in rankers.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
