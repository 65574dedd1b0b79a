"""Mixing sources to target weights by a time-varying curriculum (DataFrame functions only).

Each source has a weight schedule over training time t in [0, 1]: its target words, times 1 + tilt * (2t - 1).
The schedule is integrated to the cumulative demand target * (t + tilt * (t*t - t)), and the demand is inverted
at the words that stand before a document in its source's order: that t is the document's training position.
Documents are then range-sorted by position.

Contract:
* size: number of words of the text (null: 0); sources in code point order, null last, carry the weights 5, 2, 1 in
  turn and share ``share`` times all words; no target passes ``cap`` times its source's words, the excess is
  reshared by weight until none does;
* a source's words are taken in whole passes over it, in digest order, and the last pass ends inside one document, so
  the taken words equal floor(target), and no document exceeds ceil(cap) times its size;
* digests are of id (null: empty) and text, so that rows without ids, or of one id, spread too; repeated rows all take part;
  an empty table, or one without words, gives targets 0; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbalest.llm.common import WORD, id_text, numbered, stage

#: Hex digits of the digest that splits each source: 16**3 pieces, so that a hot source is never one group.
PIECE_DIGITS = 3
WEIGHTS, SHARE, CAP, TILTS = (5, 2, 1), 1.5, 2.0, (0.5, -0.5)


def word_count(col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(col), F.lit(WORD)), F.lit(0)).cast("long")


def ranked_sources(pieces: DataFrame) -> DataFrame:
    """(source, source_size, rank from 0 in code point order, null last).

    Ranks come from a distributed sort: rows before a partition, plus the row's place in it."""
    sizes = pieces.groupBy("source").agg(F.sum("piece_size").alias("source_size"))
    return numbered(sizes.orderBy(F.col("source").asc_nulls_last())).withColumnRenamed("row_no", "rank")


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """``sources`` with weight and target. Each round caps the sources above their limit and reshares; two sums
    reach the driver each round."""
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = stage(sources.withColumn("weight", weight))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    limit = F.lit(float(cap)) * F.col("source_size")
    rate, capped, known = 0.0, F.lit(False), -1
    while total:
        got = sources.agg(
            F.sum(F.when(capped, F.col("source_size"))).alias("full"), F.sum(F.when(~capped, F.col("weight"))).alias("open"),
            F.count_if(capped).alias("n"),
        ).first()
        if got.n == known or not got.open:
            break
        rate, known = (share * total - cap * (got.full or 0)) / got.open, got.n
        capped = F.lit(rate) * F.col("weight") > limit
    return sources.withColumn("target", F.when(F.lit(rate) * F.col("weight") > limit, limit).otherwise(F.lit(rate) * F.col("weight")))


def placed(rows: DataFrame, weights: tuple[int, ...], share: float, cap: float, tilts: tuple[float, ...]) -> DataFrame:
    """``rows`` (source, size, _digest, doc_id and any others) with source_size, target, tilt, taken, and _before: the
    source's words ahead. Rows are shuffled once, by (source, digest piece)."""
    rows = rows.withColumn("_piece", F.substring("_digest", 1, PIECE_DIGITS))
    pieces = stage(rows.groupBy("source", "_piece").agg(F.sum("size").alias("piece_size")))
    tilt = F.element_at(F.array(*[F.lit(float(x)) for x in tilts]), (F.col("rank") % len(tilts) + 1).cast("int"))
    sources = targets(ranked_sources(pieces), weights, share, cap).withColumn("tilt", tilt)
    ahead = Window.partitionBy("source").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_ahead", F.coalesce(F.sum("piece_size").over(ahead), F.lit(0)))
    p, s = pieces.alias("p"), sources.alias("s")
    pieces = p.join(s, F.col("p.source").eqNullSafe(F.col("s.source"))).select("p.source", "_piece", "_ahead", "source_size", "target", "tilt")
    # null sources join as a flag and an empty text, so that the join keys are plain and spread by piece
    flag = lambda df: df.withColumns({"_none": F.col("source").isNull(), "_name": F.coalesce("source", F.lit(""))}).drop("source")
    order = Window.partitionBy("_none", "_name", "_piece").orderBy("_digest", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = flag(rows).withColumn("_own", F.coalesce(F.sum("size").over(order), F.lit(0)))
    rows = rows.join(flag(pieces).hint("merge"), ["_none", "_name", "_piece"]).withColumn("_before", F.col("_ahead") + F.col("_own"))
    whole = F.floor("target")
    passes = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(0)
    rest = whole - passes * F.col("source_size") - F.col("_before")
    return rows.withColumn("taken", (passes * F.col("size") + F.greatest(F.lit(0), F.least(rest, F.col("size")))).cast("long"))


def position(turn: Column) -> Column:
    """Training position of a document in the given pass over its source (from 0): its demand curve, inverted."""
    used = F.least(F.lit(1.0), (turn * F.col("source_size") + F.col("_before")) / F.col("target"))
    slope, tilt = 1 - F.col("tilt"), F.col("tilt")
    back = (F.sqrt(slope * slope + 4 * tilt * used) - slope) / (2 * tilt)
    return F.abs(F.round(F.when(tilt == 0, used).otherwise(back), 9))


def read(docs: DataFrame, *payload: Column | str) -> DataFrame:
    return docs.select(*payload, F.col("source").cast("string").alias("source"), word_count().alias("size"), F.md5(F.concat(id_text(), F.lit(":"), F.coalesce("text", F.lit("")))).alias("_digest"))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, tilts: tuple[float, ...] = TILTS
) -> DataFrame:
    """One row per document: size, source_size, target, taken and first_position, range-sorted by position (documents
    of which nothing is taken come last). The texts never leave the scan."""
    rows = placed(read(docs, "doc_id"), weights, share, cap, tilts)
    rows = rows.withColumn("first_position", F.when(F.col("taken") > 0, position(F.lit(0))))
    return rows.orderBy(F.col("first_position").asc_nulls_last(), "_digest").select("doc_id", "size", "source_size", "target", "taken", "first_position")


def curriculum(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, tilts: tuple[float, ...] = TILTS
) -> DataFrame:
    """The rows of ``docs`` in training order, each as often as the mix takes it (taken / size, rounded half up)."""
    rows = placed(read(docs, "doc_id", F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns)).alias("_row")), weights, share, cap, tilts)
    times = F.when(F.col("size") > 0, F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size")))).otherwise(0).cast("int")
    rows = rows.withColumn("_times", times).where("_times > 0").withColumn("_turn", F.explode(F.sequence(F.lit(0), F.col("_times") - 1)))
    return rows.withColumn("_at", position(F.col("_turn"))).orderBy("_at", "_digest").select("_row.*")
