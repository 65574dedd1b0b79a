"""Scores of every query against its pool's gallery that are used up where they are made: no row for a pair is ever formed.

A ``Scorer`` holds both sides, with features prepared per entity, and a kernel that makes the matrix of scores of some queries and some
targets. Both sides of a pool are dealt by hash into blocks of about ``BLOCK`` entities, counted within the plan; each block of queries meets
each block of targets in one unit, ``CHUNK`` scores at a time, and what leaves a unit is its reduction: each query's best few, how many
targets beat the true one, sums. So the work is a matrix product spread over tasks, memory is bounded by the blocks, and what is shuffled is
the entities (once for each block of the other side) and the reductions. Nothing runs before the plan does.

Null vectors give null scores, which rank last; NaN ranks first, as in Spark. Vectors of one feature must have one length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbalest.operators.ranking import QUERY, rank
from arbalest.operators.scoring import PAIR, POOL

#: Entities of a block, blocks that a small pool is cut into, fewest entities of such a block, and scores of a chunk.
BLOCK, FEW, LEAST, CHUNK = 8192, 4, 64, 1 << 19
#: The same of whole rankings, whose blocks of queries meet their pool's whole gallery, and rows of pairs that leave at a time.
RANKED, SOME, LONG, ROWS = 2048, 8, 1 << 21, 1 << 16
#: Partitions of units: more than units on a small input, so that few tasks have two of the large ones; few bytes of them make much work, by
#: which adaptive execution would put them together.
SPREAD = 64
#: Widens bounds, so that neither rounding nor the order of sums loses a target.
SLACK = 1e-8
#: Steps of the ninth digit by which a matrix product may be off.
EDGE = 1e-4

Features = dict[str, np.ndarray]


@dataclass(frozen=True)
class Scorer:
    """``kernel`` makes the matrix of scores from features by name, one row an entity, ``exact`` the scores of single pairs (row by row) where
    the matrix is only near; ``near`` is by how much. Names of the features of both sides differ."""

    queries: DataFrame
    gallery: DataFrame
    q: tuple[str, ...]
    t: tuple[str, ...]
    kernel: Callable[[Features, Features], np.ndarray]
    exact: Callable[[Features, Features], np.ndarray] | None = None
    near: float = SLACK
    #: Numbers that the kernel holds for each score.
    held: int = 1

    def where(self, condition: str | Column) -> Scorer:
        return replace(self, queries=self.queries.where(condition), gallery=self.gallery.where(condition))


def _side(table: pa.Table, name: str, names: tuple[str, ...]) -> tuple[pa.Array, Features, np.ndarray]:
    """Ids in order, features in that order, and which entities lack one."""
    ids = table[name].combine_chunks()
    order = np.argsort(np.array(ids.to_pylist(), dtype=object), kind="stable")  # code points order as UTF-8 does
    out, lacking = {}, np.zeros(len(ids), bool)
    for feature in names:
        column = table[feature].combine_chunks()
        null = column.is_null().to_numpy(zero_copy_only=False)
        if pa.types.is_list(column.type):
            sizes = np.diff(column.offsets.to_numpy())[~null]
            if len(set(sizes.tolist())) > 1:
                raise ValueError(f"vectors of {feature} differ in length")
            inner = column.drop_null().flatten()
            if pa.types.is_list(inner.type):
                raise ValueError(f"{feature} is nested")
            values = inner.to_numpy(zero_copy_only=False)
            whole = np.zeros((len(ids), int(sizes[0]) if len(sizes) else 0), values.dtype)
            whole[~null] = values.reshape(len(sizes), -1)
        else:
            whole = column.to_numpy(zero_copy_only=False)
        if null.any():
            lacking |= null
        out[feature] = whole[order]
    return ids.take(pa.array(order)), out, lacking[order]


def _rows(features: Features, at, names: tuple[str, ...] | None = None) -> Features:
    """Of all features, or of those with ``names`` (kernels may keep things of their own beside a block's features)."""
    return {n: features[n][at] for n in names or features}


@dataclass
class Unit:
    """A block of queries and one of targets; columns of the matrices are targets in the order of their ids."""

    scorer: Scorer
    pool: tuple[str, str]
    query_ids: pa.Array
    target_ids: pa.Array
    qf: Features
    tf: Features
    no_q: np.ndarray
    no_t: np.ndarray

    def chunks(self, held: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, scores for ordering): null scores are -inf, NaN is +inf."""
        step = max(1, (held or CHUNK) // max(1, len(self.target_ids) * self.scorer.held))
        for at in range(0, len(self.query_ids), step):
            yield at, self.scores(at, at + step)

    def scores(self, at: int, to: int, some: slice = slice(None)) -> np.ndarray:
        """Of the queries from ``at`` to ``to`` with all or ``some`` targets."""
        score = self.scorer.kernel(_rows(self.qf, slice(at, to)), self.tf if some == slice(None) else _rows(self.tf, some, self.scorer.t))
        bad = np.isnan(score)
        if bad.any():
            score = np.where(bad, np.inf, score)
        if self.no_q.any() or self.no_t.any():
            score = np.where(self.no_q[at:to, None] | self.no_t[None, some], -np.inf, score)
        return score

    def pair_scores(self, rows: np.ndarray, cols: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Scores of single pairs, exact where the scorer can."""
        if self.scorer.exact is None or not len(rows):
            return near
        got = self.scorer.exact(_rows(self.qf, rows), _rows(self.tf, cols, self.scorer.t))
        return np.where(np.isfinite(near), np.where(np.isnan(got), np.inf, got), near)

    def table(self, schema: pa.Schema, **columns) -> pa.Table:
        n = len(next(iter(columns.values())))
        pools = {c: pa.repeat(pa.scalar(v, pa.string()), n) for c, v in zip(POOL, self.pool)}
        return pa.table([pa.array(x) if not isinstance(x, pa.Array) else x for x in (pools | columns).values()], names=[*pools, *columns]).select(schema.names).cast(schema)


def arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def met(scorer: Scorer, run: Callable[[Unit, pa.Schema], pa.Table], schema: str, more: tuple[str, ...] = (), size: int | None = None, whole: bool = False) -> DataFrame:
    """What ``run`` makes of every unit. ``more`` names further columns of the queries that it reads, as features. With ``whole`` each pool is
    one unit, for small ones."""
    size = size or BLOCK
    queries = scorer.queries.select(*QUERY, *scorer.q, *more)
    gallery = scorer.gallery.select(*POOL, "target_id", *scorer.t)

    def parts(rows: DataFrame, name: str) -> DataFrame:  # one row a pool
        few = F.least(F.lit(FEW), F.ceil(F.count("*") / LEAST))
        n = F.lit(1) if whole else F.greatest(F.lit(1), few, F.ceil(F.count("*") / size))
        return rows.select(*POOL).groupBy(*POOL).agg(F.count("*").alias("_"), n.cast("int").alias(name)).drop("_")

    counts = F.broadcast(parts(scorer.queries, "_nq").join(parts(scorer.gallery, "_nt"), POOL))

    def dealt(rows: DataFrame, name: str, own: str, n_own: str, other: str, n_other: str) -> DataFrame:
        rows = rows.join(counts, POOL).withColumn(own, F.pmod(F.xxhash64(name), F.col(n_own)).cast("int"))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(n_other) - 1))).drop("_nq", "_nt")

    keys = [*POOL, "_i", "_j"]
    left = dealt(queries, "query_id", "_i", "_nq", "_j", "_nt").groupBy(*keys)
    right = dealt(gallery, "target_id", "_j", "_nt", "_i", "_nq")
    right = right.select(*[F.col(c).alias(f"_t_{c}" if c in keys else c) for c in right.columns]).groupBy(*[f"_t_{c}" for c in keys])
    out = arrow_schema(schema)
    q_names, t_names = (*scorer.q, *more), scorer.t
    bare = replace(scorer, queries=None, gallery=None)

    def unit(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return out.empty_table()
        query_ids, qf, no_q = _side(a, "query_id", q_names)
        target_ids, tf, no_t = _side(b, "target_id", t_names)
        pool = tuple(a[c][0].as_py() for c in POOL)
        return run(Unit(bare, pool, query_ids, target_ids, qf, tf, no_q, no_t), out)

    return left.cogroup(right).applyInArrow(unit, schema)


def best_columns(score: np.ndarray, k: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of all scores that can be among a row's ``k`` best: those within ``slack`` of a bound below the k-th best, which is the k-th
    largest of the maxima of groups of columns."""
    n = score.shape[1]
    if k >= n:
        return tuple(x.ravel() for x in np.indices(score.shape))
    wide = min(16, max(1, n // (2 * k)))
    whole = n // wide * wide
    tops = score[:, :whole].reshape(len(score), -1, wide).max(axis=2) if wide > 1 else score
    bound = np.partition(tops, tops.shape[1] - k, axis=1)[:, tops.shape[1] - k]
    return np.nonzero(score >= (bound - slack * (1 + np.where(np.isfinite(bound), np.abs(bound), 0)))[:, None])


def _first(rows: np.ndarray, cols: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's ``k`` best, by 9 digits, ties to the smaller column."""
    order = np.lexsort((cols, -np.round(score, 9), rows))
    r = rows[order]
    starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, int)
    within = np.arange(len(r)) - np.repeat(starts, np.diff(np.r_[starts, len(r)]))
    return order[within < k]


def candidates(scorer: Scorer, k: int, size: int | None = None) -> DataFrame:
    """Each query's ``k`` best targets of every block: (pair, score)."""

    def run(unit: Unit, schema: pa.Schema) -> pa.Table:
        found = []
        for at, score in unit.chunks():
            rows, cols = best_columns(score, k, unit.scorer.near)
            got = unit.pair_scores(rows + at, cols, score[rows, cols])
            keep = _first(rows, cols, got, k)
            found.append((rows[keep] + at, cols[keep], got[keep]))
        rows, cols, got = (np.concatenate(x) for x in zip(*found))
        values = pa.array(np.where(got == np.inf, np.nan, got), mask=got == -np.inf)
        return unit.table(schema, query_id=unit.query_ids.take(pa.array(rows)), target_id=unit.target_ids.take(pa.array(cols)), score=values)

    return met(scorer, run, "dataset string, split string, query_id string, target_id string, score double", size=size)


def best(scorer: Scorer, k: int, size: int | None = None) -> DataFrame:
    """Each query's ``k`` best targets, as ``ranking.rank(scores, k)`` of all pairs gives them."""
    return rank(candidates(scorer, k, size), k)


def last(scorer: Scorer) -> DataFrame:
    """Each query's last target, with a rank beyond every other."""
    minus = lambda f: f and (lambda a, b: -f(a, b))
    worst = candidates(replace(scorer, kernel=minus(scorer.kernel), exact=minus(scorer.exact)), 1).withColumn("score", -F.col("score"))
    return worst.groupBy(*QUERY).agg(F.min(F.struct(F.round("score", 9).alias("at"), "score", "target_id")).alias("w")).select(*QUERY, "w.target_id", "w.score", F.lit((1 << 31) - 1).alias("rank"))


def beaten(scorer: Scorer, pairs: DataFrame, size: int | None = None) -> DataFrame:
    """Rank of each of ``pairs`` (pair, score) in the whole ranking of its query, without a ranking: the targets that beat it are counted as
    scores are made. (pair, rank)"""
    queries = scorer.queries.join(pairs.select(*QUERY, F.col("target_id").alias("_true"), F.round("score", 9).alias("_best")), QUERY)

    def run(unit: Unit, schema: pa.Schema) -> pa.Table:
        true, least = unit.qf["_true"], unit.qf["_best"].astype(np.float64)
        names = np.array(unit.target_ids.to_pylist(), dtype=object)
        n, slack = np.zeros(len(true), np.int64), unit.scorer.near
        for at, score in unit.chunks():
            bound = least[at : at + len(score), None]
            wide = slack * (1 + np.abs(bound))
            above, close = score > bound + wide, score >= bound - wide
            n[at : at + len(score)] += above.sum(axis=1)
            rows, cols = np.nonzero(close & ~above)
            got = np.round(unit.pair_scores(rows + at, cols, score[rows, cols]), 9)
            best_, own = least[rows + at], true[rows + at]
            wins = (names[cols] != own) & ((got > best_) | ((got == best_) & (names[cols] < own)))
            np.add.at(n, rows[wins] + at, 1)
        return unit.table(schema, query_id=unit.query_ids, target_id=pa.array(true, pa.string()), n=n)

    schema = "dataset string, split string, query_id string, target_id string, n long"
    counts = met(replace(scorer, queries=queries), run, schema, ("_true", "_best"), size)
    return counts.groupBy(*PAIR).agg((F.sum("n") + 1).alias("rank"))


def streamed(scorer: Scorer, run: Callable[[Unit, pa.Schema], Iterator[pa.Table]], schema: str, more: tuple[str, ...] = (), size: int | None = None) -> DataFrame:
    """What ``run`` yields of every block of queries with its pool's whole gallery, for results that need all of a query's scores at once. It leaves
    the unit as it is made, so that a task holds a gallery, a block of queries and ``LONG`` scores (one query's, if these are more)."""
    size = size or RANKED
    few = F.least(F.lit(SOME), F.ceil(F.count("*") / LEAST))
    parts = scorer.queries.groupBy(*POOL).agg(F.greatest(few, F.ceil(F.count("*") / size)).cast("int").alias("_n"))  # one row a pool
    counts = F.broadcast(parts.join(scorer.gallery.select(*POOL).distinct(), POOL))
    left = scorer.queries.select(*QUERY, *scorer.q, *more).join(counts, POOL).withColumn("_i", F.pmod(F.xxhash64("query_id"), F.col("_n")).cast("int"))
    right = scorer.gallery.select(*POOL, "target_id", *scorer.t).join(counts, POOL).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    both = left.withColumn("_query", F.lit(True)).unionByName(right.withColumn("_query", F.lit(False)), allowMissingColumns=True).drop("_n")
    out = arrow_schema(schema)
    q_names, t_names = (*scorer.q, *more), scorer.t
    bare = replace(scorer, queries=None, gallery=None)

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        a, b = rows.filter(rows["_query"]), rows.filter(pc.invert(rows["_query"]))
        if a.num_rows and b.num_rows:
            pool = tuple(a[c][0].as_py() for c in POOL)
            query_ids, qf, no_q = _side(a, "query_id", q_names)
            target_ids, tf, no_t = _side(b, "target_id", t_names)
            del rows, a, b
            for part in run(Unit(bare, pool, query_ids, target_ids, qf, tf, no_q, no_t), out):
                yield from part.to_batches(ROWS)

    return both.repartition(SPREAD, *POOL, "_i").groupBy(*POOL, "_i").applyInArrow(unit, schema)


def _nine(unit: Unit, at: int, score: np.ndarray) -> np.ndarray:
    """Minus the scores in steps of the ninth digit, as whole numbers; infinities stay. Scores so close to the edge of a step that the matrix may
    have put them on its wrong side are made again, so that equal vectors stay equal."""
    steps = score * -1e9
    with np.errstate(invalid="ignore"):
        whole = np.rint(steps)
        rows, cols = np.nonzero(np.abs(steps - whole) > 0.5 - EDGE)
    whole[rows, cols] = np.rint(unit.pair_scores(rows + at, cols, score[rows, cols]) * -1e9)
    return whole


def ascending(whole: np.ndarray) -> np.ndarray:
    """Columns of each row in the order of its whole numbers, ties to the smaller column: number and column are sorted as one integer, where
    these fit."""
    n = whole.shape[1]
    bits = max(1, (n - 1).bit_length())
    most = 2.0 ** (62 - bits)
    size = np.abs(whole)
    top = size.max(initial=0)
    if top == np.inf:
        top = size.max(initial=0, where=size < np.inf)
    if top >= most:
        return np.argsort(whole, axis=1, kind="stable")
    codes = np.clip(whole, -most, most).astype(np.int64)
    codes <<= bits
    codes |= np.arange(n)
    codes.sort(axis=1)
    codes &= (1 << bits) - 1
    return codes


def orders(unit: Unit) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, each query's targets from best to last, as places in ``target_ids``). Rows of one query id are ranked together, at the first of
    them."""
    ids = np.array(unit.query_ids.to_pylist(), dtype=object)
    starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    if len(starts) == len(ids):
        for at, score in unit.chunks(LONG):
            yield at, ascending(_nine(unit, at, score))
        return
    for at, to in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)]):
        yield at, ascending(_nine(unit, at, unit.scores(at, to)).T.reshape(1, -1)) // (to - at)


def submission(scorer: Scorer, size: int | None = None) -> DataFrame:
    """``ranking.submission`` of all pairs' ranking: (query, target_id_ranking)."""

    def run(unit: Unit, schema: pa.Schema) -> Iterator[pa.Table]:
        for at, order in orders(unit):
            names = pa.ListArray.from_arrays(pa.array(np.arange(len(order) + 1) * order.shape[1], pa.int32()), unit.target_ids.take(pa.array(order.ravel())))
            yield unit.table(schema, query_id=unit.query_ids.slice(at, len(order)), target_id_ranking=pc.binary_join(names, " "))

    return streamed(scorer, run, "dataset string, split string, query_id string, target_id_ranking string", size=size)


def shortlist_then_tail(scorer: Scorer, heads: DataFrame, size: int | None = None) -> DataFrame:
    """``ranking.shortlist_then_tail`` of all pairs' ranking: a query's shortlist in ``heads`` (pair, place) comes first, then its other targets as
    the scorer ranks them. (pair, rank)"""
    lists = heads.groupBy(*QUERY).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "target_id"))), lambda x: x["target_id"]).alias("_list"))
    longest = lists.groupBy(*POOL).agg(F.max(F.size("_list")).alias("_long"))  # one row a pool
    queries = scorer.queries.join(lists, QUERY, "left").join(F.broadcast(longest), POOL, "left")
    own = F.coalesce("_list", F.array().cast("array<string>"))
    filled = F.concat(own, F.array_repeat(F.lit(None).cast("string"), F.coalesce("_long", F.lit(0)) - F.size(own)))

    def run(unit: Unit, schema: pa.Schema) -> Iterator[pa.Table]:
        n, lists = len(unit.target_ids), unit.qf["_head"]
        first = pc.index_in(pa.array(lists.ravel().tolist(), pa.string()), value_set=unit.target_ids, skip_nulls=True)
        first = np.asarray(first.fill_null(-1)).reshape(lists.shape)
        ranks, chosen = np.arange(1, n + 1, dtype=np.int32), np.zeros(n, bool)
        for at, order in orders(unit):
            for i, row in enumerate(order):
                head = first[at + i][first[at + i] >= 0]
                if len(head):
                    chosen[head] = True
                    order[i] = np.concatenate([head, row[~chosen[row]]])
                    chosen[head] = False
            for i in range(0, len(order), step := max(1, ROWS * 4 // n)):
                part = order[i : i + step]
                rows = at + i + np.repeat(np.arange(len(part)), part.shape[1])
                yield unit.table(schema, query_id=unit.query_ids.take(pa.array(rows)), target_id=unit.target_ids.take(pa.array(part.ravel())), rank=np.tile(ranks, len(part)))

    return streamed(replace(scorer, queries=queries.withColumn("_head", filled)), run, "dataset string, split string, query_id string, target_id string, rank int", ("_head",), size)


def flipped(scorer: Scorer) -> Scorer:
    """Targets as queries and queries as targets."""
    swap = lambda f: None if f is None else (lambda a, b: f(b, a))
    turned = swap(scorer.kernel)
    queries = scorer.gallery.withColumnRenamed("target_id", "query_id")
    gallery = scorer.queries.withColumnRenamed("query_id", "target_id")
    return replace(scorer, queries=queries, gallery=gallery, q=scorer.t, t=scorer.q, kernel=lambda a, b: turned(a, b).T, exact=swap(scorer.exact))


def dot(queries: DataFrame, gallery: DataFrame, q: str = "qv", t: str = "tv", divided: float = 1.0) -> Scorer:
    """``scoring.dot_scores``."""

    def kernel(a: Features, b: Features) -> np.ndarray:
        score = a[q].astype(np.float64, copy=False) @ b[t].astype(np.float64, copy=False).T
        return score if divided == 1 else score / divided

    return Scorer(queries, gallery, (q,), (t,), kernel, lambda a, b: np.einsum("ij,ij->i", a[q].astype(np.float64), b[t].astype(np.float64)) / divided)
