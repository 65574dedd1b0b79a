"""Projection heads for queries and targets, trained on pairs as a Spark job: contrastive, with mined triplets, and by self-training.

A head is a matrix; a vector's embedding is its unit-length product with it. The loss is symmetric cross entropy of each batch's logits against
its true pairs, and, with mined negatives, a hinge of (negative - positive + margin) besides. A training table holds batches as rows,
drawn in a seeded order. Each step sends the weights to the tasks, which add up the gradients of their batches; partial sums
are added up in ``FAN`` tasks before the driver takes the step (AdamW with decoupled decay, norm clipping, warm-up and cosine). So the driver
and each task hold weights and one batch, whatever the number of pairs, and a lost task only repeats its own batches.

Negatives are mined again every ``mine_every`` steps: all vectors are projected with the weights of then, and each anchor's best wrong targets
of its pool are found by blocks. Self-training takes the confident best targets of unlabelled pools as pairs, trains anew, and goes on
until they stay the same; each round is a table, and a job that is started again goes on after the last whole round.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbalest.functions import vectors as V
from arbalest.functions.text import hash_order
from arbalest.operators import fusion
from arbalest.operators.ranking import QUERY, rank
from arbalest.operators.rerank import TARGET
from arbalest.operators.scoring import PAIR, POOL, block_dot_scores
from arbalest.operators.splitting import numbered
from arbalest.sources.staging import located, stage

#: Tasks that add up partial sums before the driver does, where there are more.
FAN = 16


@dataclass(frozen=True)
class Settings:
    width: int = 32
    steps: int = 30
    batch: int = 128
    rate: float = 0.02
    warmup: int = 4
    decay: float = 0.01
    clip: float = 1.0
    temperature: float = 0.1
    margin: float = 0.2
    triplet_weight: float = 0.0
    mine_every: int = 10
    negatives: int = 3
    seed: int = 2026


@dataclass
class Heads:
    query: np.ndarray
    target: np.ndarray

    @property
    def both(self) -> list[np.ndarray]:
        return [self.query, self.target]


@dataclass
class Trained:
    heads: Heads
    losses: list[float] = field(default_factory=list)
    #: Negatives as they were mined: (step, table of (pair, score, rank)).
    mined: list[tuple[int, DataFrame]] = field(default_factory=list)


def initial(inputs: int, settings: Settings) -> Heads:
    random = np.random.default_rng(settings.seed)
    return Heads(*(random.normal(size=(inputs, settings.width)) / math.sqrt(inputs) for _ in range(2)))


def rate_at(step: int, settings: Settings) -> float:
    """Warm-up, then a cosine down to 0."""
    if step < settings.warmup:
        return settings.rate * (step + 1) / settings.warmup
    return settings.rate * 0.5 * (1 + math.cos(math.pi * (step - settings.warmup) / max(1, settings.steps - settings.warmup)))


def _embedded(x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    y = x @ w
    norm = np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
    return y / norm, norm


def _back(x: np.ndarray, u: np.ndarray, norm: np.ndarray, du: np.ndarray) -> np.ndarray:
    """Gradient of a head from that of its unit-length embeddings."""
    return x.T @ ((du - u * (u * du).sum(axis=1, keepdims=True)) / norm)


def contrast(q: np.ndarray, t: np.ndarray, heads: Heads, temperature: float) -> tuple[float, list[np.ndarray]]:
    """Mean symmetric cross entropy of a batch of pairs and its gradients."""
    (u, u_norm), (v, v_norm) = _embedded(q, heads.query), _embedded(t, heads.target)
    z, n = u @ v.T / temperature, len(q)
    loss, slope = 0.0, np.zeros_like(z)
    for axis in (1, 0):
        top = z.max(axis=axis, keepdims=True)
        share = np.exp(z - top)
        total = share.sum(axis=axis, keepdims=True)
        loss += float((np.log(total) + top).mean() - np.diag(z).mean()) / 2
        slope += (share / total - np.eye(n)) / (2 * n)
    slope /= temperature
    return loss, [_back(q, u, u_norm, slope @ v), _back(t, v, v_norm, slope.T @ u)]


def hinge(q: np.ndarray, p: np.ndarray, n: np.ndarray, heads: Heads, margin: float) -> tuple[float, list[np.ndarray]]:
    """Mean hinge of (negative - positive + margin) of a batch of triplets and its gradients."""
    (u, u_norm), (a, a_norm), (b, b_norm) = _embedded(q, heads.query), _embedded(p, heads.target), _embedded(n, heads.target)
    gap = (u * b).sum(axis=1) - (u * a).sum(axis=1) + margin
    live = (gap > 0)[:, None] / len(q)
    return float(np.maximum(gap, 0).mean()), [_back(q, u, u_norm, live * (b - a)), _back(p, a, a_norm, -live * u) + _back(n, b, b_norm, live * u)]


class AdamW:
    """Adam's moments with decoupled weight decay, after clipping of the joint gradient norm."""

    def __init__(self, settings: Settings, heads: Heads):
        self.settings, self.step = settings, 0
        self.mean, self.square = ([np.zeros_like(w) for w in heads.both] for _ in range(2))

    def update(self, heads: Heads, gradients: list[np.ndarray]) -> Heads:
        s, out = self.settings, []
        norm = math.sqrt(sum(float((g**2).sum()) for g in gradients))
        rate, self.step = rate_at(self.step, s), self.step + 1
        for i, (w, g) in enumerate(zip(heads.both, gradients)):
            g = g * min(1.0, s.clip / (norm + 1e-6))
            self.mean[i] = 0.9 * self.mean[i] + 0.1 * g
            self.square[i] = 0.999 * self.square[i] + 0.001 * g**2
            move = self.mean[i] / (1 - 0.9**self.step) / (np.sqrt(self.square[i] / (1 - 0.999**self.step)) + 1e-8)
            out.append(w - rate * (move + s.decay * w))
        return Heads(*out)


def batches(rows: DataFrame, names: list[str], order: list[str], settings: Settings) -> DataFrame:
    """(batch, n, and each column of vectors flattened): the rows in seeded order, ``settings.batch`` to a batch."""
    rows = rows.select(*order, *(V.doubles(c).alias(c) for c in names)).withColumn("_h", hash_order(settings.seed, F.concat_ws(" ", *order)))
    placed = numbered(rows, "_h", *order).withColumn("batch", F.floor(F.col("row_no") / settings.batch))
    held = F.sort_array(F.collect_list(F.struct("row_no", *names)))
    out = placed.groupBy("batch").agg(held.alias("_v"), F.count("*").alias("n"))
    return stage(out.select("batch", "n", *(F.flatten(F.col(f"_v.{c}")).alias(c) for c in names)))


def _total(table: DataFrame, names: list[str], heads: Heads, of: Callable[..., tuple[float, list[np.ndarray]]]) -> tuple[float, list[np.ndarray]]:
    """Mean loss and gradients over all rows of the batches."""
    shapes = [w.shape for w in heads.both]

    def result(sums: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"sums": [sums.tobytes()]})

    def gradients(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(2 + sum(w.size for w in heads.both))
        for frame in frames:
            for i in range(frame.num_rows):
                n = frame["n"][i].as_py()
                loss, gs = of(*(frame[c][i].values.to_numpy().reshape(n, -1) for c in names), heads)
                sums += n * np.concatenate([[1.0, loss], *(g.ravel() for g in gs)])
        yield pa.RecordBatch.from_pandas(result(sums))

    def added(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = sum(np.frombuffer(x.as_buffer()) for frame in frames for x in frame["sums"])
        if not isinstance(sums, int):
            yield pa.RecordBatch.from_pandas(result(sums))

    parts = table.mapInArrow(gradients, "sums binary")
    if table.rdd.getNumPartitions() > FAN:
        parts = parts.repartition(FAN).mapInArrow(added, "sums binary")
    sums = sum(np.frombuffer(r.sums) for r in parts.collect())  # FAN vectors of the weights' size at most
    n, loss, rest = sums[0], sums[1], sums[2:]
    gs, at = [], 0
    for shape in shapes:
        gs.append(rest[at : at + math.prod(shape)].reshape(shape) / max(n, 1.0))
        at += math.prod(shape)
    return float(loss / max(n, 1.0)), gs


def projected(rows: DataFrame, vector: str, weights: np.ndarray) -> DataFrame:
    """``rows`` with the vector's embedding in its place."""

    @F.pandas_udf("array<double>")
    def embed(v: pd.Series) -> pd.Series:
        return pd.Series(list(_embedded(np.stack(v), weights)[0]) if len(v) else [], dtype=object)

    return rows.withColumn(vector, embed(V.doubles(vector)))


def mined(queries: DataFrame, gallery: DataFrame, truth: DataFrame, heads: Heads, k: int) -> DataFrame:
    """Each query's best ``k`` wrong targets of its pool under the heads: (pair, score, rank)."""
    most = truth.groupBy(*QUERY).count().agg(F.max("count")).first()[0] or 0
    found = block_dot_scores(projected(queries, "qv", heads.query), projected(gallery, "tv", heads.target), k + most)
    return rank(found.drop("rank").join(truth.select(*PAIR), PAIR, "left_anti"), k)


def train(queries: DataFrame, gallery: DataFrame, truth: DataFrame, settings: Settings = Settings(), start: Heads | None = None) -> Trained:
    """Heads trained on the true pairs of (pool, query_id, qv) and (pool, target_id, tv). Without a pair they stay as they start."""
    pairs = stage(truth.select(*PAIR).join(queries.select(*QUERY, "qv"), QUERY).join(gallery.select(*TARGET, "tv"), TARGET))
    table = batches(pairs, ["qv", "tv"], PAIR, settings)
    first = pairs.select(F.size("qv")).first()
    heads = start or initial(first[0] if first else 1, settings)
    if first is None:
        return Trained(heads)
    optimiser, out, triplets = AdamW(settings, heads), Trained(heads), None
    for step in range(settings.steps):
        loss, gradients = _total(table, ["qv", "tv"], heads, lambda q, t, h: contrast(q, t, h, settings.temperature))
        if settings.triplet_weight:
            if step % settings.mine_every == 0:
                anchors = truth.select(*QUERY).distinct()
                hard = stage(mined(queries.join(anchors, QUERY, "left_semi"), gallery, truth, heads, settings.negatives))
                wrong = hard.select(*PAIR).join(gallery.select(*TARGET, F.col("tv").alias("nv")), TARGET)
                triplets = batches(wrong.join(pairs.select(*QUERY, "qv", F.col("tv").alias("pv")), QUERY), ["qv", "pv", "nv"], PAIR, settings)
                out.mined.append((step, hard))
            more, others = _total(triplets, ["qv", "pv", "nv"], heads, lambda q, p, n, h: hinge(q, p, n, h, settings.margin))
            loss += settings.triplet_weight * more
            gradients = [g + settings.triplet_weight * o for g, o in zip(gradients, others)]
        heads = optimiser.update(heads, gradients)
        out.losses.append(loss)
    out.heads = heads
    return out


def scored(queries: DataFrame, gallery: DataFrame, heads: Heads, k: int) -> DataFrame:
    """Each query's ``k`` best targets under the heads."""
    return block_dot_scores(projected(queries, "qv", heads.query), projected(gallery, "tv", heads.target), k)


def save(spark: SparkSession, heads: Heads, path: str) -> None:
    rows = [(i, *w.shape, w.ravel().tolist()) for i, w in enumerate(heads.both)]
    spark.createDataFrame(rows, "head int, inputs int, width int, weights array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Heads:
    return Heads(*(np.reshape(r.weights, (r.inputs, r.width)) for r in spark.read.parquet(path).orderBy("head").collect()))


@dataclass
class Round:
    number: int
    pseudo: DataFrame
    heads: Heads
    resumed: bool


def self_train(
    queries: DataFrame, gallery: DataFrame, truth: DataFrame, datasets: tuple[str, ...], folder: str, least: float = 0.65, rounds: int = 4, settings: Settings = Settings()
) -> list[Round]:
    """Rounds of training: the first on ``truth`` alone, each further one also on the pseudo-pairs of the round before, the best targets in
    ``datasets`` that score ``least`` or more. Ends when these stay the same, or after ``rounds``. A round's pseudo-pairs and
    heads are tables in ``folder``, the heads last; whole rounds found there are taken as they are."""
    spark, out = queries.sparkSession, []
    for number in range(rounds):
        path = f"{folder}/round-{number}"
        at, files = located(spark, f"{path}/heads/_SUCCESS")
        resumed = files.exists(at)
        if not resumed:
            known = truth.select(*PAIR)
            if out:
                known = known.unionByName(out[-1].pseudo.select(*PAIR))
            heads = train(queries, gallery, known, replace(settings, seed=settings.seed + number)).heads
            best = scored(queries.where(F.col("dataset").isin(*datasets)), gallery, heads, 1)
            fusion.pseudo_pairs(best.drop("rank"), least, datasets).write.mode("overwrite").parquet(f"{path}/pseudo")
            save(spark, heads, f"{path}/heads")
        out.append(Round(number, spark.read.parquet(f"{path}/pseudo"), load(spark, f"{path}/heads"), resumed))
        if len(out) > 1:
            a, b = (r.pseudo.select(*PAIR) for r in out[-2:])
            if a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty():
                break
    return out
