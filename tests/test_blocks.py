"""Rankings by blocks against the same rankings of all pairs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arbalest.functions import vectors as V
from arbalest.operators import block_scorers, blocks, classifier, evaluation, kernels, losses, ranking, rerank, scoring, validation
from arbalest.plans import cascades, catalogue, views
from arbalest.plans import evaluation as evaluation_plans

DATA = "/root/testdata/sf0.001"
KEYS = ["dataset", "split", "query_id", "rank"]


@pytest.fixture(scope="module")
def sides(spark, tmp_path_factory):
    out = []
    for n, rows in enumerate((views.queries(spark, DATA), views.linked(spark, DATA), views.truth(spark, DATA))):
        path = str(tmp_path_factory.mktemp("sides") / str(n))
        rows.where("dataset <> 'dataset3'").write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def same(got, want, atol=1e-9):
    a, b = (x.toPandas().sort_values(KEYS).reset_index(drop=True) for x in (got, want))
    assert len(a) == len(b) > 0 and (a.target_id == b.target_id).all() and np.allclose(a.score, b.score, atol=atol)


def test_robust_information_and_probability(spark, sides):
    q, t, _ = sides
    want = ranking.rank(scoring.robust_nmi_scores(q, t, 8, 32), 5)
    same(blocks.best(block_scorers.robust_nmi(q, t, 8, 32), 5), want)
    same(blocks.best(block_scorers.robust_nmi_volumes(q, t, 8, 32), 5), want)
    model = classifier.fit(q.join(t.select("p", "target_id", "tv"), "p").select("query_id", "target_id", "qv", "tv"), rounds=3)
    same(blocks.best(block_scorers.probability(q, t, model), 5), ranking.rank(classifier.probability_scores(q, t, model), 5))


def test_sinkhorn_by_factors(spark, sides):
    q, t, _ = sides
    want = ranking.rank(rerank.sinkhorn_steps(rerank.csls(scoring.dot_scores(q, t), 5), 0.1, 2), 5)
    scorer = block_scorers.csls(blocks.dot(q, t), 5)
    same(block_scorers.sinkhorn(scorer, 0.1, 2, 5), want)
    same(block_scorers.sinkhorn(scorer, 0.1, 2, 5, most=10), want)


def test_many_blocks_copies_and_nulls(spark, sides):
    q, t, truth = sides
    copies = t.unionByName(t.limit(40).withColumn("target_id", F.concat(F.lit("a"), "target_id")))
    same(blocks.best(blocks.dot(q, copies), 3, size=7), ranking.rank(scoring.dot_scores(q, copies), 3))
    ranks = lambda rows: sorted(tuple(r) for r in rows.collect())
    assert ranks(block_scorers.true_ranks(q, copies, truth)) == ranks(evaluation.counted_ranks(q, copies, truth, V.dot("qv", "tv")))
    gone = copies.withColumn("tv", F.when(~F.col("target_id").startswith("a"), F.col("tv")))
    got = blocks.best(blocks.dot(q, gone), 10_000)
    assert got.where("score is null").agg(F.min("rank")).first()[0] > got.where("score is not null and dataset = 'dataset1' and split = 'val'").agg(F.min("rank")).first()[0]
    assert got.count() == scoring.dot_scores(q, gone).count()


def listed(rows):
    return sorted(tuple(r) for r in rows.collect())


def test_whole_rankings_by_blocks(spark, sides):
    """Copies, null and repeated entities, scores of any size, and pools of one side alone."""
    q, t, _ = sides
    q, t = q.select(*scoring.POOL, "query_id", "qv"), t.select(*scoring.POOL, "target_id", "tv")
    copies = t.unionByName(t.limit(40).withColumn("target_id", F.concat(F.lit("a"), "target_id"))).unionByName(t.limit(3))
    copies = copies.withColumn("tv", F.when(~F.col("target_id").endswith("7"), F.col("tv"))).where("dataset <> 'dataset2' or split <> 'val'")
    twice = q.unionByName(q.limit(5).withColumn("qv", F.reverse("qv"))).where("dataset <> 'dataset1' or split <> 'val'")
    some = [ranking.submission(ranking.rank(scoring.dot_scores(*x))) for x in ((q, copies), (twice, copies))]
    assert listed(blocks.submission(blocks.dot(q, copies), size=7)) == listed(some[0]) != []
    assert listed(blocks.submission(blocks.dot(twice, copies))) == listed(some[1]) != []
    wide = copies.withColumn("tv", F.transform("tv", lambda x: x * 1e12))
    assert listed(blocks.submission(blocks.dot(q, wide))) == listed(ranking.submission(ranking.rank(scoring.dot_scores(q, wide))))
    assert blocks.submission(blocks.dot(q.limit(0), t)).count() == 0 == blocks.submission(blocks.dot(q, t.limit(0))).count()


def test_edges_of_the_ninth_digit_are_scored_again():
    """Two equal targets whose matrix scores fall on either side of an edge stay equal."""
    scorer = blocks.Scorer(None, None, ("qv",), ("tv",), lambda a, b: np.array([[0.3, 0.1234567885 + 2e-15, 0.1234567885 - 2e-15]]), lambda a, b: np.full(len(a["qv"]), 0.1234567887))
    ids = pa.array(["t0", "t1", "t2"])
    unit = blocks.Unit(scorer, ("d", "val"), pa.array(["q"]), ids, {"qv": np.zeros((1, 1))}, {"tv": np.zeros((3, 1))}, np.zeros(1, bool), np.zeros(3, bool))
    assert blocks._nine(unit, 0, scorer.kernel(None, None)).tolist() == [[-300000000, -123456789, -123456789]]
    assert blocks.ascending(np.array([[2.0, -np.inf, 2.0, np.inf, -7.0], [1e300, -1e300, 0, 0, 5]])).tolist() == [[1, 4, 0, 2, 3], [1, 2, 3, 4, 0]]


@pytest.mark.parametrize("name", ["full_ranking_submission", "submission_files", "submission_rows", "submission_coverage", "shortlist_cascade"])
def test_whole_rankings_need_no_row_a_pair(spark, monkeypatch, name):
    monkeypatch.setattr(scoring, "pairs", None)
    assert catalogue.load()[0][name](spark, DATA).count() > 0


def test_stand_ins_are_the_rows_of_the_submission(spark, sides):
    """Rows and blank rankings are those of whole rankings, also in pools without targets and in ones whose names are blank."""
    q, t, _ = sides
    t = t.where("dataset <> 'dataset1' or split <> 'val'").withColumn("target_id", F.when(F.col("dataset") == "dataset2", F.lit(" ")).otherwise(F.col("target_id")))
    q = q.unionByName(q.limit(3))
    whole = ranking.submission(ranking.rank(scoring.dot_scores(q, t)))
    got = ranking.stand_ins(q, t)
    assert got.count() == whole.count() > 0 and listed(validation.coverage(got, q)) == listed(validation.coverage(whole, q))
    for change in (lambda x: x, lambda x: evaluation_plans.damaged(spark, x)):
        assert listed(validation.row_checks(change(got))) == listed(validation.row_checks(change(whole)))


def test_balanced_scores_and_tails_by_blocks(spark, sides):
    """Sinkhorn's factors rank as Sinkhorn does, and shortlists of some queries, of several lengths, move to the head."""
    q, t, _ = sides
    want = ranking.rank(rerank.sinkhorn_steps(rerank.csls(scoring.dot_scores(q, t), 5), 0.1, 2)).persist()
    few = want.where("rank <= 4 and rank <= length(replace(query_id, '1', '11')) - 8")
    again = few.withColumn("score", F.round(F.rand(3), 1))
    again = again.select(*scoring.PAIR, "score").persist()
    heads = again.join(few.select(*scoring.PAIR, "rank"), scoring.PAIR).withColumn("place", F.struct((-F.round("score", 9)).alias("score"), "rank"))
    tails = listed(ranking.shortlist_then_tail(want, again).select(*scoring.PAIR, "rank"))
    for most in (1 << 22, 10):
        scorer = block_scorers.balanced(block_scorers.csls(blocks.dot(q, t), 5), 0.1, 2, most)
        same(blocks.best(scorer, 5), want.where("rank <= 5"))
        assert listed(blocks.shortlist_then_tail(scorer, heads, size=9)) == tails
    assert {r.n for r in few.groupBy("query_id").agg(F.count("*").alias("n")).collect()} >= {1, 2} and few.select("query_id").distinct().count() < q.count()


def test_pairs_are_described_together():
    random = np.random.default_rng(11)
    volumes = random.normal(size=(30, 4, 5, 3))
    volumes[::5, 0], volumes[3], volumes[4] = 0, 0, 2.5
    near = kernels.descriptors(volumes, 32)
    assert near.shape == (30, 8 * 60) and all(np.allclose(kernels.descriptor(v, 32), x, atol=1e-12) for v, x in zip(volumes, near))
    assert all(np.allclose(kernels._robusts(volumes, 32)[i], kernels.robust(v, 32), atol=1e-12) for i, v in enumerate(volumes))
    steps = sorted(np.ndindex(3, 3, 3), key=lambda s: (sum(abs(x - 1) for x in s), s))
    for a, b in zip(volumes, volumes[1:]):
        moved = max((np.roll(b, [x - 1 for x in s], (0, 1, 2)) for s in steps), key=lambda m: round(float((a * m).sum()), 9))
        assert (cascades.shift_alignment(a, b) == moved).all()
        x, y = (v[(np.abs(a) > 1e-6) & (np.abs(b) > 1e-6)] for v in (a, b))
        if len(x):
            assert (np.bincount(cascades._bins(x, 8) * 8 + cascades._bins(y, 8), minlength=64) == np.histogram2d(x, y, bins=8)[0].ravel()).all()


def test_sinkhorn_rounds_make_scores_once(spark, sides, monkeypatch):
    """A round is one pass, whose units see several parts of a gallery and tiles, and leaves one table; rows of one id share their sums."""
    q, t, _ = sides
    q, t = (x.where("split = 'val'") for x in (q, t))
    twice, copies = q.unionByName(q.limit(5).withColumn("qv", F.reverse("qv"))), t.unionByName(t.limit(4).withColumn("tv", F.reverse("tv")))
    for name, size in (("WIDE", 100), ("TILE", 60)):
        monkeypatch.setattr(block_scorers, name, size)
    tables = []
    kept = block_scorers.stage_and_free
    monkeypatch.setattr(block_scorers, "stage_and_free", lambda df: tables.append(df) or kept(df))
    got = block_scorers.sinkhorn(blocks.dot(twice, copies), 0.1, 2, 1000, most=10).select(*scoring.PAIR, F.round("score", 8).alias("score"))
    assert len(tables) == 3  # two rounds, and the factors
    want = rerank.sinkhorn_steps(scoring.dot_scores(twice, copies), 0.1, 2).select(*scoring.PAIR, F.round("score", 8).alias("score"))
    a, b = (sorted((r[:4], r.score) for r in x.collect()) for x in (got, want))
    assert [x for x, _ in a] == [x for x, _ in b] and np.allclose([x for _, x in a], [x for _, x in b], atol=2e-8)


def test_cross_entropy_needs_no_row_a_pair(spark, sides, monkeypatch):
    """Also with null vectors, pairs that are true twice or not there, and pools without truth."""
    q, t, truth = sides
    some = truth.where("dataset <> 'dataset2'").unionByName(truth.limit(3)).unionByName(truth.limit(1).withColumn("target_id", F.lit("none")))
    gone = t.withColumn("tv", F.when(~F.col("target_id").endswith("7"), F.col("tv")))
    want = [losses.binary_cross_entropy(scoring.dot_scores(q, x), y, 5.0).collect() for x, y in ((t, truth), (gone, some))]
    monkeypatch.setattr(scoring, "pairs", None)
    got = [block_scorers.binary_cross_entropy(q, x, y, 5.0).collect() for x, y in ((t, truth), (gone, some))]
    for a, b in zip(got, want):
        a, b = (sorted(map(tuple, x)) for x in (a, b))
        assert [(*x[:2], x[3]) for x in a] == [(*x[:2], x[3]) for x in b] != [] and np.allclose([x[2] for x in a], [x[2] for x in b], atol=2e-6)
    assert catalogue.load()[0]["bce_loss"](spark, DATA).count() == 6


def test_rankings_are_parsed_and_checked_where_they_are(spark, sides):
    """No ranking and no row a pair is shuffled, and results are those of rows."""
    q, t, _ = sides
    rows = [("q1", " b  a\tb c "), ("q2", ""), ("q3", None), ("q4", "x"), ("q5", "a b c"), ("q6", "c a z b")]
    sub = spark.createDataFrame(rows, "query_id string, target_id_ranking string")
    assert listed(validation.parse(sub, once=True)) == listed(validation.parse(sub)) == sorted([("q1", "b", 1), ("q1", "a", 2), ("q1", "c", 4), ("q4", "x", 1), ("q5", "a", 1), ("q5", "b", 2), ("q5", "c", 3), ("q6", "c", 1), ("q6", "a", 2), ("q6", "z", 3), ("q6", "b", 4)])
    queries = spark.createDataFrame([("d", "val", f"q{i}") for i in range(1, 9)], "dataset string, split string, query_id string")
    gallery = spark.createDataFrame([("d", "val", x) for x in "abc"], "dataset string, split string, target_id string")
    columns = ["query_id", "n_ranked", "n_repeated", "n_foreign", "n_targets", "valid"]
    assert listed(validation.whole_checks(sub, queries, gallery).select(columns)) == listed(validation.ranking_checks(sub, queries, gallery).select(columns)) != []
    whole = blocks.submission(blocks.dot(q, t)).select("query_id", "target_id_ranking")
    for made, name in ((validation.parse(whole, once=True), "parse"), (validation.whole_checks(whole, q, t), "whole_checks")):
        plan = made._jdf.queryExecution().executedPlan().toString()
        above = plan[: plan.index("FlatMapGroupsInArrow")] if "FlatMapGroupsInArrow" in plan else plan[: plan.index("Arrow", plan.index("Arrow") + 5)]
        assert "Exchange hashpartitioning(query_id" not in above, name


@pytest.mark.parametrize("width", [64, 300])
def test_information_is_counted_for_many_targets_at_once(monkeypatch, width):
    """Counts of all pairs are those of single ones: with zeros, constant and empty volumes, slabs, and volumes whose counts exceed a byte."""
    monkeypatch.setattr(block_scorers, "COUNTED", 7, raising=False)
    random = np.random.default_rng(5)
    x, y = random.normal(size=(9, width)), random.normal(size=(20, width))
    x[1, :9], x[2, 1:], x[3], x[4], y[5, 3], y[6], y[7] = 0, 0, 1.5, y[8], 0, 0, 1.5
    digits = lambda v: np.where(v > 0, np.minimum((np.abs(v) * 3).astype(int), 7), -1)
    for kernels_, (q, t), (a, b) in ((block_scorers._nmi_kernels(8), ("qd", "td"), (digits(x), digits(y))), (block_scorers._robust_kernels(8, 32), ("qr", "tr"), (x, y))):
        whole, single = kernels_
        want = np.stack([single({q: np.repeat(a[i : i + 1], len(b), axis=0)}, {t: b}) for i in range(len(a))])
        held = {t: b}
        assert all(np.allclose(whole({q: a}, held), want, atol=1e-12) for _ in range(2)) and ("_hot" in held) == (width < 256)
    slow = []
    monkeypatch.setattr(block_scorers, "_by_slab", lambda p, r, *_: slow.append(len(p) * len(r)) or np.zeros((len(p), len(r))))
    block_scorers._nmi_kernels(8)[0]({"qd": digits(x[:, :64])}, {"td": digits(y[:, :64])})
    assert sum(slow) == 0
