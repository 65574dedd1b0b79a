"""Training of heads against a numpy loop over the same batches; mining against plain hard negatives; self-training rounds."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbalest.operators import fusion, heads, scoring
from arbalest.plans import training

SETTINGS = heads.Settings(width=5, steps=7, batch=16, warmup=2, mine_every=3, clip=0.3)
PAIRS = 45


def data(seed=1, width=8, pools=("d1", "d2")):
    random = np.random.default_rng(seed)
    q = random.normal(size=(PAIRS, width))
    t = 0.8 * q[:, ::-1] + 0.4 * random.normal(size=q.shape)
    return [pools[i % len(pools)] for i in range(PAIRS)], q, t


@pytest.fixture(scope="module")
def sides(spark):
    pools, q, t = data()
    frame = lambda name, vector, x: spark.createDataFrame([(p, "val", f"{name[0]}{i:03d}", v.tolist()) for i, (p, v) in enumerate(zip(pools, x))], f"dataset string, split string, {name} string, {vector} array<double>")
    truth = spark.createDataFrame([(p, "val", f"q{i:03d}", f"t{i:03d}") for i, p in enumerate(pools)], "dataset string, split string, query_id string, target_id string")
    return frame("query_id", "qv", q).repartition(3), frame("target_id", "tv", t).repartition(3), truth


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def loss_of(w, q, t, extra=None):
    """The loss as a function, whose gradients are taken by differences."""
    u, v = unit(q @ w[0]), unit(t @ w[1])
    z = u @ v.T / SETTINGS.temperature
    log = lambda a, axis: np.log(np.exp(a).sum(axis=axis))
    out = ((log(z, 1) - np.diag(z)).mean() + (log(z, 0) - np.diag(z)).mean()) / 2
    if extra is not None:
        a, p, n = unit(extra[0] @ w[0]), unit(extra[1] @ w[1]), unit(extra[2] @ w[1])
        out += np.maximum((a * n).sum(1) - (a * p).sum(1) + SETTINGS.margin, 0).mean()
    return out


def test_gradients_by_differences():
    random = np.random.default_rng(4)
    q, t, n = (random.normal(size=(9, 6)) for _ in range(3))
    h = heads.initial(6, SETTINGS)
    loss, gs = heads.contrast(q, t, h, SETTINGS.temperature)
    more, ms = heads.hinge(q, t, n, h, SETTINGS.margin)
    assert math.isclose(loss + more, loss_of(h.both, q, t, (q, t, n)))
    for i in range(2):
        for at in ((0, 0), (3, 2), (5, 4)):
            moved = [[w.copy() for w in h.both] for _ in range(2)]
            for sign, w in zip((1, -1), moved):
                w[i][at] += sign * 1e-6
            slope = (loss_of(moved[0], q, t, (q, t, n)) - loss_of(moved[1], q, t, (q, t, n))) / 2e-6
            assert math.isclose(slope, gs[i][at] + ms[i][at], rel_tol=1e-4, abs_tol=1e-7)


def looped(settings):
    """The same training in one process: batches in the order of the seeded hash, gradients averaged over rows, AdamW written out."""
    pools, q, t = data()
    key = lambda i, k: hashlib.sha256(f"{settings.seed}:{pools[i]} val q{i:03d} t{k:03d}".encode()).hexdigest()
    order = sorted(range(PAIRS), key=lambda i: key(i, i))
    h = heads.initial(q.shape[1], settings)
    w, m, s, losses, hard = h.both, [0, 0], [0, 0], [], []
    for step in range(settings.steps):
        loss, g = 0.0, [0.0, 0.0]

        def add(of, rows, weight):
            nonlocal loss, g
            for at in range(0, len(rows), settings.batch):
                some = rows[at : at + settings.batch]
                part, gs = of(some)
                loss += weight * part * len(some) / len(rows)
                g = [a + weight * b * len(some) / len(rows) for a, b in zip(g, gs)]

        now = heads.Heads(*w)
        add(lambda r: heads.contrast(q[r], t[r], now, settings.temperature), order, 1.0)
        if settings.triplet_weight:
            if step % settings.mine_every == 0:
                z = unit(q @ w[0]) @ unit(t @ w[1]).T
                hard = [(i, k) for i in range(PAIRS) for k in sorted((k for k in range(PAIRS) if k != i and pools[k] == pools[i]), key=lambda k: (-round(z[i, k], 9), k))[: settings.negatives]]
                hard.sort(key=lambda p: key(*p))
            add(lambda r: heads.hinge(*(x[[p[j] for p in r]] for x, j in ((q, 0), (t, 0), (t, 1))), now, settings.margin), hard, settings.triplet_weight)
        losses.append(loss)
        norm = math.sqrt(sum((x**2).sum() for x in g))
        g = [x * min(1, settings.clip / (norm + 1e-6)) for x in g]
        rate = settings.rate * ((step + 1) / settings.warmup if step < settings.warmup else 0.5 * (1 + math.cos(math.pi * (step - settings.warmup) / (settings.steps - settings.warmup))))
        for i in range(2):
            m[i], s[i] = 0.9 * m[i] + 0.1 * g[i], 0.999 * s[i] + 0.001 * g[i] ** 2
            w[i] = w[i] - rate * (m[i] / (1 - 0.9 ** (step + 1)) / (np.sqrt(s[i] / (1 - 0.999 ** (step + 1))) + 1e-8) + settings.decay * w[i])
    return w, losses


@pytest.mark.parametrize("weight, fan", [(0.0, 16), (0.4, 1)])
def test_training_equals_a_loop(spark, sides, monkeypatch, weight, fan):
    monkeypatch.setattr(heads, "FAN", fan)
    settings = heads.replace(SETTINGS, triplet_weight=weight)
    done = heads.train(*sides, settings)
    want, losses = looped(settings)
    assert np.allclose(done.losses, losses, atol=1e-9) and all(np.allclose(a, b, atol=1e-8) for a, b in zip(done.heads.both, want))
    assert done.losses[-1] < done.losses[0]
    assert [step for step, _ in done.mined] == ([0, 3, 6] if weight else [])


def test_mined_negatives_are_the_hardest(spark, sides):
    h = heads.initial(8, SETTINGS)
    q, t, truth = sides
    got = heads.mined(q, t, truth, h, 3)
    want = fusion.hard_negatives(scoring.dot_scores(heads.projected(q, "qv", h.query), heads.projected(t, "tv", h.target)), truth)
    rows = lambda frame: sorted((r.query_id, r.target_id, r["rank"]) for r in frame.collect())
    assert rows(got) == rows(want) and len(rows(got)) == 3 * PAIRS


def test_nothing_to_learn_from(spark, sides):
    q, t, truth = sides
    start = heads.initial(8, SETTINGS)
    done = heads.train(q, t, truth.where("false"), SETTINGS, start)
    assert done.heads is start and done.losses == []
    assert heads.scored(q.where("false"), t, start, 2).collect() == []


def test_self_training_stages_its_rounds(spark, sides, tmp_path):
    q, t, truth = sides
    settings = heads.replace(SETTINGS, steps=25, width=8, batch=64)
    known = truth.where("dataset = 'd1'")
    rounds = heads.self_train(q, t, known, ("d2",), str(tmp_path), 0.6, 5, settings)
    sets = [{(r.query_id, r.target_id) for r in x.pseudo.collect()} for x in rounds]
    assert 2 <= len(rounds) <= 5 and not any(r.resumed for r in rounds) and all(sets)
    assert all(a != b for a, b in zip(sets[:-2], sets[1:-1])) and (len(rounds) == 5 or sets[-1] == sets[-2])  # ends at the first repeat
    # a second run reads every round; one whose last round was cut off makes that one again, with the same result
    again = heads.self_train(q, t, known, ("d2",), str(tmp_path), 0.6, 5, settings)
    assert len(again) == len(rounds) and all(r.resumed for r in again)
    (tmp_path / f"round-{len(rounds) - 1}" / "heads" / "_SUCCESS").unlink()
    again = heads.self_train(q, t, known, ("d2",), str(tmp_path), 0.6, 5, settings)
    assert [r.resumed for r in again] == [True] * (len(rounds) - 1) + [False]
    assert all(np.allclose(a, b) for a, b in zip(again[-1].heads.both, rounds[-1].heads.both))
    # the first round is plain training on the labels
    assert all(np.allclose(a, b) for a, b in zip(rounds[0].heads.both, heads.train(q, t, known, settings).heads.both))


@pytest.mark.parametrize("name", ["contrastive_training", "mined_training"])
def test_held_out_ranking_improves(spark, name):
    rows = getattr(training, name)(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 3 and all(r.mrr > r.mrr_raw + 0.2 and r.loss_last < r.loss_first / 2 for r in rows)
    assert all(r.n_mined == (3 if name == "mined_training" else 0) for r in rows)


def test_self_training_query(spark):
    rows = training.self_training(spark, "/root/testdata/sf0.001").collect()
    last = max(r["round"] for r in rows)
    mean = lambda k, c: np.mean([r[c] for r in rows if r["round"] == k])
    assert last >= 1 and len(rows) == 4 * (last + 1) and mean(last, "mrr") >= mean(0, "mrr")
    assert all(r.n_right <= r.n_pseudo for r in rows)
