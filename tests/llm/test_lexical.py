"""Ranked search against plain Python: shards, blocks of items, both kinds of index, ties, nulls and repeated rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arbalest.llm import lexical
from llm_cases import document_rows


def terms(text):
    return re.findall(lexical.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=20):
    docs = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    n, total = len(docs), sum(d[2] for d in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    texts = {}
    for i, t in items:
        texts[i] = min((x for x in (texts.get(i), t) if x is not None), default=None)
    out = []
    for item, text in texts.items():
        found = []
        for i, c, size in docs:
            m = 75 + 25 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:k])]
    return Counter(out)


def run(spark, docs, items, k=20, parts=3):
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts).withColumns({c: F.lit("extra") for c in ("ids", "shard", "score", "term", "a.b")})
    items = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(1) for c in ("term", "weight", "doc_id")})
    got = lexical.search(docs, items, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return Counter(map(tuple, got.collect()))


def corpus(n, seed):
    pick = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Straße", "日本", "x1", "The"]
    weights = [1 / (i + 1) for i in range(len(words))]
    text = lambda size: " ".join(pick.choices(words, weights, k=size))
    docs = [(i if pick.random() < 0.97 else None, text(pick.choice((0, 3, 20, 60)))) for i in range(n)]
    docs += [(5, "same words here w1"), (5, "same words here w1"), (6, "same words here w1"), (900, None), (901, " ... "), (902, "w3-" * 5000)]
    docs += [(1000 + i, "one page copied again w2 w7") for i in range(60)]
    items = [(i, text(pick.choice((1, 4, 15)))) for i in range(25)] + [(100, None), (101, ""), (102, "nowhere found"), (None, "w1 w1 w2"), (3, "w9"), (103, "copied page"), (104, "SAME Words"), (3, None)]
    return docs, items


@pytest.mark.parametrize("shards, blocks, vocabulary", [(8 << 20, 1 << 17, 1 << 18), (2000, 40, 1 << 18), (2000, 1 << 17, 0)])
def test_search(spark, monkeypatch, shards, blocks, vocabulary):
    monkeypatch.setattr(lexical, "SHARD_BYTES", shards)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", blocks)
    monkeypatch.setattr(lexical, "VOCABULARY", vocabulary)
    docs, items = corpus(300, shards)
    want = brute(docs, items)
    assert run(spark, docs, items) == want and len(want) > 300
    if blocks == 40:
        assert run(spark, docs, items, 3, 1) == brute(docs, items, 3)


def test_odd_tables(spark, docs, empty):
    items = spark.createDataFrame([(1, "the fox and the dog"), (2, "word5 and3 and3")], "item_id long, text string")
    rows = [(r[0], r[1]) for r in document_rows()]
    assert Counter(map(tuple, lexical.search(docs, items).collect())) == brute(rows, [(1, "the fox and the dog"), (2, "word5 and3 and3")])
    assert lexical.search(empty, items).collect() == [] and lexical.search(docs, items.where("false")).collect() == []
    assert lexical.search(docs.where("doc_id = 3"), items).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, (1 << 63) - 1), max_size=40))
def test_integers_are_packed_and_unpacked(values):
    data, ends = lexical.packed(np.array(values, np.int64))
    assert lexical.unpacked(np.frombuffer(data, np.uint8)).tolist() == values and len(ends) == len(values)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 9)), min_size=1, max_size=25), st.integers(1, 5)), min_size=1, max_size=6), st.integers(1, 6))
def test_merge_of_lists(lists, k):
    made, want = [], Counter()
    m = np.full(31, 100)
    for entries, weight in lists:
        held = sorted(dict(entries).items())
        docs, times = np.array([d for d, _ in held]), np.array([t for _, t in held])
        data, _ = lexical.packed(np.stack([np.diff(docs, prepend=-1), times], axis=1).ravel())
        made.append((lexical._Postings(np.frombuffer(data, np.uint8), m, k), weight))
        for d, t in held:
            want[d] += weight * (1_000_000_000 * t // (1000 * t + 1200))
    assert lexical.ranked(made, k) == [(s, d) for d, s in sorted(want.items(), key=lambda x: (-x[1], x[0]))[:k]]
