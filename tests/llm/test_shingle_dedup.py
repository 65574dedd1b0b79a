"""The near-dedup stage of the pipeline against every pair's Jaccard similarity, on planted near copies."""

import random

import pyarrow.parquet as pq

import corpus_pipeline
from arbalest.llm import shingle_dedup
from brute import lower, words


def brute_kept(rows):
    """Ids of the smallest document of each component of pairs with 5-word Jaccard >= 0.8."""
    sets = []
    for _, text in rows:
        ws = words(lower(text))
        sets.append({tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 9 * len(a & b) >= 4 * (len(a) + len(b)):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted({min(rows[j][0] for j in range(len(rows)) if find(j) == find(i)) for i in range(len(rows))})


def planted():
    rng, rows = random.Random(7), []
    texts = [r["text"] for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()]
    texts = [t for t in texts if t and len(t.split()) >= 40][:60]
    for text in texts:
        rows.append((len(rows), text))
        for share in (0, 0.01, 0.02, 0.03):
            ws = text.split()
            for at in rng.sample(range(len(ws)), max(1, round(share * len(ws)))):
                ws[at] = f"new{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(ws)))
    return [*rows, (9000, None), (9001, ""), (9002, " \n"), (9003, "two words"), (9004, "Two WORDS"), (9005, "two word")]


def test_near_copies_of_similarity_eight_tenths_go_and_others_stay(spark):
    rows = planted()
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, frame, "").collect())
    assert got == brute_kept(rows) and len(got) < len(rows) / 2


def test_pairs_beside_the_hub_are_found(spark):
    ws = [f"w{i}" for i in range(200)]
    half = [" ".join(ws[:k] + [f"x{k}"] + ws[k + 1 :]) for k in range(3, 200, 6)]  # each near the whole, which is absent
    chain = [" ".join(f"c{j}" for j in range(i * 8, i * 8 + 120)) for i in range(12)]
    rows = [(i, t) for i, t in enumerate(half + chain)] + [(None, half[0])]
    got = sorted(r.doc_id for r in shingle_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_kept(rows[:-1])
