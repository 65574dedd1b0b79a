"""The queries without SQL, and the pipeline, on whole small tables against plain Python."""

import math
from collections import Counter

import brute
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from arbalest.llm import decontamination, language_id, lm_score, queries, shingle_dedup
from llm_cases import TEXTS
from test_corpus_operators import brute_components, brute_fingerprint, brute_lm

TABLES = "/root/testdata/sf0.001"
QUESTION = "A baker sells 12 loaves to Anna Bell before noon and another 7 kg of flour to Émile after lunch. How many loaves does the baker sell in all?"


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """(folder, documents, benchmark): the test tables, planted rows and odd ones."""
    folder = tmp_path_factory.mktemp("tables")
    docs = pq.read_table(f"{TABLES}/documents.parquet").to_pylist()
    items = [*pq.read_table(f"{TABLES}/benchmark.parquet").to_pylist(), {"item_id": 900, "text": QUESTION}, {"item_id": 901, "text": None}, {"item_id": None, "text": "ha 3 km"}]
    moved = QUESTION.replace("12", "340").replace("Anna Bell", "Carl").replace("Émile", "Zoë Dunn")
    more = [*TEXTS[:-1], f"{docs[1]['text']}\n{moved}", f"{docs[5]['text']} {QUESTION.upper()} {docs[6]['text']}", f"{docs[0]['text']} extra", docs[1]["text"].upper(), f"{docs[9]['text']} {docs[10]['text']}"]
    more += [moved.replace("Carl", "12"), moved, f"{items[0]['text']} - {docs[3]['text']} {items[3]['text']}"]
    more += [f"{docs[k]['text']} {items[k]['text']}" for k in range(12, 20)]
    docs += [{"doc_id": 10_000 + i, "text": t, "lang": "en", "source": None if i % 3 else "src0", "n_chars": 0} for i, t in enumerate(more)]
    docs += [docs[2], docs[2] | {"doc_id": None}, docs[4] | {"source": None, "lang": None}, {"doc_id": None, "text": None, "lang": None, "source": None, "n_chars": None}]
    shape = pq.read_schema(f"{TABLES}/documents.parquet")
    pq.write_table(pa.Table.from_pylist(docs, shape), folder / "documents.parquet", row_group_size=60)
    pq.write_table(pa.Table.from_pylist(items, pq.read_schema(f"{TABLES}/benchmark.parquet")), folder / "benchmark.parquet")
    return str(folder), docs, items


def learned(docs):
    return brute.dictionaries((r["text"], r["lang"]) for r in docs if brute.remainder(r["doc_id"], 3) != 1)


def test_language_id(spark, tables):
    folder, docs, _ = tables
    known = learned(docs)
    want = []
    for r in docs:
        name, score = brute.language(r["text"], known)
        want.append((r["doc_id"], brute.remainder(r["doc_id"], 3) == 1, name, score))
    got = [(r.doc_id, r.held_out, r.lang_pred, r.score) for r in queries.op2_language_id(spark, folder).collect()]
    assert Counter(got) == Counter(want)


def test_decontamination(spark, tables):
    folder, docs, items = tables
    found = brute.leaks({(r["doc_id"], r["text"]) for r in docs}, {(r["item_id"], r["text"]) for r in items})
    want = Counter((doc, item, *rest) for (doc, _, item), rest in found.items())
    rows = queries.op8_decontaminate(spark, folder).collect()
    assert Counter((r.doc_id, r.item_id, r.n_tokens, r.n_covered, r.exact, r.first_token) for r in rows) == want
    assert all(math.isclose(r.coverage, r.n_covered / r.n_tokens) for r in rows)
    assert {item for _, item, *_ in want} >= {900, *range(12, 20)} and any(not exact for *_, exact, _ in want)


def test_pipeline(spark, tables):
    folder, docs, items = tables
    known = learned(docs)
    at = [r for r in docs if (p := brute.language(r["text"], known))[0] != "und" and p[1] >= language_id.MIN_MARGIN]
    assert 0 < len(at) < len(docs)
    unique = brute.keep_one(at)
    found = brute.leaks({(r["doc_id"], r["text"]) for r in unique}, {(r["item_id"], r["text"]) for r in items})
    clean = [r for r in unique if not any(d == r["doc_id"] and t == r["text"] for d, t, _ in found)]
    assert len(clean) < len(unique) < len(at)
    want = brute.sharded(brute.mixed(clean))
    got = corpus_pipeline.run(spark, folder).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard").collect()
    assert Counter(map(tuple, got)) == Counter(want)


COLLIDING = b"qkhylxws\xc9\xbfb0y\xdf\x935".decode()  # once had the hash of ``license``


def test_words_made_to_collide_are_different_words(spark):
    item = "please read the license before you copy any part of it"
    copies = [item, item.replace("license", COLLIDING)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*copies, "license", COLLIDING])], "doc_id long, text string")
    found = decontamination.leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {r.doc_id: (r.n_covered, r.exact) for r in found if r.exact and r.n_covered == r.n_tokens} == {0: (11, True)}
    assert sorted(r.doc_id for r in shingle_dedup.keep_one(docs).collect()) == [0, 1, 2, 3]


def test_lm_score_on_a_whole_table(spark, tables):
    folder, docs, _ = tables
    rows = [(r["doc_id"], r["text"]) for r in docs if len(r["text"] or "") < 100_000]
    small = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = Counter((i, *w[:2], round(w[2], 3), round(w[3], 2), *w[4:]) for (i, _), w in zip(rows, brute_lm(rows)))
    got = Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 3), round(r.score, 2), r.held_out, r.train_tokens) for r in lm_score.score(small).collect())
    assert sum((got & want).values()) >= len(rows) - 2 and len(got - want) <= 2  # a last digit may be rounded either way


def test_near_duplicates_on_a_whole_table(spark, tables):
    folder, docs, _ = tables
    fps = [brute_fingerprint(r["text"]) for r in docs]
    roots = brute_components(fps)
    least = {}
    for r, c in zip(docs, roots):
        if r["doc_id"] is not None:
            least[c] = min(least.get(c, r["doc_id"]), r["doc_id"])
    want = Counter((r["doc_id"], f"{f:016x}", least.get(c)) for r, f, c in zip(docs, fps, roots))
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in queries.op10_simhash(spark, folder).collect())
    assert got == want and len(set(roots)) < len(docs) - 20
