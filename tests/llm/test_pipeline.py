"""Each stage of the pipeline on its own input, and the pipeline without Parquet paths of its own."""

import re

import brute
import corpus_pipeline
from llm_cases import SCHEMA


def test_stages_keep_columns_and_decide(spark, docs, tmp_path):
    spark.createDataFrame([(1, "an item that no document holds in any way at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["language ID", "SimHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "sharding"]
    at, d = docs, str(tmp_path)
    first = steps["language ID"](spark, at, d)
    assert first.columns == docs.columns and all(re.search(r"[^\W\d_]", r.text) for r in first.collect())
    second = steps["SimHash near-dedup"](spark, first, d)
    assert second.columns == docs.columns
    assert second.count() == len(set(brute.alike([r.text for r in first.collect()])))
    third = steps["benchmark decontamination"](spark, second, d)
    assert sorted(map(str, third.collect())) == sorted(map(str, second.collect()))
    fourth = steps["mixing sources to target weights"](spark, third, d)
    assert fourth.columns == docs.columns and {r.doc_id for r in fourth.collect()} <= {r.doc_id for r in third.collect()}
    fifth = steps["sharding"](spark, fourth, d)
    assert fifth.count() == fourth.count()
    assert corpus_pipeline.run(spark, d).count() > 0


def test_stages_on_an_empty_table(spark, empty, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = spark.createDataFrame([], SCHEMA)
    for _, step in corpus_pipeline.STAGES:
        at = step(spark, at, str(tmp_path))
        assert at.collect() == []


def test_near_dedup_takes_simhash_components_and_verifies_them(spark, monkeypatch):
    """Texts of one fingerprint with few five-word shingles in common stay; one of a changed word, whose fingerprint is further off, goes."""
    from arbalest.llm import simhash

    asked, labelled = [], simhash.labelled
    monkeypatch.setattr(simhash, "labelled", lambda *a: asked.append(labelled(*a)) or asked[-1])
    words = lambda c: " ".join(f"{c}{i}" for i in range(60))
    rows = [(1, "x " * 300 + words("a")), (2, "x " * 300 + words("b")), (3, words("c")), (4, words("c").replace("c57 ", "d ")), (5, words("e"))]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == [1, 2, 3, 5]
    assert asked[0].select("root").distinct().count() < 5
