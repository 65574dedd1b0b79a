"""The corpus queries with SQL against DuckDB: on the smallest tables, and on planted and odd rows."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from arbalest.llm import licenses, queries, url_filter
from llm_cases import TEXTS
from test_queries import DATA, rows

duckdb = pytest.importorskip("duckdb")


def compare(spark, folder, name, odd=False):
    con = duckdb.connect()
    for table in os.listdir(folder):
        con.sql(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{table}'")
    got = queries.queries()[name](spark, folder).toPandas()
    want = con.sql(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))
    return got


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_on_the_smallest_tables(spark, name):
    compare(spark, DATA, name)


def test_licences_and_mixing_on_planted_rows(spark, tmp_path):
    texts = [t for t in TEXTS if t is None or len(t) < 10_000] * 2
    for label, _, text in licenses.TEMPLATES:
        ws = text.split()
        texts += [text.upper(), f"one two {' '.join('x' if i % 6 == 2 else w for i, w in enumerate(ws))} three", " ".join(reversed(ws)), f"{text}. {text}; cc by nc"]
    docs = [{"doc_id": None if i % 9 == 8 else i // 2, "text": t, "lang": "en", "source": None if i % 4 == 0 else f"s{i % 3}", "n_chars": 0} for i, t in enumerate(texts)]
    pq.write_table(pa.Table.from_pylist(docs, pq.read_schema(f"{DATA}/documents.parquet")), tmp_path / "documents.parquet", row_group_size=20)
    got = compare(spark, str(tmp_path), "op4_license_scan")
    assert set(",".join(got.labels).split(",")) >= {t[0] for t in licenses.TEMPLATES}
    for name in ("op3_mix_sources", "op5_shard", "op7_substring_dedup"):
        compare(spark, str(tmp_path), name)


def test_url_cascade_of_several_levels(spark, tmp_path, monkeypatch):
    hosts = [f"{'www.' * (i % 2)}{name}.example.org" for i in range(3000) for name in (f"n{i}",)] + [f"{x}.example.com" for x in url_filter.LISTED_NAMES] + list(url_filter.LISTED)
    urls = [None, "", "x" * 300_000, f"http://{'a.' * 50_000}ads-track.example.org/{'p' * 100_000}", f"http://{'b.' * 50_000}c/", "http://.../x", "http://..org/fr/", *(f"HTTPS://{h}/fr/x?y" for h in hosts), *(f"https://{h}" for h in hosts[::7])]
    pages = pa.table({"page_id": pa.array(range(len(urls)), pa.int64()), "url": urls, "html": [""] * len(urls)})
    pq.write_table(pages, tmp_path / "pages.parquet", row_group_size=500)
    names = tuple(f"n{i}" for i in range(0, 3000, 4))
    monkeypatch.setattr(url_filter, "LISTED", url_filter.LISTED + tuple(f"{n}.example.org" for n in names))
    found, made = [], url_filter.Cascade.__init__
    monkeypatch.setattr(url_filter.Cascade, "__init__", lambda self, *a: (made(self, *a), found.append(len(self.levels)))[0])
    got = compare(spark, str(tmp_path), "op6_url_filter")
    assert found and found[0] >= 3 and (got.verdict == "block").sum() > 100
    parts = url_filter.judge(spark.read.parquet(f"{tmp_path}/pages.parquet"), max_words=64).toPandas()
    assert len(found) > 3 and rows(parts, sorted(parts.columns)) == rows(got, sorted(parts.columns))


def test_a_word_made_to_collide(spark, tmp_path):
    """This word once had the hash of ``license``."""
    word = b"qkhylxws\xc9\xbfb0y\xdf\x935".decode()
    texts = [f"under the mit {word} here", "under the mit license here", f"apache {word} version 2", "apache license version 2"]
    docs = [{"doc_id": i, "text": t, "lang": "en", "source": "s", "n_chars": 0} for i, t in enumerate(texts)]
    pq.write_table(pa.Table.from_pylist(docs, pq.read_schema(f"{DATA}/documents.parquet")), tmp_path / "documents.parquet")
    got = compare(spark, str(tmp_path), "op4_license_scan")
    assert got.sort_values("doc_id").n_base.tolist() == [0, 1, 0, 1]
    for name in ("op7_substring_dedup", "op3_mix_sources"):
        compare(spark, str(tmp_path), name)
