"""Byte-level BPE against the tiktoken library, its definition and exact round trips."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arbalest.llm import byte_bpe, queries
from llm_cases import document_rows

tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
RANKS = byte_bpe.read_ranks(tokenizers.path("byte_bpe_multi_50k.tiktoken"))
TOKENS = byte_bpe.Tokens(RANKS, tokenizers.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
BITS = ["a", "b", "the", " ", "  ", "\n", "'s", "'re", "'", "1", "23", "é", "ß", "日本", "\t", "!!", "?", "x'", "x ", " don't", "\r\n", "🙂", "\x1c", " ", "é"]
text = st.one_of(st.text(max_size=30), st.lists(st.sampled_from(BITS), max_size=14).map("".join))


@settings(max_examples=300, deadline=None)
@given(text)
def test_encodes_as_the_library_does(value):
    ids = TOKENS.encode(value)
    assert ids == LIBRARY.encode_ordinary(value) and TOKENS.decode(ids) == value.encode()


@settings(max_examples=300, deadline=None)
@given(text, st.lists(st.tuples(st.floats(0, 1), st.integers(0, 5), text), max_size=4))
def test_edits_and_appends_are_exact(value, edits):
    state = byte_bpe.Prefixes(TOKENS, value)
    for place, length, new in edits:
        start = int(place * len(state.text))
        state.edit(start, min(len(state.text), start + length), new)
        fresh = byte_bpe.Prefixes(TOKENS, state.text)
        assert (state.last, state.starts, state.places) == (fresh.last, fresh.starts, fresh.places)
        assert state.ids() == LIBRARY.encode_ordinary(state.text)
    for new in (" more", "\n", "s", "s"):
        assert state.append(new).ids() == LIBRARY.encode_ordinary(state.text)


def test_only_the_neighbourhood_of_an_edit_is_encoded_again(monkeypatch):
    state = byte_bpe.Prefixes(TOKENS, "word " * 20_000)
    asked, real = [], byte_bpe.Tokens.prefixes
    monkeypatch.setattr(byte_bpe.Tokens, "prefixes", lambda self, data, last=None: (asked.append(len(data) - len(last or ())), real(self, data, last))[1])
    state.edit(50_002, 50_003, "xyz")
    state.append("end")
    assert sum(asked) < 60 and state.ids() == LIBRARY.encode_ordinary(state.text)


def test_pairs_by_their_seams_and_by_definition():
    pick = random.Random(5)
    ids = sorted(TOKENS.bytes)
    for _ in range(20_000):
        a, b = (pick.choice(ids[:2000] if pick.random() < 0.5 else ids) for _ in "ab")
        assert TOKENS._apart(a, b) == (TOKENS.merged(TOKENS.bytes[a] + TOKENS.bytes[b]) == [a, b])


def test_vocabularies_of_any_ranks():
    """Parts that rank after their wholes, wholes that no merge reaches, and small caches."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 900, b"abc": 300, b"bc": 500, b"xyz": 301, b"aa": 302, b"aaa": 299, b"cd": 400, b"abcd": 298}
    tokens = byte_bpe.Tokens(ranks, r"\S+|\s+")
    assert not tokens.rising and tokens.encode("xyz xyzx") == [301, 32, *b"xyzx"]
    library = tiktoken.Encoding("odd", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    pick = random.Random(2)
    for _ in range(3000):
        value = "".join(pick.choice("abcdxyz ") for _ in range(pick.randrange(12)))
        assert tokens.encode(value) == library.encode_ordinary(value), value


def test_small_caches(monkeypatch):
    monkeypatch.setattr(byte_bpe, "KEPT_PIECES", 3)
    monkeypatch.setattr(byte_bpe, "KEPT_PAIRS", 5)
    monkeypatch.setattr(byte_bpe, "KEPT_TEXT", 10)
    value = " ".join(f"wörter{i} 日本{i}" for i in range(60))
    assert byte_bpe.Tokens(RANKS, tokenizers.PATTERN).encode(value) == LIBRARY.encode_ordinary(value)


def test_frames(spark, docs, empty):
    ids = byte_bpe.encode(docs, RANKS, tokenizers.PATTERN)
    rows = byte_bpe.decode(ids, RANKS).collect()
    assert len(rows) == len(document_rows()) and set(docs.columns) < set(rows[0].asDict())
    for r in rows:
        assert r.ids == LIBRARY.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert byte_bpe.encode(empty, RANKS, tokenizers.PATTERN, with_prefixes=True).collect() == []
    states = byte_bpe.encode(docs.selectExpr("doc_id", "text", "concat(' tail', doc_id) more", "'k' ids", "1 last", "2 `a.b`"), RANKS, tokenizers.PATTERN, with_prefixes=True)
    assert {"_ids", "_last", "a.b"} <= set(states.columns)
    for r in byte_bpe.append_texts(states, RANKS, tokenizers.PATTERN).collect():
        assert r.ids == LIBRARY.encode_ordinary(r.text) and r.text.endswith(r.more or "") and r.last == byte_bpe.Prefixes(TOKENS, r.text).last


def test_query_on_a_whole_table(spark, tmp_path):
    import pyarrow.parquet as pq

    folder = "/root/testdata/sf0.001"
    want = {r["doc_id"]: LIBRARY.encode_ordinary(r["text"] or "") for r in pq.read_table(f"{folder}/documents.parquet").to_pylist()}
    got = queries.op12_byte_bpe(spark, folder).collect()
    assert len(got) == len(want)
    for r in got:
        ids = want[r.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode_bytes(ids)).hexdigest()
