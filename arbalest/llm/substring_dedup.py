"""Substring deduplication by recompression.

Each text's words are parsed by rounds: first runs of one word are named by (word, length), then, in each further
round, names fall into left and right by a bit of their hash, and each left-right pair is named as one symbol. A name
is a 64-bit hash of what it stands for, so equal substrings get equal interior symbols in all documents and partitions
without a dictionary; only symbols at a window's edges depend on what stands around it. For every window the symbols
that no surroundings can change are tracked through the rounds, and the window is keyed by its longest such symbol
(ties: largest name, then leftmost). Equal windows thus always share their key symbol, at the same distance.

An occurrence is a run of windows of one text with one key symbol. Spark counts occurrences by symbol:
* a symbol that occurs once: its windows repeat nowhere;
* all its occurrences span equal words: all its windows repeat;
* else its distinct spans are compared window by window, in the texts, one representative for each distinct span.

Contract of ``remove_repeats``:
* words are runs of anything but space and \\x09-\\x0D; a null text has none; a window is ``size`` consecutive words
  of one text; each word that is covered by a window whose words also start anywhere else (same text included) is
  removed; all windows are judged on the input;
* one result row for each input row; rows that share id and text get equal results; null ids are allowed; texts shorter
  than a window lose nothing; an empty table gives an empty result; extra columns are ignored;
* repeats are verified on the words: spans and windows count as equal if their key symbols agree, at the same distance, and
  XXH3 of their words' own bytes, which no word hash goes into.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbalest.llm import kernels as K
from arbalest.llm.common import in_small_batches, stage, stage_and_free

U = np.uint64
WINDOW = 35
PAIR_BASE = 0xC2B2AE3D27D4EB4F
#: Pair rounds. A window can lose 1 + 2 + 4 + 8 words at either side at most, besides its first and last run.
ROUNDS = 4
NO_ID = -(1 << 63)


def parse(names: np.ndarray, owner: np.ndarray, windows: np.ndarray, size: int, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """Key symbol of each window: (place of the symbol's first word, or -1; its name).

    names: one per word; owner: text of each word; windows: first words.
    A window without a safe symbol (most of it is the run of one word) has place -1 and no name.
    """
    n = len(names)
    fresh = np.ones(n, bool)
    fresh[1:] = (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])
    place = np.flatnonzero(fresh)
    run = np.cumsum(fresh) - 1
    span = np.diff(np.append(place, n))
    name = np.where(span == 1, names[place], K.mix(names[place] ^ K.mix(span.astype(U) + U(0x51ED))))
    text = owner[place]
    a, b = run[windows] + 1, run[windows + size - 1]  # the first and the last run may go on outside
    for r in range(rounds):
        m = len(name)
        left = (K.mix(name ^ U(0xA5A5 + r)) & U(1)).astype(bool)
        pair = np.append(left[:-1] & ~left[1:] & (text[:-1] == text[1:]), False)
        head = np.append(True, ~pair[:-1])
        index = np.cumsum(head) - 1
        a = a + ((a < b) & ~left[np.minimum(a, m - 1)])  # a right symbol may pair with what stands before
        b = b - ((a < b) & left[np.maximum(b - 1, 0)])  # a left one with what follows
        some = a < b
        a, b = np.where(some, index[np.minimum(a, m - 1)], 0), np.where(some, index[np.maximum(b - 1, 0)] + 1, 0)
        at = np.flatnonzero(head)
        two, after = pair[at], np.minimum(at + 1, m - 1)
        name = np.where(two, K.mix(name[at] * U(PAIR_BASE) + K.mix(name[after] + U(1))), name[at])
        span = np.where(two, span[at] + span[after], span[at])
        place, text = place[at], text[at]
    key = (np.minimum(span, 63).astype(U) << U(58)) | (K.mix(name) >> U(6))
    best = [np.arange(len(key))]
    while 2 << (len(best) - 1) <= size:  # best[k][j]: leftmost largest key of the 2**k symbols from j
        half, last = 1 << (len(best) - 1), best[-1]
        other = np.append(last[half:], last[-half:] if half <= len(last) else last)[: len(last)]
        best.append(np.where(key[other] > key[last], other, last))
    some = a < b
    depth = np.log2(np.maximum(b - a, 1)).astype(np.int64)
    chosen = np.full(len(windows), -1)
    for k in range(len(best)):
        at = np.flatnonzero(some & (depth == k))
        x, y = best[k][a[at]], best[k][b[at] - (1 << k)]
        chosen[at] = np.where(key[y] > key[x], y, x)
    return np.where(some, place[chosen], -1), np.where(some, name[chosen], U(0))


def _read(texts: pa.Array, size: int) -> Iterator[tuple]:
    """For each slice: first row, word counts, window starts, key places, key names, and the digests of ranges of words."""
    for row, _, data, places in K.slices(texts):
        starts, ends, counts = K.words(data, places)
        windows = K.window_starts(counts, size)
        if not len(windows):
            continue
        names = K.word_hashes(data, starts, ends)
        place, name = parse(names, np.repeat(np.arange(len(counts)), counts), windows, size)
        bare = np.flatnonzero(place < 0)
        if len(bare):
            name[bare] = K.Ranges(names).of(windows[bare], windows[bare] + size) ^ U(0x77)
            place[bare] = windows[bare]
        line, first = K.joined(data, starts, ends)
        yield row, counts, windows, place, name, lambda lo, hi, line=line, first=first: K.digests(line, first[lo], first[hi] - 1)


def _occurrences(size: int):
    schema = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("lo", pa.int32()), ("n", pa.int32()), ("name", pa.int64()), ("unit", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch["id"].to_numpy(), batch["th"].to_numpy()
            for row, counts, windows, place, name, digest in _read(batch["text"], size):
                firsts = np.cumsum(counts) - counts
                cut = np.append(True, (place[1:] != place[:-1]) | (windows[1:] != windows[:-1] + 1))
                at = np.flatnonzero(cut)
                n = np.diff(np.append(at, len(windows)))
                start, key = windows[at], name[at]
                unit = K.mix(digest(start, start + n + size - 1) ^ K.mix((place[at] - start).astype(U) * U(64) + n.astype(U)))
                text = np.searchsorted(firsts, start, "right") - 1
                yield pa.record_batch(
                    [pa.array(ids[row + text]), pa.array(hashes[row + text]), pa.array((start - firsts[text]).astype(np.int32)), pa.array(n.astype(np.int32)), K.signed(key), K.signed(unit)],
                    schema=schema,
                )

    return run


def _windows(size: int):
    """The windows of the asked occurrences, keyed by symbol, distance and words."""
    schema = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("at", pa.int32()), ("need", pa.bool_()), ("k1", pa.int64()), ("k2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, asked = batch["id"].to_numpy(), batch["th"].to_numpy(), batch["asked"]
            for row, counts, windows, place, name, digest in _read(batch["text"], size):
                firsts = np.cumsum(counts) - counts
                asks = asked.slice(row, len(counts))
                text = np.repeat(np.arange(len(asks)), asks.value_lengths().to_numpy())
                lo, n, need = (asks.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(3))
                index = np.searchsorted(windows, firsts[text] + lo)
                at = np.repeat(index, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                text, need = np.repeat(text, n), np.repeat(need, n)
                k1 = K.mix(name[at] ^ K.mix((place[at] - windows[at]).astype(U)))
                yield pa.record_batch(
                    [pa.array(ids[row + text]), pa.array(hashes[row + text]), pa.array((windows[at] - firsts[text]).astype(np.int32)), pa.array(need), K.signed(k1), K.signed(digest(windows[at], windows[at] + size))],
                    schema=schema,
                )

    return run


def _keep(with_text: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, rows = batch["spans"], []
            for i, text in enumerate(batch["text"]):
                kept = (text.as_py() or "").encode().split()  # splits at exactly space and \x09-\x0D
                n = len(kept)
                if spans[i].is_valid and len(got := spans[i].values):
                    lo, hi = got.field(0).to_numpy(), got.field(1).to_numpy()
                    steps = np.bincount(lo, minlength=n + 1) - np.bincount(hi, minlength=n + 1)
                    kept = [kept[k] for k in np.flatnonzero(np.cumsum(steps[:-1]) == 0)]
                whole = b" ".join(kept)
                rows.append((n, n - len(kept), hashlib.sha256(whole).hexdigest(), whole.decode() if with_text else None))
            yield pa.record_batch([batch["doc_id"], *(list(zip(*rows)) or [()] * 4)], schema=schema)

    return run


def remove_repeats(docs: DataFrame, size: int = WINDOW, with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) of every row; kept_text is null without ``with_text``."""
    rows = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"id": F.coalesce("doc_id", F.lit(NO_ID)), "th": F.xxhash64("text")})
    found = stage(rows.select("id", "th", "text").mapInArrow(_occurrences(size), "id long, th long, lo int, n int, name long, unit long"))

    # symbols that occur again, counted with map-side sums; a hot symbol is one row a task
    names = found.groupBy("name").agg(F.count("*").alias("_c"), F.min("unit").alias("_u"), F.max("unit").alias("_v"))
    # the few that are left become a table, so that joins with it can split a hot symbol
    names = stage_and_free(names.where("_c > 1").select("name", (F.col("_u") != F.col("_v")).alias("mixed")))
    again = stage_and_free(found.join(names, "name"))
    same = again.where("not mixed").select("id", "th", "lo", (F.col("lo") + F.col("n") + size - 1).alias("hi"))

    # distinct spans of the others: repeated spans are settled, one of each is compared by window
    mixed = again.where("mixed").drop("mixed").withColumn("pick", F.xxhash64("id", "th", "lo"))
    units = stage_and_free(mixed.groupBy("name", "unit").agg(F.count("*").alias("_c"), F.min("pick").alias("_pick")))
    mixed = mixed.join(units, ["name", "unit"])
    settled = mixed.where("_c > 1").select("id", "th", "lo", (F.col("lo") + F.col("n") + size - 1).alias("hi"))
    asked = mixed.where("pick = _pick").groupBy("id", "th").agg(F.collect_set(F.struct("lo", "n", (F.col("_c") == 1).alias("need"))).alias("asked"))
    texts = rows.select("doc_id", "id", "th", "text")
    each = texts.join(asked, ["id", "th"])  # of rows that are equal in id and text, no window is still needed
    shown = stage_and_free(each.select("id", "th", "text", "asked").mapInArrow(_windows(size), "id long, th long, at int, need boolean, k1 long, k2 long"))
    keys = stage_and_free(shown.groupBy("k1", "k2").agg(F.count("*").alias("_c")).where("_c > 1").select("k1", "k2"))
    single = shown.where("need").join(keys, ["k1", "k2"]).select("id", "th", F.col("at").alias("lo"), (F.col("at") + size).alias("hi"))

    spans = same.union(settled).union(single).groupBy("id", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    return texts.join(spans, ["id", "th"], "left").select("doc_id", "text", "spans").mapInArrow(
        _keep(with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    )
