"""Language-model scoring: a smoothed unigram base, and prediction by partial matching (PPM) over bytes.

The PPM model is pretrained: contexts of up to three bytes, counted over all training texts. A symbol is coded in its
longest seen context; what that context has not seen costs an escape (method C: distinct / (total + distinct)), after
which the next shorter context is used without the symbols already ruled out (exclusion), down to the uniform order -1.
Every text ends in a symbol of its own.

Contexts of up to two bytes have at most 2**16 * 257 cells, whatever the corpus; they become one broadcast table of
log probabilities. As a context's symbols were all seen in its shorter contexts too, a three-byte context needs only its own
seen symbols and two corrections to that table, for symbols that its two-byte context has seen and for others. These are a
distributed table with a row for each context. The most frequent contexts, ``MAX_CELLS`` cells at most, are broadcast; positions in
other contexts are joined with the table. So the texts are read once for counting and once for scoring, whatever the corpus.

Words are treated alike: their counts are a distributed table keyed by the word itself; the ``HEAD`` most frequent ones are
broadcast and found by hash, each find being verified on the word; the tokens beyond them are joined with the table. Results do
not depend on ``HEAD`` or ``MAX_CELLS``.

Contract of ``score``:
* A-Z are lower-cased; tokens are runs of anything but space and \\x09-\\x0D, then one end token; null texts are empty;
* a document is held out if crc32(id as text; null: empty) mod ``folds`` is 0; counts come from all others;
* base_score: sum over tokens of log10((c + 0.1) / (N + 0.1 * (V + 1))); score: log10 probability of the lower-cased bytes and
  the end under the PPM model; with no training text it is the uniform one;
* one result row for each input row, repeated rows and null ids included; an empty table gives an empty result; extra
  columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbalest.llm import kernels as K
from arbalest.llm.common import id_remainder, in_small_batches, stage

U = np.uint64
FOLDS = 10
END = 256
SYMBOLS = 257
HEAD = 1 << 18
#: Longer words are not broadcast, so that the head has at most HEAD times as many bytes.
HEAD_WORD = 64
#: Kinds of counts: words, and grams at the fourth and later, third, second, and first symbol of a text.
WORD, LATER, THIRD, SECOND, FIRST = 0, 1, 2, 3, 4
#: Codes: contexts of n bytes are numbers in base 256; a gram is its context * SYMBOLS + symbol.
PAIRS = (1 << 16) * SYMBOLS
MAX_CELLS = 1 << 21
FLUSH, FLUSH_BYTES = 1 << 20, 1 << 25
#: Slices for counting; longer ones share one array of gram counts among more bytes.
COUNT_BYTES = 1 << 21


def _symbols(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts as symbols, each followed by END; and each text's first place."""
    n = len(places) - 1
    out = np.full(len(data) + n, END, np.int64)
    out[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(places))] = data
    return out, places[:-1] + np.arange(n)


def _dense(values: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, index of each value)."""
    if limit > max(1 << 23, 8 * len(values)):
        return np.unique(values, return_inverse=True)
    seen = np.bincount(values, minlength=1) > 0
    return np.flatnonzero(seen), (np.cumsum(seen) - 1)[values]


def _edges(symbols: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Kind of each place: FIRST, SECOND, THIRD or LATER symbol of its text."""
    kind = np.full(len(symbols), LATER, np.int8)
    for k, name in ((2, THIRD), (1, SECOND), (0, FIRST)):
        at = firsts + k
        kind[at[at < np.append(firsts[1:], len(symbols))]] = name
    return kind


def _grams(symbols: np.ndarray, firsts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, codes, counts) of the grams of some texts."""
    kind = _edges(symbols, firsts)
    used, s = _dense(symbols, SYMBOLS)
    a = len(used)
    at = np.flatnonzero(kind == LATER)
    if len(at):
        contexts, c = _dense((s[at - 3] * a + s[at - 2]) * a + s[at - 1], a**3)
        codes, index = _dense(c * a + s[at], len(contexts) * a)
        x, y = contexts[codes // a], codes % a
        context = (used[x // (a * a)] * 256 + used[x // a % a]) * 256 + used[x % a]
        yield LATER, context * SYMBOLS + used[y], np.bincount(index)
    at = np.flatnonzero(kind == THIRD)
    yield (THIRD, *np.unique((symbols[at - 2] * 256 + symbols[at - 1]) * SYMBOLS + symbols[at], return_counts=True))
    at = np.flatnonzero(kind == SECOND)
    yield (SECOND, *np.unique(symbols[at - 1] * SYMBOLS + symbols[at], return_counts=True))
    yield (FIRST, *np.unique(symbols[firsts], return_counts=True))


class _Sums:
    """Counts by key, merged now and then, so that memory follows the distinct keys of a task up to ``FLUSH``."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, back = np.unique(np.concatenate(self.keys), return_inverse=True)
        counts = np.bincount(back, np.concatenate(self.counts), len(keys)).astype(np.int64)
        self.keys, self.counts, self.held = [], [], 0
        return keys, counts


class _Words:
    """Counts by word, merged like ``_Sums``."""

    def __init__(self) -> None:
        self.parts: list[pa.Table] = []
        self.held = self.size = 0

    def add(self, words: pa.Array, counts: pa.Array) -> None:
        self.parts.append(pa.table({"word": words.cast(pa.large_binary()), "n": counts}))
        self.held += len(words)
        self.size += words.nbytes

    def merged(self) -> tuple[pa.Array, pa.Array]:
        if not self.parts:
            return pa.array([], pa.large_binary()), pa.array([], pa.int64())
        sums = pa.concat_tables(self.parts).group_by("word", use_threads=False).aggregate([("n", "sum")])
        self.parts, self.held, self.size = [], 0, 0
        return sums["word"].combine_chunks(), sums["n_sum"].combine_chunks()


COUNTS = pa.schema([("kind", pa.int8()), ("key", pa.int64()), ("word", pa.large_binary()), ("n", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums, words = {kind: _Sums() for kind in (LATER, THIRD, SECOND, FIRST)}, _Words()

    def grams(kind: int) -> pa.RecordBatch:
        keys, counts = sums[kind].merged()
        return pa.record_batch([pa.array(np.full(len(keys), kind, np.int8)), pa.array(keys), pa.nulls(len(keys), pa.large_binary()), pa.array(counts)], schema=COUNTS)

    def tokens() -> pa.RecordBatch:
        found, counts = words.merged()
        return pa.record_batch([pa.array(np.full(len(found), WORD, np.int8)), pa.nulls(len(found), pa.int64()), found, counts], schema=COUNTS)

    for batch in batches:
        for _, _, data, places in K.slices(batch["text"], COUNT_BYTES):
            data = K.LOWER[data]
            starts, ends, _ = K.words(data, places)
            if len(starts):
                seen = K.word_array(data, starts, ends).value_counts()
                words.add(seen.field("values"), seen.field("counts"))
            for kind, keys, counts in _grams(*_symbols(data, places)):
                sums[kind].add(keys, counts)
            for kind, s in sums.items():
                if s.held > 4 * FLUSH:
                    s.add(*s.merged())
                    if s.held > FLUSH:
                        yield grams(kind)
            if words.held > 4 * FLUSH or words.size > FLUSH_BYTES:
                words.add(*words.merged())
                if words.held > FLUSH or words.size > FLUSH_BYTES // 2:
                    yield tokens()
    for kind in sums:
        yield grams(kind)
    yield tokens()


class Lookup:
    """Places of 64-bit keys: an open-addressing table of distinct non-negative keys, probed for many keys at once."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.mask, self.shift = (1 << bits) - 1, U(64 - bits)
        self.slots, self.index = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = keys[left[free]]  # of keys that meet, the last stays
            self.index[slot[free]] = left[free]
            lost = self.slots[slot] != keys[left]
            left, slot = left[lost], (slot[lost] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(U) * U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key among the given ones, or -1."""
        slot = self._slot(keys)
        held = self.slots[slot]
        out = np.where(held == keys, self.index[slot], -1)
        left = np.flatnonzero((held != keys) & (held >= 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & self.mask
            held = self.slots[slot]
            hit = held == keys[left]
            out[left[hit]] = self.index[slot[hit]]
            on = ~hit & (held >= 0)
            left, slot = left[on], slot[on]
        return out


class Short:
    """The orders -1 to 2 as a table: log10 probabilities by context row and symbol; row 0 is the empty context."""

    def __init__(self, pairs: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray], first: tuple[np.ndarray, np.ndarray]):
        n1, n0 = np.zeros((256, SYMBOLS)), np.zeros(SYMBOLS)
        np.add.at(n1, (pairs[0] // SYMBOLS % 256, pairs[0] % SYMBOLS), pairs[1])
        np.add.at(n1, (second[0] // SYMBOLS, second[0] % SYMBOLS), second[1])
        np.add.at(n0, first[0], first[1])
        n0 += n1.sum(axis=0)
        rows = [self._through(n0[None, :])]
        one = np.flatnonzero(n1.any(axis=1))
        self.row1 = np.zeros(256, np.int32)
        self.row1[one] = 1 + np.arange(len(one))
        if len(one):
            rows.append(self._through(n1[one], np.broadcast_to(n0, (len(one), SYMBOLS))))
        order = np.argsort(pairs[0], kind="stable")
        self.codes, self.counts = pairs[0][order], pairs[1][order].astype(np.float64)
        self.contexts, starts = np.unique(self.codes // SYMBOLS, return_index=True)
        self.total = np.add.reduceat(self.counts, starts) if len(starts) else np.zeros(0)
        self.kinds = np.diff(np.append(starts, len(self.codes)))
        self.row2 = np.tile(self.row1, 256)  # an unseen context has no cost: its last byte decides
        self.base = 1 + len(one)
        self.row2[self.contexts] = self.base + np.arange(len(self.contexts))
        for at in range(0, len(self.contexts), 4096):
            part = self.contexts[at : at + 4096]
            lo, hi = np.searchsorted(self.codes, [part[0] * SYMBOLS, (part[-1] + 1) * SYMBOLS])
            n2 = np.zeros((len(part), SYMBOLS))
            n2[np.searchsorted(part, self.codes[lo:hi] // SYMBOLS), self.codes[lo:hi] % SYMBOLS] = self.counts[lo:hi]
            rows.append(self._through(n2, n1[part % 256], np.broadcast_to(n0, (len(part), SYMBOLS))))
        self.table = np.concatenate(rows)
        self.seen2 = np.zeros(self.table.shape, bool)
        self.seen2[self.row2[self.codes // SYMBOLS], self.codes % SYMBOLS] = True

    @staticmethod
    def _through(*orders: np.ndarray) -> np.ndarray:
        """From the counts of each order, longest first, each (contexts, symbols)."""
        ruled = np.zeros(orders[0].shape, bool)
        p, left = np.zeros(orders[0].shape), np.ones((len(orders[0]), 1))
        for n in orders:
            n = np.where(ruled, 0, n)
            total, kinds = n.sum(axis=1, keepdims=True), (n > 0).sum(axis=1, keepdims=True)
            base = np.maximum(total + kinds, 1)
            p += left * n / base
            left = left * np.where(total > 0, kinds / base, 1)
            ruled |= n > 0
        p += np.where(ruled, 0, left / np.maximum((~ruled).sum(axis=1, keepdims=True), 1))
        return np.log10(np.maximum(p, 1e-300)).astype(np.float32)


def _corrections(short: Short, codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of whole contexts' cells, sorted by code: (contexts, cells of each, count of each, log10 corrections for symbols that the
    shorter context has seen and for others, log10 probability of each cell)."""
    counts = counts.astype(np.float64)
    contexts, starts = np.unique(codes // SYMBOLS, return_index=True)
    kinds = np.diff(np.append(starts, len(codes)))
    add = lambda v: np.add.reduceat(v, starts) if len(starts) else np.zeros(0)
    total = add(counts)
    below = short.counts[np.searchsorted(short.codes, codes % PAIRS)]  # each cell's symbol in the shorter context
    at = np.searchsorted(short.contexts, contexts % (1 << 16))
    total2, kinds2 = short.total[at], short.kinds[at]
    left, fresh = total2 - add(below), kinds2 - kinds  # what the shorter context has beyond this one
    escape, escape2 = np.log10(kinds / (total + kinds)), np.log10(kinds2 / (total2 + kinds2))
    rest = np.maximum(left + fresh, 1)
    seen = escape + np.log10(total2 + kinds2) - np.log10(rest)
    unseen = escape + np.where(fresh > 0, np.log10(np.maximum(fresh, 1) / rest), 0) - escape2
    return contexts, kinds, total, seen.astype(np.float32), unseen.astype(np.float32), np.log10(counts / np.repeat(total + kinds, kinds)).astype(np.float32)


CONTEXTS = "context long, n double, size int, seen float, unseen float, symbols array<int>, logs array<float>"


def _contexts(shared):
    """Rows (context, its cells) as ``CONTEXTS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = batch["cells"].flatten()
            codes, counts = cells.field("key").to_numpy(), cells.field("n").to_numpy()
            order = np.argsort(codes, kind="stable")
            contexts, kinds, total, seen, unseen, logs = _corrections(shared.value, codes[order], counts[order])
            ends = pa.array(np.append(0, np.cumsum(kinds)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array((codes[order] % SYMBOLS).astype(np.int32)), pa.array(logs))]
            yield pa.record_batch([pa.array(contexts), pa.array(total), pa.array(kinds.astype(np.int32)), pa.array(seen), pa.array(unseen), *lists], ["context", "n", "size", "seen", "unseen", "symbols", "logs"])

    return run


class Long:
    """The broadcast contexts of order 3: log10 probabilities of their seen cells, and the corrections of the others."""

    def __init__(self, rows: pa.Table, whole: bool):
        arrays = [rows[c].combine_chunks() for c in ("context", "seen", "unseen", "symbols", "logs")]
        contexts, self.seen, self.unseen = (c.to_numpy() for c in arrays[:3])
        sizes = arrays[3].value_lengths().to_numpy() if len(contexts) else np.zeros(0, np.int64)
        self.cell = arrays[4].flatten().to_numpy()
        self.contexts, self.cells = Lookup(contexts), Lookup(np.repeat(contexts, sizes) * SYMBOLS + arrays[3].flatten().to_numpy())
        self.whole = whole  # there are no other contexts


def ppm_scores(data: np.ndarray, places: np.ndarray, short: Short, long: Long) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(log10 probability of each text and its end, without the open positions; number of open positions of each text; and of
    these the cell's code * 2 + whether its shorter context has seen the symbol, and the log10 probability there). Open
    positions have a context of order 3 that is not broadcast."""
    symbols, firsts = _symbols(data, places)
    kind, low = _edges(symbols, firsts), symbols & 255
    row = np.zeros(len(symbols), np.int64)
    row[2:] = short.row2[low[:-2] * 256 + low[1:-1]]
    row[kind == FIRST] = 0
    second = np.flatnonzero(kind == SECOND)
    row[second] = short.row1[symbols[second - 1]]
    cell = row * SYMBOLS + symbols
    logs = short.table.ravel()[cell].astype(np.float64)
    at = np.flatnonzero(kind == LATER)
    context = (low[at - 3] * 256 + low[at - 2]) * 256 + low[at - 1]
    place = long.contexts.find(context)
    open_at = np.zeros(0, np.int64) if long.whole else at[place < 0]
    keys, lows = (context[place < 0] * SYMBOLS + symbols[open_at]) * 2 + short.seen2.ravel()[cell[open_at]] if len(open_at) else np.zeros(0, np.int64), logs[open_at]
    logs[open_at] = 0
    at, context, place = at[place >= 0], context[place >= 0], place[place >= 0]
    hit = long.cells.find(context * SYMBOLS + symbols[at])
    shift = np.where(short.seen2.ravel()[cell[at]], long.seen[place], long.unseen[place])
    logs[at] = np.where(hit >= 0, long.cell[hit] if len(long.cell) else 0, logs[at] + shift)
    n_open = np.bincount(np.searchsorted(firsts, open_at, "right") - 1, minlength=len(firsts))
    return np.add.reduceat(logs, firsts), n_open, keys, lows


def _lists(counts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), values)


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, tail array<binary>, open array<long>, lows array<double>"


def _score(shared_short, shared):
    names = [c.split()[0] for c in SCORED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, hashes, logs, end_known, end_log, long = shared.value
        short, row = shared_short.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo, hi, data, places in K.slices(batch["text"]):
                data = K.LOWER[data]
                starts, ends, counts = K.words(data, places)
                found = K.word_hashes(data, starts, ends)
                words = K.word_array(data, starts, ends)
                at = np.minimum(np.searchsorted(hashes, found), max(len(hashes) - 1, 0))
                known = hashes[at] == found if len(hashes) else np.zeros(len(found), bool)
                hit = np.flatnonzero(known)
                known[hit] = pc.equal(words.take(pa.array(hit)), head.take(pa.array(at[hit]))).to_numpy(zero_copy_only=False)  # the words themselves
                owner = np.repeat(np.arange(hi - lo), counts)
                n_head = np.bincount(owner[known], minlength=hi - lo)
                base = np.bincount(owner[known], logs[at[known]] if len(hashes) else None, minlength=hi - lo) + end_log
                score, n_open, keys, lows = ppm_scores(data, places, short, long)
                yield pa.record_batch(
                    [pa.array(np.arange(row, row + hi - lo)), batch["doc_id"].slice(lo, hi - lo), batch["held_out"].slice(lo, hi - lo), pa.array(counts + 1), pa.array(n_head + end_known),
                     pa.array(base), pa.array(score), _lists(counts - n_head, words.filter(pa.array(~known))), _lists(n_open, pa.array(keys)), _lists(n_open, pa.array(lows))], names
                )
                row += hi - lo

    return run


def most_frequent(rows: DataFrame, limit: int, size: Column) -> DataFrame:
    """The rows of largest ``n``, of total ``size`` at most ``limit``: all whose n reaches a power of 2**(1/8) beyond which the rows
    are no larger together. No task sees all rows."""
    step = F.floor(F.log2("n") * 8)
    steps = rows.groupBy(step.alias("step")).agg(F.sum(size).alias("size")).collect()  # a few hundred rows
    least, held = None, 0
    for r in sorted(steps, key=lambda r: -r.step):
        held += r.size
        if held > limit:
            break
        least = r.step
    return rows.where(step >= least) if least is not None else rows.limit(0)


def score(docs: DataFrame, folds: int = FOLDS, head: int = HEAD, max_cells: int = MAX_CELLS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    rows = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), (id_remainder(folds) == 0).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    counts = rows.where("not held_out").select("text").mapInArrow(_count, "kind byte, key long, word binary, n long")
    counts = stage(counts.groupBy("kind", "key", "word").agg(F.sum("n").alias("n")))
    totals = {r.kind: r for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}  # five rows
    texts = totals[FIRST].n if FIRST in totals else 0
    tokens, kinds = (totals[WORD].n, totals[WORD].v) if WORD in totals else (0, 0)
    train, vocabulary = tokens + texts, kinds + (texts > 0)
    below = float(train + 0.1 * (vocabulary + 1))

    words = counts.where(F.col("kind") == WORD).select("word", "n")
    frequent = most_frequent(words.where(F.octet_length("word") <= HEAD_WORD), head, F.lit(1)).toArrow().combine_chunks()
    known = frequent["word"].combine_chunks().cast(pa.binary())
    line = b" ".join(known.to_pylist())
    hashes = K.word_hashes(*(lambda d: (d, *K.words(d, np.array([0, len(d)]))[:2]))(np.frombuffer(line, np.uint8)))
    order = np.argsort(hashes)
    logs = np.log10((frequent["n"].to_numpy() + 0.1) / below)

    pairs = counts.where(F.col("kind").isin(LATER, THIRD)).groupBy((F.col("key") % PAIRS).alias("key")).agg(F.sum("n").alias("n"))
    arrays = lambda df: (lambda t: (t["key"].to_numpy(), t["n"].to_numpy()))(df.select("key", "n").toArrow())
    short = spark.sparkContext.broadcast(Short(arrays(pairs), *(arrays(counts.where(F.col("kind") == k)) for k in (SECOND, FIRST))))  # 2**16 * 257 cells at most
    cells = counts.where(F.col("kind") == LATER).groupBy(F.floor(F.col("key") / SYMBOLS)).agg(F.collect_list(F.struct("key", "n")).alias("cells"))  # 257 a context at most
    contexts = stage(cells.select("cells").mapInArrow(_contexts(short), CONTEXTS))
    best = most_frequent(contexts, max_cells, F.col("size")).toArrow()
    long = Long(best, contexts.count() == best.num_rows)
    shared = spark.sparkContext.broadcast((known.take(pa.array(order)), hashes[order], logs[order], int(texts > 0), float(np.log10((texts + 0.1) / below)), long))

    found = stage(rows.mapInArrow(_score(short, shared), SCORED))
    tail = found.select("row", F.explode("tail").alias("word")).join(words, "word", "left")
    tail = tail.groupBy("row").agg(
        F.sum(F.log10((F.coalesce("n", F.lit(0)) + F.lit(0.1).cast("double")) / F.lit(below))).alias("rest"), F.count("n").alias("more")
    )
    out = found.drop("tail", "open", "lows").join(tail, "row", "left")
    if not long.whole:
        out = out.join(_opened(found, contexts), "row", "left").withColumn("score", F.col("score") + F.coalesce("_more", F.lit(0.0)))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), "score",
    )


def _opened(found: DataFrame, contexts: DataFrame) -> DataFrame:
    """(row, _more): log10 probability of each row's open positions, by a join with their contexts."""
    at = found.select("row", F.explode(F.arrays_zip("open", "lows")).alias("x")).select("row", "x.open", F.col("x.lows").alias("low"))
    code = F.shiftright("open", 1)
    at = at.select("row", "low", (F.col("open") % 2 == 1).alias("seen2"), (code % SYMBOLS).cast("int").alias("symbol"), F.floor(code / SYMBOLS).alias("context"))
    both = at.join(contexts.drop("n", "size"), "context", "left")
    place = F.array_position("symbols", F.col("symbol"))
    other = F.col("low") + F.when(F.col("seen2"), F.col("seen")).otherwise(F.col("unseen"))
    value = F.when(F.col("symbols").isNull(), F.col("low")).when(place > 0, F.element_at("logs", F.nullif(place, F.lit(0)).cast("int")).cast("double")).otherwise(other)
    return both.groupBy("row").agg(F.sum(value).alias("_more"))
