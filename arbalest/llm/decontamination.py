"""Benchmark decontamination by template canonicalisation.

Words become template tokens: numbers, units after a number, and names (capitalised inside a sentence) turn into typed
placeholders, all else into its lower-case core. Words in capitals are no names. A capitalised word that opens a sentence may be a
name or not, so texts are read twice: with all such words plain, and with all of them names. Windows of ``WIDTH`` template tokens of documents and items are joined by
hash within each reading. A choice of the places where an item's windows are found counts if every slot value of the item stands for one value
of the document throughout, and if its windows cover at least ``COVER`` of the item's tokens. Tried are each single
alignment, all alignments near each other together (a session), and, if none of these counts, chains: windows in the order of both texts, with
small changes of the alignment and slots that agree. So an item is caught when its numbers or names were exchanged, as
long as they were exchanged consistently, also where a template is repeated within the item or copies follow each other.

Placeholders alone fit anything: windows with fewer than ``PLAIN`` plain tokens (none, for items shorter than a window) are
joined by template and slot values, that is literally. So every verbatim copy is found, but where such windows make up
more than the rest that ``COVER`` leaves, none with other values.
The items' window hashes are broadcast as a filter while there are at most ``MAX_FILTER``; beyond that all windows of the
documents are joined, with the same result. Words and windows are told apart by 64-bit hashes under a secret key of the job, so that no
text can be made to look like an item.

Contract of ``leaks``:
* one row for each (document, item) with a leak (items of one id and unlike texts are items of their own), of its best choice in the first reading that gives one: most covered tokens, then leftmost;
* whole texts are searched; null texts have no tokens, null items or items without a token are never found; items shorter
  than a window form one window; repeated document rows give one row, and ids may be null; empty tables give an
  empty result; extra columns are ignored by ``leaks`` and kept by ``keep_clean``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbalest.llm import kernels as K
from arbalest.llm.common import in_small_batches, stage
from arbalest.llm.simhash import rows_of

U = np.uint64
WIDTH, PLAIN, COVER = 5, 3, 0.8
#: Alignments this close to the next belong to one session.
DRIFT = 8
MAX_FILTER = 1 << 22
#: Steps of the search for a chain of alignments of one (document, item).
TRIES = 200_000
NO_ID = (1 << 63) - 1

#: Units and number words.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers g kg mg lb lbs oz gram grams kilogram "
    "kilograms pound pounds ounce ounces ton tons l ml liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week "
    "weeks month months year years percent dollar dollars cent cents euro euros mph kph km/h degree degrees"
).split()
NUMBERS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty "
    "sixty seventy eighty ninety hundred thousand million billion"
).split()

NUMBER_TOKEN, UNIT_TOKEN, NAME_TOKEN, LITERAL = (K.mix(np.array([x], U))[0] for x in (101, 102, 103, 104))
READING = U(0xA0761D6478BD642F)

ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
DIGIT = np.zeros(256, bool)
DIGIT[0x30:0x3A] = True
UPPER = np.zeros(256, bool)
UPPER[0x41:0x5B] = True
#: The small letter of each letter of two bytes in UTF-8 (Latin, Greek, Cyrillic, Armenian), as such pairs of bytes.
SMALL = np.arange(1 << 16)
for _code in range(0x80, 0x800):
    if len(_low := chr(_code).lower().encode()) == 2:
        SMALL[int.from_bytes(chr(_code).encode())] = int.from_bytes(_low)
STOP = np.zeros(256, bool)
STOP[[ord(c) for c in ".!?:;"]] = True


def _hashes(words: list[str], key: int) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = K.words(data, np.array([0, len(data)]))
    return np.unique(K.word_hashes(data, starts, ends, key))


def templates(data: np.ndarray, places: np.ndarray, openers: bool = False, key: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template tokens of some texts: (tokens, slot values, is a slot, tokens of each text). A run of names is one token.
    With ``openers``, capitalised words that open a sentence are names too."""
    none = np.zeros(0, U)
    starts, ends, counts = K.words(data, places)
    if not len(starts):
        return none, none, np.zeros(0, bool), counts
    low = K.LOWER[data]
    wide = np.zeros(len(data), bool)  # the first bytes of capitals beyond ASCII
    lead = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] < 0xE0))
    pair = data[lead].astype(np.int64) << 8 | data[lead + 1]
    small = SMALL[pair]
    wide[lead] = small != pair
    low[lead], low[lead + 1] = small >> 8, small & 0xFF
    upper = UPPER[data] | wide
    n, alnum = len(data), ALNUM[data]
    place = np.arange(n)
    after = np.minimum.accumulate(np.where(alnum, place, n)[::-1])[::-1]
    before = np.maximum.accumulate(np.where(alnum, place, -1))
    first, last = after[starts], before[ends - 1] + 1
    owner = np.repeat(np.arange(len(counts)), counts)
    breaks = np.append(0, np.cumsum(data == 0x0A))
    opens = np.ones(len(starts), bool)  # of a sentence
    opens[1:] = (owner[1:] != owner[:-1]) | STOP[data[ends[:-1] - 1]] | (breaks[starts[1:]] > breaks[ends[:-1]])
    some = first < last  # punctuation alone is no token
    first, last, owner, opens = first[some], last[some], owner[some], opens[some]
    value = K.word_hashes(low, first, last, key)
    second = first + 1 + wide[first]
    shouted = (second < last) & upper[np.minimum(second, n - 1)]
    number = DIGIT[data[first]] | np.isin(value, _hashes(NUMBERS, key))
    same = np.append(False, owner[1:] == owner[:-1])
    unit = np.isin(value, _hashes(UNITS, key)) & np.append(False, number[:-1]) & same & ~number
    name = upper[first] & (~opens | openers) & (last - first > 1) & ~shouted & ~number & ~unit
    head = ~(name & np.append(False, name[:-1]) & same)
    at = np.flatnonzero(head)
    ranges = K.Ranges(value)
    token = np.where(number, NUMBER_TOKEN, np.where(unit, UNIT_TOKEN, np.where(name, NAME_TOKEN, value)))[at]
    ends_at = np.append(at[1:], len(value))
    return token, ranges.of(at, ends_at), (number | unit | name)[at], np.bincount(owner[at], minlength=len(counts))


def _windows(width: int, plain: int, known: np.ndarray | None, items: bool, sizes: list[int], secret: int):
    """Windows of ``sizes`` as (id, th, pos, size, reading, total, hash, slot values); of items the widest that fit."""
    schema = pa.schema(
        [("id", pa.int64()), ("th", pa.int64()), ("pos", pa.int32()), ("size", pa.int32()), ("reading", pa.int32()), ("total", pa.int32()), ("key", pa.int64()), ("slots", pa.list_(pa.int64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch["id"].to_numpy(), batch["th"].to_numpy()
            for row, end, data, places in K.slices(batch["text"]):
                for reading in (0, 1):
                    token, value, slot, counts = templates(data, places, bool(reading), secret)
                    firsts = np.cumsum(counts) - counts
                    ranges, literal, slots = K.Ranges(token), K.Ranges(value), np.append(0, np.cumsum(slot))
                    values = value[slot]
                    if items:
                        whole = ranges.of(firsts, firsts + counts)
                        changed, before = (whole != before) if reading else None, whole
                    for size in sizes:
                        at = K.window_starts(counts, size)
                        text = np.searchsorted(firsts, at, "right") - 1
                        if items:
                            asked = (counts[text] == size) | (size == width)
                            if reading:
                                asked &= changed[text]
                            at, text = at[asked], text[asked]
                        n_plain = size - (slots[at + size] - slots[at])
                        poor = n_plain < (min(plain, size) if size == width else 1)
                        key = ranges.of(at, at + size) + U(size) + U(reading) * READING
                        key = K.mix(np.where(poor, K.mix(key + LITERAL) + literal.of(at, at + size), key)).view(np.int64)
                        if known is not None:
                            ok = np.isin(key, known)
                            at, text, key = at[ok], text[ok], key[ok]
                        if not len(at):
                            continue
                        lo, n = slots[at], slots[at + size] - slots[at]
                        take = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), K.signed(values[take]))
                        yield pa.record_batch(
                            [pa.array(ids[row + text]), pa.array(hashes[row + text]), pa.array((at - firsts[text]).astype(np.int32)), pa.array(np.full(len(at), size, np.int32)), pa.array(np.full(len(at), reading, np.int32)),
                             pa.array(counts[text].astype(np.int32)), pa.array(key), lists], schema=schema
                        )

    return run


SHAPE = "id long, th long, pos int, size int, reading int, total int, key long, slots array<long>"


def keyed(rows: DataFrame, id_col: str) -> DataFrame:
    return in_small_batches(rows).select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.coalesce("text", F.lit("")).alias("text"))


HIT = ["n_tokens", "pos", "item_pos", "size", "item_slots", "slots"]


def _agreed(hits: list[tuple], least: float) -> tuple | None:
    """(covered tokens, -first token, exact) of the hits together, if they cover enough and every slot stands for one value."""
    values: dict[int, int] = {}
    for *_, item_slots, slots in hits:
        for a, b in zip(item_slots, slots):
            if values.setdefault(a, b) != b:
                return None
    n = len({t for _, at, size, *_ in hits for t in range(at, at + size)})
    return (n, -min(h[0] for h in hits), all(a == b for a, b in values.items())) if n >= least else None


def _chain(hits: list[tuple], total: int, least: float) -> list[tuple] | None:
    """Whole runs of hits, in the order of both texts, whose shifts change by ``DRIFT`` at most from one run to the next
    and whose slots agree, covering ``least`` tokens. No hit of a run is left out, and a run that disagrees is passed over only by
    a change of the shift. Found by depth-first search that enters no state twice, of ``TRIES`` steps at most for a pair."""
    at = {(h[0], h[1]): h for h in hits}
    reach, spare = WIDTH + DRIFT, None
    drifts = sorted(((a, b) for a in range(1, reach + DRIFT + 1) for b in range(1, reach + 1) if 0 < abs(a - b) <= DRIFT), key=lambda s: (s[1], abs(s[0] - s[1])))
    heads = [h for h in hits if total - h[1] >= least and not any((h[0] - k, h[1] - k) in at for k in range(1, reach + 1))]
    stack = [((h,), h[2], {}) for h in sorted(heads, key=lambda h: (-h[1], -h[0]))]
    seen: dict[tuple, int] = {}  # tokens covered on the way to a hit with these slots: what followed was tried then
    for _ in range(TRIES):
        if not stack:
            break
        chain, n, values = stack.pop()
        pos, item_pos, size, item_slots, slots = chain[-1]
        values = dict(values)
        if any(values.setdefault(a, b) != b for a, b in zip(item_slots, slots)) or n + total - item_pos - size < least:
            continue
        state = (pos, item_pos, frozenset(values.items()))
        if seen.get(state, -1) >= n:
            continue
        seen[state] = n
        ahead = next((k for k in range(1, reach + 1) if (pos + k, item_pos + k) in at), None)
        following = [at[pos + ahead, item_pos + ahead]] if ahead else []
        if ahead != 1:
            following += [at[pos + a, item_pos + b] for a, b in drifts if (pos + a, item_pos + b) in at and (pos + a - 1, item_pos + b - 1) not in at]
        if ahead is None and n >= least:
            if not following:
                return list(chain)
            spare = spare or list(chain)
        stack += [((*chain, h), n + min(h[2], h[1] + h[2] - item_pos - size), values) for h in reversed(following)]
    return spare


def _by_shift(hits: list[tuple], drift: int) -> list[list[tuple]]:
    """Hits whose shifts are at most ``drift`` from the next."""
    out, last = [], None
    for h in sorted(hits, key=lambda h: h[0] - h[1]):
        if last is None or h[0] - h[1] - last > drift:
            out.append([])
        out[-1].append(h)
        last = h[0] - h[1]
    return out


def _best(found: list[tuple], plain: int, cover: float) -> tuple | None:
    """(n_tokens, n_covered, first_token, exact) of a pair's best leak, ``found`` being its rows of ``HIT``."""
    total, least = found[0][0], cover * found[0][0]
    hits = list({h[1:4]: h[1:] for h in found}.values())
    rich = [h for h in hits if len(h[3]) < h[2] and (h[2] < WIDTH or len(h[3]) <= WIDTH - plain)]  # a literal hit must not break a session
    tries = [*_by_shift(hits, 0), *_by_shift(hits, DRIFT), *(_by_shift(rich, DRIFT) if len(rich) < len(hits) else ())]
    good = [x for x in (_agreed(t, least) for t in tries) if x]
    if not good and (chain := _chain(hits, total, least)):
        good = [_agreed(chain, least)]
    if not good:
        return None
    n, first, exact = max(good)
    return total, n, -first, exact


def _judged(plain: int, cover: float):
    """Rows of (pair, reading, ``HIT``) sorted by pair and reading; a pair may go on in the next batch, so its rows are carried
    over. The first reading that has a leak counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, done, out = None, [], None, []

        def judge() -> None:
            nonlocal done
            if held and group[:4] != done and (b := _best(held, plain, cover)):
                out.append((*group[:4], *b))
                done = group[:4]

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:5] != group:
                    judge()
                    group, held = row[:5], []
                held.append(row[5:])
            yield _leaks(out)
            out.clear()
        judge()
        yield _leaks(out)

    return run


def _leaks(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.int32()] * 3 + [pa.bool_()]
    names = ["id", "th", "item_id", "item_th", "n_tokens", "n_covered", "first_token", "exact"]
    return pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)


def leaks(docs: DataFrame, items: DataFrame, width: int = WIDTH, plain: int = PLAIN, cover: float = COVER, max_filter: int = MAX_FILTER) -> DataFrame:
    """(doc_id, item_id, n_tokens, n_covered, coverage, exact, first_token, th) of every leak."""
    secret = K.fresh_key()
    wanted = keyed(items, "item_id").dropDuplicates(["id", "th"]).mapInArrow(_windows(width, plain, None, True, list(range(1, width + 1)), secret), SHAPE)
    wanted = wanted.select(F.col("id").alias("item_id"), F.col("th").alias("item_th"), F.col("pos").alias("item_pos"), "size", "reading", F.col("total").alias("n_tokens"), "key", F.col("slots").alias("item_slots"))
    wanted = stage(wanted)
    sizes = sorted(r.size for r in wanted.select("size").distinct().collect())
    keys = wanted.select("key").distinct()
    known = keys.toArrow()["key"].to_numpy() if keys.count() <= max_filter else None
    known = np.sort(known) if known is not None else None
    found = keyed(docs, "doc_id").mapInArrow(_windows(width, plain, known, False, sizes, secret), SHAPE).drop("total", "reading")
    hits = stage(found.join(wanted, ["key", "size"]))
    pair = ["id", "th", "item_id", "item_th"]
    # no choice of a pair's hits covers more than all of them
    covered = hits.select(*pair, "reading", "n_tokens", "item_pos", "size").distinct().withColumn("token", F.explode(F.sequence("item_pos", F.col("item_pos") + F.col("size") - 1)))
    covered = covered.groupBy(*pair, "reading", "n_tokens").agg(F.count_distinct("token").alias("n")).where(F.col("n") >= F.lit(cover) * F.col("n_tokens"))
    hits = hits.join(covered.select(*pair, "reading"), [*pair, "reading"], "left_semi").select(*pair, "reading", *HIT)
    best = hits.repartition(*pair).sortWithinPartitions(*pair, "reading").mapInArrow(_judged(plain, cover), f"{', '.join(f'{c} long' for c in pair)}, n_tokens int, n_covered int, first_token int, exact boolean")
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return best.select(
        real("id").alias("doc_id"), real("item_id").alias("item_id"), "n_tokens", "n_covered", (F.col("n_covered") / F.col("n_tokens")).alias("coverage"), "exact", "first_token", "th",
    )


def keep_clean(docs: DataFrame, items: DataFrame, **options: float) -> DataFrame:
    """The rows of ``docs`` without a leak."""
    bad = leaks(docs, items, **options).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "th")
    return rows_of(docs, bad, "left_anti").select("row.*")
