"""Byte-level BPE by prefix dynamic programming.

A text is split by a pattern into pieces; a piece's encoding merges, again and again, the leftmost adjacent pair of parts whose joined
bytes have the lowest rank. Two facts turn this into a recurrence: a sequence of tokens is an encoding when each adjacent pair of it is one,
and so every byte prefix of a piece has exactly one valid last token: the token t that ends there and whose pair with the
last token of the prefix before t is an encoding. That token is all that is stored for a prefix; the encoding is read by walking back.

Hence the state of a text is one token for each byte, ``last``, and it can be carried on exactly:
* ``append`` goes on from the stored prefixes; of the old text only the pieces that could see its end are split again, and
  prefixes of a piece that goes on are kept;
* ``edit`` starts at the first piece that could see the edit and ends where a new piece starts at an old piece's place, from where
  on all is as before.

Spark side: ``encode`` and ``decode`` are maps over rows (no shuffle, whole texts, one text at a time in a task); ``append_texts`` carries
stored states on by appended texts. A rank file is read by the driver (about 50,000 tokens, ``MAX_VOCABULARY`` at most, an error beyond)
and sent to the tasks. Null texts count as empty; repeated rows give equal rows; other columns are kept, those that clash with
a result get underscores in front; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbalest.llm.common import free_name, in_small_batches

MAX_VOCABULARY = 1 << 20
#: Entries that a task keeps of pieces (of so many bytes at most), in each of two generations, and of token pairs; none are needed.
KEPT_PIECES, KEPT_PAIRS, KEPT_BYTES = 1 << 18, 1 << 19, 64
#: Characters of a text whose pieces are held at once.
KEPT_TEXT = 1 << 20
#: Characters after its end that a match of the pattern may look at: white space before a word sees the space and the word.
SEEN = 2


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes with their ranks, from lines of base64 and number."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    if len(ranks) > MAX_VOCABULARY or max(ranks.values(), default=0) >= MAX_VOCABULARY:
        raise ValueError(f"{len(ranks)} tokens; at most {MAX_VOCABULARY} are sent to tasks")
    return ranks


class Tokens:
    """A vocabulary by ranks, with its split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes = {rank: token for token, rank in ranks.items()}
        self.ends: dict = {None: None}  # tokens as a trie from their last byte on; the rank is under None
        #: A token's first and last parts, from its byte on to itself, each with the rank of the next (the last with none).
        self.heads: dict[int, list[tuple[bytes, float]]] = {}
        self.tails: dict[int, list[tuple[bytes, float]]] = {}
        self.rising = True  # whether every token ranks after its parts, as training makes them
        for token, rank in sorted(ranks.items(), key=lambda r: len(r[0])):
            parts = self._merge(token)
            if len(token) > 1 and (len(parts) != 2 or parts[0] + parts[1] not in ranks):
                continue  # no text is ever merged into it
            node = self.ends
            for byte in reversed(token):
                node = node.setdefault(byte, {None: None})
            node[None] = rank
            edges = ([], []) if len(token) == 1 else (self.heads[ranks[parts[0]]], self.tails[ranks[parts[1]]])
            for spines, part, inner in zip((self.heads, self.tails), (parts[0], parts[-1]), edges):
                spines[rank] = [*inner[:-1], *([(part, rank)] if inner else []), (token, math.inf)]
            self.rising &= len(token) == 1 or rank > max(ranks[p] for p in parts)
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}  # the pieces before; what is asked for again stays
        self.pairs: dict[int, bool] = {}  # under the first token << 20 | the second

    def _merge(self, data: bytes) -> list[bytes]:
        """Merges the leftmost pair of lowest rank while more than two parts are left and there is one."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 2:
            rank, at = min((self.ranks.get(a + b, math.inf), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == math.inf:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def merged(self, data: bytes) -> list[int]:
        """The definition of an encoding, for short byte strings."""
        parts = self._merge(data)
        whole = self.ranks.get(data) if len(parts) == 2 else None
        return [self.ranks[p] for p in parts] if whole is None else [whole]

    def together(self, a: int, b: int) -> bool:
        """Whether the encoding of both tokens' bytes is just these two."""
        fits = self.pairs.get(a << 20 | b)
        if fits is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            fits = self.pairs[a << 20 | b] = self._apart(a, b) if self.rising else self.merged(self.bytes[a] + self.bytes[b]) == [a, b]
        return fits

    def _apart(self, a: int, b: int) -> bool:
        """That no merge crosses from a to b. Where ranks rise, a part stands at the seam from its own rank to that of the part it goes
        into; parts x and y that meet there merge if their joined rank comes before either of those (on a tie the left one is first)."""
        left, right, i, j, ranks = self.tails[a], self.heads[b], 0, 0, self.ranks
        while True:
            (x, x_goes), (y, y_goes) = left[i], right[j]
            rank = ranks.get(x + y)
            if rank is not None and rank < x_goes and rank <= y_goes:
                return False
            if x_goes <= y_goes:
                if x_goes == math.inf:
                    return True
                i += 1
            else:
                j += 1

    def prefixes(self, data: bytes, last: list[int] | None = None) -> list[int]:
        """The last token of each prefix of a piece; ``last`` has those of a shorter prefix already and is not changed."""
        last = [] if last is None else list(last)
        known, ends = self.pairs.get, self.ends
        for end in range(len(last), len(data)):
            node, start = ends, end
            try:
                while True:
                    node = node[data[start]]
                    token = node[None]
                    if token is not None:
                        if start == 0:
                            break
                        fits = known(last[start - 1] << 20 | token)
                        if fits or fits is None and self.together(last[start - 1], token):
                            break
                    start -= 1
                    if start < 0:
                        raise KeyError
            except KeyError:
                raise ValueError(f"bytes {data[: end + 1]!r} have no encoding") from None
            last.append(token)
        return last

    def walk(self, last: list[int], start: int, end: int) -> list[int]:
        """The tokens between two piece ends, read backwards from the stored states."""
        out = []
        while end > start:
            token = last[end - 1]
            out.append(token)
            end -= len(self.bytes[token])
        out.reverse()
        return out

    def piece(self, text: str) -> tuple[int, ...]:
        """The tokens of one piece."""
        ids = self.pieces.get(text) or self.older.get(text)
        if ids is None:
            data = text.encode()
            whole = self.ranks.get(data)
            ids = (whole,) if whole is not None else tuple(self.walk(self.prefixes(data), 0, len(data)))
            if len(data) > KEPT_BYTES:
                return ids
        if len(self.pieces) >= KEPT_PIECES:
            self.older, self.pieces = self.pieces, {}
        self.pieces[text] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        known = self.pieces.get
        for piece in self.pattern.findall(text) if len(text) < KEPT_TEXT else (m[0] for m in self.pattern.finditer(text)):
            ids += known(piece) or self.piece(piece)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes[i] for i in ids])


class Prefixes:
    """A text with the last token of each of its byte prefixes (each within its piece): encodings of it can be carried on."""

    def __init__(self, tokens: Tokens, text: str = ""):
        self.tokens, self.text, self.last = tokens, "", []
        self.starts: list[int] = []  # of pieces, in characters
        self.places: list[int] = []  # of pieces, in bytes
        self.edit(0, 0, text)

    @classmethod
    def stored(cls, tokens: Tokens, text: str, last: list[int]) -> Prefixes:
        """From a stored text and its states; only the pieces are found again."""
        out = cls(tokens)
        out.text, out.last = text, list(last)
        at = 0
        for match in tokens.pattern.finditer(text):
            out.starts.append(match.start())
            out.places.append(at)
            at += len(match[0].encode())
        return out

    def append(self, more: str) -> Prefixes:
        return self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, new: str) -> Prefixes:
        """Puts ``new`` in the place of the characters start..end. Returns itself."""
        text = self.text[:start] + new + self.text[end:]
        shift, ends = len(text) - len(self.text), self.starts[1:] + [len(self.text)]
        first = int(np.searchsorted(np.array(ends, np.int64) + SEEN, start, "right"))  # the first piece that could see the edit
        at = self.starts[first] if first < len(self.starts) else (ends[-1] if self.starts else 0)
        place = self.places[first] if first < len(self.places) else len(self.last)
        starts, places, last = self.starts[:first], self.places[:first], self.last[:place]
        known = {s: i for i, s in enumerate(self.starts) if s >= end and i >= first}
        stop = None
        for match in self.tokens.pattern.finditer(text, at):
            if match.start() >= start + len(new) and (stop := known.get(match.start() - shift)) is not None:
                break
            data = match[0].encode()
            old = []
            if first < len(self.starts) and match.start() == self.starts[first]:  # prefixes of the first piece before the edit stay
                same = len(text[match.start() : max(match.start(), min(start, match.end(), ends[first]))].encode())
                old = self.last[place : place + max(0, min(same, self._end(first) - place - 1))]
            states = self.tokens.prefixes(data, old)
            if (whole := self.tokens.ranks.get(data)) is not None:
                states[-1] = whole
            starts.append(match.start())
            places.append(len(last))
            last += states
        if stop is not None:
            moved = len(last) - self.places[stop]
            starts += [s + shift for s in self.starts[stop:]]
            places += [p + moved for p in self.places[stop:]]
            last += self.last[self.places[stop] :]
        self.text, self.starts, self.places, self.last = text, starts, places, last
        return self

    def _end(self, piece: int) -> int:
        return self.places[piece + 1] if piece + 1 < len(self.places) else len(self.last)

    def ids(self) -> list[int]:
        out = []
        for start, end in zip(self.places, self.places[1:] + [len(self.last)]):
            out += self.tokens.walk(self.last, start, end)
        return out


def _named(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with its columns of these names renamed out of the way."""
    for name in names:
        for old in [c for c in df.columns if c.lower() == name]:
            df = df.withColumnRenamed(old, free_name(df, f"_{old}"))
    return df


_HELD: dict[str, Tokens] = {}


def _tokens(ranks: dict[bytes, int], pattern: str, key: str) -> Tokens:
    """A worker's vocabulary: it and what it remembers serve all tasks of the process."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Tokens(ranks, pattern)
    return _HELD[key]


def _key(ranks: dict[bytes, int], pattern: str) -> str:
    return hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()


def _mapped(df: DataFrame, inputs: tuple[str, ...], work, name: str, kind: str, arrow: pa.DataType) -> DataFrame:
    """``df`` with one more column, made a row at a time by the function that ``work()`` returns in a task."""
    kept, held = df.columns, [f"c{i}" for i in range(len(df.columns))]  # mapInArrow cannot take names with dots
    df = in_small_batches(df.toDF(*held))
    schema = df.withColumn("made", F.lit(None).cast(kind)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = work()
        for batch in batches:
            read = [batch.column(kept.index(c)) for c in inputs]
            made = pa.array((of(*(x[i].as_py() for x in read)) for i in range(batch.num_rows)), arrow, size=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*held, "made"])

    return df.mapInArrow(run, schema).toDF(*kept, name)


STATES = ("struct<last:array<int>,ids:array<int>>", pa.struct([("last", pa.list_(pa.int32())), ("ids", pa.list_(pa.int32()))]))


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", with_prefixes: bool = False) -> DataFrame:
    """``df`` with ``ids`` (array<int>), and where asked for ``last``, the state of each byte prefix."""
    key = _key(ranks, pattern)
    if not with_prefixes:
        plain = lambda: lambda value: _tokens(ranks, pattern, key).encode(value or "")
        return _mapped(_named(df, "ids"), (text,), plain, "ids", "array<int>", pa.list_(pa.int32()))
    df = _named(df, "ids", "last")
    name = free_name(df, "_state")

    def work():
        def of(value: str | None) -> dict:
            state = Prefixes(_tokens(ranks, pattern, key), value or "")
            return {"last": state.last, "ids": state.ids()}

        return of

    out = _mapped(df, (text,), work, name, *STATES)
    return out.withColumns({"ids": F.col(f"`{name}`.ids"), "last": F.col(f"`{name}`.last")}).drop(name)


def append_texts(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", more: str = "more", last: str = "last") -> DataFrame:
    """``df`` whose ``last`` holds the states of ``text`` followed by ``more`` (null: nothing), whose texts are joined in
    ``text``; old prefixes are not encoded again (a null ``last`` is). ``ids`` has the whole encoding."""
    key = _key(ranks, pattern)
    df = df if "ids" not in df.columns else df.drop("ids")
    name = free_name(df, "_state")

    def work():
        def of(value: str | None, tail: str | None, states: list[int] | None) -> dict:
            tokens = _tokens(ranks, pattern, key)
            state = Prefixes(tokens, value or "") if states is None else Prefixes.stored(tokens, value or "", states)
            state.append(tail or "")
            return {"last": state.last, "ids": state.ids()}

        return of

    out = _mapped(df, (text, more, last), work, name, *STATES)
    whole = F.concat(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.coalesce(F.col(f"`{more}`"), F.lit("")))
    return out.withColumns({text: whole, last: F.col(f"`{name}`.last"), "ids": F.col(f"`{name}`.ids")}).drop(name)


def decode(df: DataFrame, ranks: dict[bytes, int], ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded`` (binary): the bytes of its ids; a null list is empty."""

    def work():
        table = {rank: token for token, rank in ranks.items()}
        return lambda value: b"".join([table[i] for i in value or ()])

    return _mapped(_named(df, "decoded"), (ids,), work, "decoded", "binary", pa.binary())


def digests(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text") -> DataFrame:
    """(other columns, n_tokens, ids_sha256, decoded_sha256): each text is encoded, its ids decoded again, and both hashed,
    in one pass that hands on neither."""
    key = _key(ranks, pattern)
    df = _named(df, "n_tokens", "ids_sha256", "decoded_sha256")
    kept = [c for c in df.columns if c != text]
    name = free_name(df, "_digest")

    def work():
        def of(value: str | None) -> dict:
            tokens = _tokens(ranks, pattern, key)
            ids = tokens.encode(value or "")
            return {"n": len(ids), "a": hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), "b": hashlib.sha256(tokens.decode(ids)).hexdigest()}

        return of

    out = _mapped(df, (text,), work, name, "struct<n:long,a:string,b:string>", pa.struct([("n", pa.int64()), ("a", pa.string()), ("b", pa.string())]))
    at = lambda field: F.col(f"`{name}`.{field}")
    return out.select(*(F.col(f"`{c}`") for c in kept), at("n").alias("n_tokens"), at("a").alias("ids_sha256"), at("b").alias("decoded_sha256"))
