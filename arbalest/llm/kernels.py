"""Array kernels on Arrow string columns: words, hashes of words, hashes of word windows.

A batch's texts are handled as one byte array, so that numpy's cost is per batch and not per document. Batches are
cut into slices of half a megabyte, which bounds a worker's memory; a single longer text forms a slice of its own.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
SLICE_BYTES = 1 << 19
#: Words longer than this are hashed one by one.
LONG_WORD = 256
#: Primes below 2**31 with a base each for the hashes of ranges.
PRIMES = ((2147483647, 1204567891), (2147483629, 1830264571))

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


class _Powers:
    """Powers of a base and of its inverse modulo a prime, grown on demand."""

    def __init__(self, prime: int, base: int):
        self.prime, self.bases = prime, (base, pow(base, -1, prime))
        self.up = self.down = np.ones(1, U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up, self.down = (np.concatenate([old, old * U(pow(b, k, self.prime)) % U(self.prime)]) for old, b in zip((self.up, self.down), self.bases))
        return self.up, self.down


_POWERS = [_Powers(*p) for p in PRIMES]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def slices(texts: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``limit`` bytes; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, places, data = texts.buffers()
    places = np.frombuffer(places, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(places, places[row] + limit, "right")) - 1)
        yield row, end, data[places[row] : places[end]], places[row : end + 1] - places[row]
        row = end


def words(data: np.ndarray, places: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words of each text) of maximal runs of bytes outside ``breaks``, none across two texts."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(places) - 1, np.int64)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~breaks[data]
    edge = np.zeros(n + 1, bool)
    edge[places] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return starts, ends, np.diff(np.searchsorted(starts, places))


_TAILS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], U)


def fresh_key() -> int:
    """A random key for ``word_hashes``, drawn for each job."""
    return secrets.randbits(63) | 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int = 0) -> np.ndarray:
    """64-bit hashes of words, eight bytes a step through a bijection; words of up to eight bytes and equal length never collide.
    Longer words can be made to collide by whoever knows the function: where no bytes are compared afterwards, a job draws a secret
    ``key``, which goes into every step, and no text can be made to fit it."""
    size = ends - starts
    if key:
        scale, offset = mix(np.array([key, key + 1], U)) | U(1)
        scrambled = lambda x: mix(x * scale + offset)
    else:
        scrambled = mix
    padded = np.append(data, np.zeros(8, np.uint8))
    eights = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    out = scrambled(size.astype(U) + U(0x9E3779B97F4A7C15))
    live, at, left = None, starts, size
    while True:
        step = scrambled((out if live is None else out[live]) ^ (eights[at] & _TAILS[np.minimum(left, 8)]))
        if live is None:
            out, more = step, np.flatnonzero((left > 8) & (size <= LONG_WORD))
            live = more
        else:
            out[live] = step
            more = np.flatnonzero(left > 8)
            live = live[more]
        if not len(live):
            break
        at, left = at[more] + 8, left[more] - 8
    long = np.flatnonzero(size > LONG_WORD)
    if len(long):
        view = memoryview(np.ascontiguousarray(data))
        out[long] = [xxhash.xxh3_64_intdigest(view[a:b], key) for a, b in zip(starts[long].tolist(), ends[long].tolist())]
    return out


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """All words joined by one space, and the place of each word in it (one more: the end, with a space counted after it)."""
    first = np.append(0, np.cumsum(ends - starts + 1))
    out = np.full(int(first[-1]), 0x20, np.uint8)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    kept = data[np.cumsum(inside[:-1]).astype(bool)]
    where = np.ones(len(out), bool)
    where[first[1:] - 1] = False
    out[where] = kept
    return out.tobytes(), first


def word_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words themselves as an Arrow array."""
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    places = np.append(0, np.cumsum(ends - starts))
    wide = places[-1] >= 1 << 31
    kind = (pa.large_binary(), np.int64) if wide else (pa.binary(), np.int32)
    return pa.Array.from_buffers(kind[0], len(starts), [None, pa.py_buffer(places.astype(kind[1])), pa.py_buffer(data[np.cumsum(inside[:-1]).astype(bool)])])


def digests(line: bytes, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """XXH3 of the bytes lo..hi of each range: of the words themselves, independent of their names."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(line[a:b]) for a, b in zip(lo.tolist(), hi.tolist())), U, len(lo))


class Ranges:
    """Hashes of ranges of a sequence of 64-bit names, by polynomials modulo two primes."""

    def __init__(self, names: np.ndarray):
        self.parts = []
        for (prime, _), powers in zip(PRIMES, _POWERS):
            up, down = powers.to(len(names) + 1)
            sums = np.zeros(len(names) + 1, U)
            np.cumsum(names % U(prime) * up[: len(names)] % U(prime), out=sums[1:])  # below 2**64 up to 2**33 names
            self.parts.append((U(prime), sums, down))

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        a, b = ((sums[ends] - sums[starts]) % p * down[starts] % p for p, sums, down in self.parts)
        return mix((a << U(32) | b) ^ mix((ends - starts).astype(U)))


def window_starts(counts: np.ndarray, size: int) -> np.ndarray:
    """Starts, as indices over all words, of the windows of ``size`` words that lie in one text."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return np.flatnonzero(owner[: max(0, len(owner) - size + 1)] == owner[size - 1 :]) if len(owner) >= size else np.zeros(0, np.int64)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
