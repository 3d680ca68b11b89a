"""Words and rolling word-window hashes of Arrow string columns, vectorised over whole batches.

Texts stay in Arrow's byte buffer: words are byte runs, so whitespace words and alphanumeric words
(both defined on ASCII, with every byte of a multi-byte character a word byte) need no decoding.
A null text has no words. Hashes are 64 bits wide, equal on every machine and Python version.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

SPACE_WORDS = "space"
ALNUM_WORDS = "alnum"
U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
WINDOW = U64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@lru_cache(maxsize=None)
def _tables(kind: str, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte: its lower-case byte, whether it stands in words, and its 64-bit value."""
    low = np.arange(256, dtype=np.uint8)
    if lower:
        low[65:91] += 32
    if kind == SPACE_WORDS:
        inside = np.ones(256, bool)
        inside[[32, *range(9, 14)]] = False
    else:
        inside = np.zeros(256, bool)
        inside[48:58] = inside[65:91] = inside[97:123] = inside[128:] = True
    value = mix(np.arange(1, 257, dtype=np.uint64) * U64(BASE))[low]
    return low, inside, value


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64."""
    if base not in _powers or len(_powers[base]) <= n:
        p = np.full(max(n + 1, 1 << 20), base & ((1 << 64) - 1), dtype=np.uint64)
        p[0] = 1
        _powers[base] = np.multiply.accumulate(p)
    return _powers[base][: n + 1]


def string_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string (or binary) column and the n + 1 offsets of its rows; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0 or column.buffers()[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    if column.null_count:
        length = np.diff(offsets)
        null = np.asarray(column.is_null())
        if length[null].any():  # bytes below a null
            keep = np.repeat(~null, length)
            data = data[offsets[0] : offsets[-1]][keep]
            length[null] = 0
            return data, np.concatenate([[0], np.cumsum(length)])
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of a batch of texts, in order.

    data, offsets: the bytes; start, end: of each word in data; first: row r's words are first[r] up to first[r + 1].
    """

    def __init__(self, column, kind: str = SPACE_WORDS, lower: bool = False):
        self.kind, self.lower = kind, lower
        self.data, self.offsets = string_buffers(column)
        _, inside, _ = _tables(kind, lower)
        n = len(self.data)
        flags = np.zeros(n + 2, np.int8)
        flags[1:-1] = inside[self.data]
        edge = np.diff(flags)  # 1 where a run begins, -1 just behind its end
        begins, ends = edge[:n] == 1, edge[1:] == -1
        cut = self.offsets[1:-1]  # a text's end ends a word
        cut = cut[(cut > 0) & (cut < n)]
        both = cut[(flags[cut] == 1) & (flags[cut + 1] == 1)]
        begins[both] = True
        ends[both - 1] = True
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.start)

    def row(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self, most: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word's bytes, or of its first `most` bytes."""
        out = np.empty(len(self), np.uint64)
        value = _tables(self.kind, self.lower)[2]
        block, at = 1 << 20, 0
        while at < len(self):  # in blocks of about 1 MB of bytes
            lo = int(self.start[at])
            to = max(at + 1, int(np.searchsorted(self.end, lo + block, "right")))
            hi = int(self.end[to - 1])
            p = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(value[self.data[lo:hi]] * _power(BASE, hi - lo)[: hi - lo], out=p[1:])
            s, e = self.start[at:to] - lo, self.end[at:to] - lo
            if most is not None:
                e = np.minimum(e, s + most)
            out[at:to] = mix((p[e] - p[s]) * _power(INVERSE, hi - lo)[s] + (e - s).astype(np.uint64) * WINDOW)
            at = to
        return out

    def bytes_of(self, i: int) -> bytes:
        raw = self.data[self.start[i] : self.end[i]]
        return (_tables(self.kind, self.lower)[0][raw] if self.lower else raw).tobytes()


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of k consecutive words from each word on, as if all rows were one; the last k - 1 are left out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= WINDOW
        out += hashes[j : j + n]
    return mix(out)


def window_starts(first: np.ndarray, k: int) -> np.ndarray:
    """True at each word from which k words stand in the same row."""
    n = int(first[-1])
    room = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    return room >= k


def member(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether each of x is among sorted_keys."""
    if not len(sorted_keys):
        return np.zeros(len(x), bool)
    i = np.searchsorted(sorted_keys, x)
    i[i == len(sorted_keys)] = 0
    return sorted_keys[i] == x


def cover(starts: np.ndarray, lengths, n: int) -> np.ndarray:
    """Which of n positions lie in one of the spans."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + lengths, n), -1)
    return np.cumsum(d[:-1]) > 0
