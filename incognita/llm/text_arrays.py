"""Words, lines and n-gram hashes of Arrow text columns, computed with numpy inside Spark tasks.

A batch of texts is treated as one byte array with text boundaries, so that the work is a few array
operations per batch and not a Python loop over words. Hashes are 64-bit polynomial hashes of the
UTF-8 bytes, finished by a bijective mixer; they are equal in every task and every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
UNBASE = pow(BASE, -1, 1 << 64)
#: Bytes of text taken at once; a longer single text is taken alone. A worker holds some 60 bytes for each of them.
PIECE_BYTES = 512 << 10

_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    table = _powers.get(base)
    if table is None or len(table) < n:
        size = max(n, 1 << 16)
        table = np.full(size, base, dtype=U64)
        table[0] = 1
        np.cumprod(table, out=table)
        _powers[base] = table
    return table[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def table(word_byte, lower: bool = False) -> np.ndarray:
    """For each byte: the byte to hash, or 0 where it separates words."""
    out = np.zeros(256, dtype=np.uint8)
    for b in range(256):
        low = b + 32 if lower and 0x41 <= b <= 0x5A else b
        if word_byte(low):
            out[b] = low
    return out


#: Words are runs of anything but ASCII white space (code points 32 and 9 to 13).
SPACED = table(lambda b: b != 0x20 and not 9 <= b <= 13)
SPACED_LOWER = table(lambda b: b != 0x20 and not 9 <= b <= 13, lower=True)
#: Words are runs of ASCII letters, ASCII digits and everything outside ASCII.
ALNUM_LOWER = table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80, lower=True)
# A zero byte belongs to a word under SPACED; 0 marks separators there, so it is hashed as 0xFF, which no UTF-8 text has.
SPACED[0] = SPACED_LOWER[0] = 0xFF


class Words:
    """Words of a batch of texts: byte spans, the text each stands in, and hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, letters: np.ndarray):
        self.data, self.offsets = data, offsets
        self.bytes = letters[data]
        inside = self.bytes != 0
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        firsts = offsets[:-1][offsets[:-1] < len(data)]
        starts[firsts] = inside[firsts]
        lasts = offsets[1:][offsets[1:] > 0] - 1
        ends[lasts] = inside[lasts]
        self.start, self.end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.text = np.searchsorted(offsets, self.start, side="right") - 1
        #: Words of text i are first[i] : first[i + 1].
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.bytes, self.start, self.end)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each data[start:end]."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * _power_table(BASE, n), out=sums[1:])
    back = _power_table(UNBASE, n + 1)
    return mix((sums[end] - sums[start]) * back[start] + (end - start).astype(U64))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n word hashes, text boundaries ignored."""
    count = len(words)
    if count < n:
        return np.empty(0, dtype=U64)
    sums = np.zeros(count + 1, dtype=U64)
    np.cumsum(words * _power_table(BASE, count), out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * _power_table(UNBASE, count + 1)[: count - n + 1] + U64(n))


def gram_hashes_within(words: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n words that stay in one text, and the index of each run's first word."""
    hashes = gram_hashes(words, n)
    at = np.flatnonzero(text[: len(hashes)] == text[n - 1 :]) if len(hashes) else np.empty(0, dtype=np.int64)
    return hashes[at], at


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes (of strings: UTF-8) and boundaries of an Arrow string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary()).fill_null(b"")
    else:
        column = column.cast(pa.large_string()).fill_null("")
    _, places, data = column.buffers()
    if not len(column):
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(places, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts batches into runs of rows whose texts have about limit bytes: rows, bytes, boundaries."""
    for batch in batches:
        data, offsets = buffers(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i + 1]]."""
    sums = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=sums[1:])
    return np.diff(sums[first])


def lists(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column whose row i holds values[first[i]:first[i + 1]]."""
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, kind))


def binaries(raw: bytes, starts: np.ndarray) -> pa.Array:
    """A binary column whose row i is raw[starts[i]:starts[i + 1]]."""
    return pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())
