"""Words of whole Arrow text columns as numpy arrays.

Works on the UTF-8 bytes that Arrow hands over, in chunks of whole documents,
so no per-word Python object is made. Words are maximal runs of the bytes in a
256-entry class table; they get 64-bit hashes from a prefix-sum polynomial
over randomised byte values.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values(lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    if lower:
        values[65:91] = values[97:123]
    return values


#: Byte values with A-Z read as a-z, and as they are.
VALUES = _byte_values(lower=True)
CASED = _byte_values(lower=False)
#: [^\x20\x09-\x0D]+
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lowered: digits, letters, all beyond ASCII
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        tables = []
        for step in (_BASE, _INV):
            t = np.empty(size, np.uint64)
            t[0], done = 1, 1
            while done < size:
                k = min(done, size - done)
                t[done : done + k] = t[:k] * np.uint64(pow(step, done, 1 << 64))
                done += k
            tables.append(t)
        _powers[:] = tables
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Chunk:
    """Rows [first, last) of a batch: their bytes, and ``docs`` offsets into them."""

    first: int
    last: int
    data: np.ndarray
    docs: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.docs[i] : self.docs[i + 1]].tobytes()


def chunks(column: pa.Array, limit: int = CHUNK_BYTES, rows: int = 4096) -> Iterator[Chunk]:
    """Whole documents in chunks of about ``limit`` bytes and at most ``rows``; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(ends, ends[first] + limit, "right")) - 1
        last = min(max(last, first + 1), first + rows, len(column))
        yield Chunk(first, last, raw[ends[first] : ends[last]], ends[first : last + 1] - ends[first])
        first = last


def words(chunk: Chunk, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and offsets of each document's words."""
    m = is_word[chunk.data]
    n = len(m)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(chunk.docs), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[chunk.docs] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = m[:-1]
    starts = np.flatnonzero(m & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = m[1:]
    ends = np.flatnonzero(m & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, chunk.docs)


class Spans:
    """64-bit hashes of byte ranges of one array."""

    def __init__(self, data: np.ndarray, values: np.ndarray = VALUES):
        power, self.inverse = _power_tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * power[: len(data)], out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(chunk: Chunk, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words' bytes with A-Z lowered."""
    return Spans(chunk.data).hashes(starts, ends)


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words from each position on; needs len >= width."""
    n = len(hashes) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + n]
        out ^= out >> np.uint64(32)
    return mix(out)


def doc_numbers(offsets: np.ndarray) -> np.ndarray:
    """Document of each word, from the documents' word offsets."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
