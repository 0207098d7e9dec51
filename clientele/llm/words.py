"""Vectorised word tables over Arrow text batches: boundaries and 64-bit hashes of all words without a per-word loop."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1  # odd, so that it has an inverse modulo 2^64
INVERSE = pow(BASE, -1, 2**64)
SLICE_BYTES = 2_000_000


def _bytes_where(test) -> np.ndarray:
    return np.array([test(b) for b in range(256)])


# ASCII letters and digits, and every byte of a character beyond ASCII.
WORD_BYTE = _bytes_where(lambda b: b >= 0x80 or chr(b).isalnum())
LOWERED = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


@lru_cache(maxsize=2)
def _powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(length, BASE, dtype=U64), np.full(length, INVERSE, dtype=U64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64, from the zeroth on."""
    room = max(SLICE_BYTES + 1, 1 << (length - 1).bit_length() if length > SLICE_BYTES + 1 else 0)
    up, down = _powers(room)
    return up[:length], down[:length]


def mixed(hashes: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (in place)."""
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        hashes ^= hashes >> U64(shift)
        hashes *= U64(factor)
    hashes ^= hashes >> U64(33)
    return hashes


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of byte x base^position modulo 2^64, with a leading zero."""
    out = np.empty(len(data) + 1, dtype=U64)
    out[0] = 0
    if len(data):
        terms = data.astype(U64)
        terms += U64(1)
        terms *= powers(len(data))[0]
        np.cumsum(terms, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of the bytes [start, end): equal for equal strings wherever they stand."""
    found = prefix[end] - prefix[start]
    found *= powers(len(prefix))[1][start]
    return found


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column one after the other, and the offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return body, at - at[0]


def slices(batches: Iterator[pa.RecordBatch], name: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of whole rows with at most ``limit`` text bytes (one row at least), each with its bytes and offsets."""
    for batch in batches:
        body, at = text_bytes(batch.column(batch.schema.get_field_index(name)))
        first = 0
        while first < batch.num_rows:
            last = max(int(np.searchsorted(at, at[first] + limit, side="right")) - 1, first + 1)
            yield batch.slice(first, last - first), body[at[first] : at[last]], at[first : last + 1] - at[first]
            first = last


class WordTable:
    """Words of a slice: ``row`` (of the slice), ``start``, ``end`` (bytes of the slice) and ``hash``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data = LOWERED[data]
        inside = WORD_BYTE[self.data]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(inside))]
        opens[edges] |= inside[edges]
        closes[edges - 1] |= inside[edges - 1]
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.row = np.searchsorted(offsets, self.start, side="right") - 1
        # Rows without bytes share an offset with the next row: the search above then ends at the last of them.
        self.prefix = prefix_hash(self.data)
        self.hash = mixed(span_hash(self.prefix, self.start, self.end))
        self.rows = len(offsets) - 1
        self.first = np.searchsorted(self.row, np.arange(self.rows + 1))  # first word of each row

    def head_hash(self, size: int) -> np.ndarray:
        """Hash of each word's first ``size`` bytes (0 for shorter words)."""
        long = self.end - self.start >= size
        found = np.zeros(len(self.start), dtype=U64)
        begin = self.start[long]
        found[long] = mixed(span_hash(self.prefix, begin, begin + size) + U64(size))
        return found

    def shingle_hash(self, size: int) -> np.ndarray:
        """Hash of the ``size`` words from each word on; meaningless where they cross a row's end (see ``whole``)."""
        n = max(len(self.hash) - size + 1, 0)
        total = np.zeros(n, dtype=U64)
        for i in range(size):
            total *= U64(BASE)
            total += self.hash[i : i + n]
        return mixed(total + U64(size))

    def whole(self, size: int) -> np.ndarray:
        """Which shingles of ``size`` words lie within one row."""
        n = max(len(self.hash) - size + 1, 0)
        return self.row[:n] == self.row[size - 1 : size - 1 + n]
