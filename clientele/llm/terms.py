"""Terms of text batches as Arrow arrays: exact dictionary lookups instead of hashes, and small packed tables as binaries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from clientele.llm.words import LOWERED


def byte_class(test) -> np.ndarray:
    """Table of the 256 bytes for which ``test`` holds."""
    return np.array([test(b) for b in range(256)])


def terms(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes of the class ``inside`` within each row, A-Z in lower case: (terms, start, row).

    ``data`` are the bytes of all rows one after the other, ``offsets`` their ends with a leading zero.
    """
    body = LOWERED[data]
    mask = inside[body]
    opens, closes = mask.copy(), mask.copy()
    opens[1:] &= ~mask[:-1]
    closes[:-1] &= ~mask[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(mask))]
    opens[edges] |= mask[edges]
    closes[edges - 1] |= mask[edges - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    ends = np.zeros(len(start) + 1, dtype=np.int64)
    np.cumsum(end - start, out=ends[1:])
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(body[mask]))])
    return found, start, np.searchsorted(offsets, start, side="right") - 1


def packed(batch: pa.RecordBatch) -> bytes:
    """A batch as one compressed binary."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(blob).read_next_batch()
