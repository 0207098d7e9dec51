"""Removal of repeated byte strings by hash-compared suffix sorting.

Every string of ``LENGTH`` bytes contains the smallest hash among its short grams (its anchor), and equal strings have
equal anchors. In a first exchange only anchors move, as short hashes: those of a single document cannot be part of a
repeat. In a second one, the runs of strings around the other anchors travel as segments to the task that their
anchor's hash names, so equal strings of all documents meet there. That task sorts the suffixes that start in its
segments: a prefix polynomial hash gives the common extension of two suffixes by binary search, a merge sort needs only
such comparisons, and bytes are compared before neighbours count as equal. The smallest document id of equal neighbours
keeps its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.llm.shared import partitions_for, stored, text_or_empty
from clientele.llm.words import U64, mixed, prefix_hash, slices, span_hash

LENGTH, GRAM = 50, 20
BYTES_PER_PARTITION = 12_000_000
# Buckets follow the bytes alone, so that blobs do not multiply with tasks times partitions.
BYTES_PER_BUCKET, BUCKETS = 1_500_000, 64
HELD_ANCHORS, HELD_BYTES = 1_000_000, 12_000_000  # what a task gathers before it sends blobs
POSITION_BITS = 22
SLICE_BYTES = 2_000_000
# Anchors with more occurrences send single strings instead of segments, each to the bucket that its own hash names.
HOT_ANCHOR = 10_000


def extension(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Bytes that the suffixes at a and b have in common, up to ``limit``: binary search over prefix hashes."""
    low, high = np.zeros(len(a), dtype=np.int64), limit.astype(np.int64)
    for _ in range(int(high.max(initial=0)).bit_length()):
        middle = (low + high + 1) >> 1
        same = span_hash(prefix, a, a + middle) == span_hash(prefix, b, b + middle)
        low = np.where(same, middle, low)
        high = np.where(same, high, middle - 1)
    return low


def _before(data: np.ndarray, prefix: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the suffix at a sorts before the one at b; equal suffixes sort by position."""
    limit = np.full(len(a), length)
    common = extension(prefix, a, b, limit)
    differs = common < length
    at = np.where(differs, common, 0)
    return np.where(differs, data[a + at] < data[b + at], a < b)


def suffix_order(data: np.ndarray, prefix: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """``starts`` in order of the ``length`` bytes from each on; equal ones by position.

    The first sixteen bytes are compared as numbers. What ties there goes through a bottom-up merge sort within its
    tie: in each round all runs are merged at once, an element's place being its own rank plus the number of elements
    of the other run before it, found by binary search with hash comparisons.
    """
    head = min(length, 16)
    words = np.zeros((2, len(starts)), dtype=U64)
    for i in range(head):
        words[i // 8] = (words[i // 8] << U64(8)) | data[starts + i]
    order = np.lexsort((starts, words[1], words[0]))
    starts, first, second = starts[order], words[0][order], words[1][order]
    if length <= 16 or len(starts) < 2:
        return starts
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    tie = np.cumsum(new) - 1
    size = np.bincount(tie)
    members = np.flatnonzero(size[tie] > 1)
    if not len(members):
        return starts
    own = starts[members]
    # Position within the tie and the tie's extent, in the compacted array of tied suffixes.
    group = tie[members]
    opens = np.ones(len(own), dtype=bool)
    opens[1:] = group[1:] != group[:-1]
    begin = np.flatnonzero(opens)
    base = np.repeat(begin, np.diff(np.append(begin, len(own))))
    past = np.repeat(np.append(begin[1:], len(own)), np.diff(np.append(begin, len(own))))
    rank = np.arange(len(own)) - base
    width, largest = 1, int(size.max())
    while width < largest:
        run = rank // width
        # The sibling run: [low, high) in the compacted array.
        low = np.minimum(base + (run ^ 1) * width, past)
        high = np.minimum(low + width, past)
        left, right = low.copy(), high.copy()
        active = np.flatnonzero(left < right)
        while len(active):
            middle = (left[active] + right[active]) >> 1
            earlier = _before(data, prefix, own[middle], own[active], length)
            left[active] = np.where(earlier, middle + 1, left[active])
            right[active] = np.where(earlier, right[active], middle)
            active = active[left[active] < right[active]]
        place = base + (run & ~1) * width + (rank - run * width) + (left - low)
        merged = np.empty_like(own)
        merged[place] = own
        own = merged
        width *= 2
    starts[members] = own
    return starts


def anchors(data: np.ndarray, offsets: np.ndarray, prefix: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, start, past, hash, anchor) of every maximal run of ``length``-byte strings with one anchor; bytes [start, past)."""
    none = np.empty(0, np.int64)
    n = len(data) - length + 1
    if n < 1:
        return none, none, none, np.empty(0, U64), none
    spots = np.arange(len(data) - gram + 1)
    grams = mixed(span_hash(prefix, spots, spots + gram))
    packed = (grams & ~U64((1 << POSITION_BITS) - 1)) | spots.astype(U64)
    width, span = length - gram + 1, 1
    least = packed
    while span * 2 <= width:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    anchor = (least[:n] & U64((1 << POSITION_BITS) - 1)).astype(np.int64)
    row = np.searchsorted(offsets, np.arange(n), side="right") - 1
    whole = np.arange(n) + length <= offsets[row + 1]
    at = np.flatnonzero(whole)
    if not len(at):
        return none, none, none, np.empty(0, U64), none
    opens = np.ones(len(at), dtype=bool)
    opens[1:] = (anchor[at[1:]] != anchor[at[:-1]]) | (row[at[1:]] != row[at[:-1]])
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(at)) - 1
    spot = anchor[at[first]]
    return row[at[first]], at[first], at[last] + length, grams[spot], spot


def gather(data: np.ndarray, start: np.ndarray, past: np.ndarray) -> np.ndarray:
    """The bytes [start, past) of all segments, one after the other."""
    size = past - start
    ends = np.cumsum(size)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)
    return data[at]


def _equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[a : a + size] == data[b : b + size], byte by byte."""
    if not len(a):
        return np.empty(0, bool)
    same = gather(data, a, a + size) == gather(data, b, b + size)
    ends = np.cumsum(size)
    return np.logical_and.reduceat(same, ends - size)


def _pieces(batches: Iterator[pa.RecordBatch], length: int, gram: int):
    """Per piece of text: its batch, bytes, prefix hash, and the document row, place in the document, extent and hash of
    every anchored run."""
    for batch, data, offsets in slices(batches, limit=SLICE_BYTES):
        pieces = _long_document(data, length) if len(data) >= 1 << POSITION_BITS else [(data, offsets, 0)]
        for part, at, shift in pieces:
            prefix = prefix_hash(part)
            row, start, past, hashes, spot = anchors(part, at, prefix, length, gram)
            if len(row):
                base = at[row] - shift
                yield batch, part, prefix, row, start, past, hashes, start - base, spot - base


def _by_bucket(bucket: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    """Positions of each bucket's entries, in order of documents."""
    order = np.lexsort((doc, bucket))
    return np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []


def _blob_batch(names: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])


ANCHORS = (("mark", np.uint32), ("doc", np.int64), ("at", np.int32))
SEGMENTS = (("doc", np.int64), ("at", np.int32), ("size", np.int32))


def _packed(parts: dict[str, np.ndarray], columns, body: np.ndarray) -> bytes:
    """Columns and bytes, compressed; document ids as differences, which are small."""
    fields = {**parts, "doc": np.diff(parts["doc"], prepend=0)}
    raw = np.int64(len(parts["doc"])).tobytes() + b"".join(fields[n].astype(t).tobytes() for n, t in columns) + body.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(blob: bytes, columns) -> tuple[dict[str, np.ndarray], np.ndarray]:
    raw = pa.decompress(memoryview(blob)[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    n, at, parts = int(np.frombuffer(raw, np.int64, 1)[0]), 8, {}
    for name, kind in columns:
        parts[name] = np.frombuffer(raw, kind, n, at)
        at += n * np.dtype(kind).itemsize
    parts["doc"] = np.cumsum(parts["doc"])
    return parts, np.frombuffer(raw, np.uint8, -1, at)


def _bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The blobs of a task, bucket by bucket; they stay compressed until their bucket's turn."""
    held: dict[int, list[bytes]] = {}
    for batch in batches:
        for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held.setdefault(bucket, []).append(blob)
    for bucket in list(held):
        yield held.pop(bucket)


def _anchor_rows(batches: Iterator[pa.RecordBatch], buckets: int, length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(bucket, blob) rows of anchors. A bucket keeps thirty-two bits of the hash; what they confuse is sorted out by the
    suffix sort."""
    held: list[tuple[np.ndarray, ...]] = []

    def flush() -> pa.RecordBatch:
        bucket, mark, doc, at = (np.concatenate(x) for x in zip(*held))
        held.clear()
        runs = _by_bucket(bucket, doc)
        blobs = [_packed({"mark": mark[r], "doc": doc[r], "at": at[r]}, ANCHORS, np.empty(0, np.uint8)) for r in runs]
        return _blob_batch([int(bucket[r[0]]) for r in runs], blobs)

    for batch, _, _, row, _, _, hashes, _, spot in _pieces(batches, length, gram):
        doc = batch.column(0).to_numpy(zero_copy_only=False)[row]
        mark = ((hashes // U64(buckets)) & U64(0xFFFFFFFF)).astype(np.uint32)
        held.append(((hashes % U64(buckets)).astype(np.int32), mark, doc, spot.astype(np.int32)))
        if sum(len(h[0]) for h in held) >= HELD_ANCHORS:
            yield flush()
    if held:
        yield flush()


def _shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, code) of the anchors whose hash stands in two documents or more: twice their place, plus one if it occurs
    more than HOT_ANCHOR times. Blobs are unpacked one at a time, first to count and then to look up."""
    for blobs in _bucketed(batches):
        sums = []
        for blob in blobs:
            parts = _unpacked(blob, ANCHORS)[0]
            sums.append(_anchor_sums(parts["mark"], parts["doc"], parts["doc"], np.ones(len(parts["doc"]), dtype=np.int64)))
            if len(sums) > 1 and len(sums[-1][0]) * 2 > len(sums[0][0]):
                sums = [_anchor_sums(*(np.concatenate(c) for c in zip(*sums)))]
        key, low, high, n = _anchor_sums(*(np.concatenate(c) for c in zip(*sums)))
        for blob in blobs:
            parts = _unpacked(blob, ANCHORS)[0]
            own = np.searchsorted(key, parts["mark"])
            kept = np.flatnonzero(low[own] != high[own])
            if len(kept):
                code = 2 * parts["at"][kept].astype(np.int64) + (n[own[kept]] > HOT_ANCHOR)
                yield pa.RecordBatch.from_arrays([pa.array(parts["doc"][kept]), pa.array(code)], ["doc", "code"])


def _anchor_sums(key: np.ndarray, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Smallest and largest document and number of occurrences of every anchor, by anchor."""
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    return ranked[first], np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first), np.add.reduceat(n[order], first)


def _to_send(part: np.ndarray, prefix: np.ndarray, doc: np.ndarray, where: np.ndarray, start: np.ndarray, past: np.ndarray) -> np.ndarray:
    """Whether a segment goes on; the others equal one of a smaller document."""
    content = mixed(span_hash(prefix, start, past) + (past - start).astype(U64))
    order = np.lexsort((where, doc, content))
    same = np.zeros(len(order), dtype=bool)
    a, b = order[:-1], order[1:]
    near = np.flatnonzero((content[a] == content[b]) & (past[a] - start[a] == past[b] - start[b]))
    same[near + 1] = _equal_bytes(part, start[a[near]], start[b[near]], (past - start)[a[near]])
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    send = np.ones(len(order), dtype=bool)
    send[order[same & (doc[order] > doc[order[head]])]] = False
    return send


def _known_runs(doc: np.ndarray, where: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(doc, start, size) of the runs that strings starting at consecutive places cover."""
    order = np.lexsort((where, doc))
    doc, where = doc[order], where[order]
    first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (where[1:] > where[:-1] + 1))[: len(doc)])
    last = np.append(first[1:], len(doc))[: len(first)] - 1
    return doc[first], where[first], where[last] + length - where[first]


def _segment_rows(batches: Iterator[pa.RecordBatch], buckets: int, length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(bucket, blob) rows of the segments around shared anchors.

    Of equal segments in a slice only the smallest document's goes on; the strings of the others are known to repeat,
    and go along as (document, start, -size). What is left of a hot anchor's segments goes string by string: equal
    strings still meet, and the anchor spreads over all buckets.
    """
    held: list[tuple[np.ndarray, ...]] = []

    def flush() -> pa.RecordBatch:
        bucket, doc, at, size, texts = (np.concatenate(x) for x in zip(*held))
        held.clear()
        names, blobs = [], []
        for run in _by_bucket(bucket, doc):
            body = np.frombuffer(b"".join(t for t in texts[run] if t is not None), np.uint8)
            names.append(int(bucket[run[0]]))
            blobs.append(_packed({"doc": doc[run], "at": at[run], "size": size[run]}, SEGMENTS, body))
        return _blob_batch(names, blobs)

    def bucket_of(hashes: np.ndarray) -> np.ndarray:
        return (hashes % U64(buckets)).astype(np.int32)

    def add(part, hashes, doc, where, start, past) -> None:
        texts = np.full(len(start), None, dtype=object)
        if len(start):
            texts[:] = [b.tobytes() for b in np.split(gather(part, start, past), np.cumsum(past - start)[:-1])]
        held.append((bucket_of(hashes), doc, where, past - start, texts))

    for batch, part, prefix, row, start, past, hashes, where, spot in _pieces(batches, length, gram):
        lists = batch.column(2)
        owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
        codes = lists.flatten().to_numpy(zero_copy_only=False)
        shared = (owner << 32) | (codes >> 1)
        order = np.argsort(shared)
        shared, is_hot = shared[order], (codes & 1).astype(bool)[order]
        spots = (row.astype(np.int64) << 32) | spot
        found = np.minimum(np.searchsorted(shared, spots), len(shared) - 1)
        pick = np.flatnonzero(shared[found] == spots)
        if not len(pick):
            continue
        row, start, past, hashes, where, hot = row[pick], start[pick], past[pick], hashes[pick], where[pick], is_hot[found[pick]]
        doc = batch.column(0).to_numpy(zero_copy_only=False)[row]
        send = _to_send(part, prefix, doc, where, start, past)
        split = np.flatnonzero(hot & send)
        hashes[hot] = mixed(doc[hot].astype(U64) + where[hot].astype(U64))  # what is known to repeat may go anywhere
        if len(split):
            counts = past[split] - start[split] - length + 1
            own = np.repeat(split, counts)
            shift = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
            alone = _to_send(part, prefix, doc[own], where[own] + shift, start[own] + shift, start[own] + shift + length)
            strings, shift, rest = own[alone], shift[alone], (doc[own[~alone]], where[own[~alone]] + shift[~alone])
            begin = start[strings] + shift
            add(part, mixed(span_hash(prefix, begin, begin + length)), doc[strings], where[strings] + shift, begin, begin + length)
            again, at, size = _known_runs(*rest, length)
            held.append((bucket_of(mixed(again.astype(U64) + at.astype(U64))), again, at, -size, np.full(len(again), None, dtype=object)))
        rest = np.flatnonzero(~send)
        held.append((bucket_of(hashes[rest]), doc[rest], where[rest], start[rest] - past[rest], np.full(len(rest), None, dtype=object)))
        whole = np.flatnonzero(send & ~hot)
        add(part, hashes[whole], doc[whole], where[whole], start[whole], past[whole])
        if sum(int(h[3].clip(0).sum()) for h in held) >= HELD_BYTES:
            yield flush()
    if held:
        yield flush()


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with places of shared anchors."""
    return _opened(b.filter(pc.is_valid(b.column(3))) for b in batches)


def _long_document(data: np.ndarray, length: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """A document beyond the slice size as overlapping pieces: every string lies whole in one of them."""
    return [
        (data[s : s + SLICE_BYTES + length - 1], np.array([0, min(SLICE_BYTES + length - 1, len(data) - s)]), s)
        for s in range(0, len(data), SLICE_BYTES)
    ]


def _same_strings(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` bytes at a and b agree, eight at a time; the last eight may overlap those before."""
    if length < 8:
        return _equal_bytes(data, a, b, np.full(len(a), length))
    eights = np.ndarray((max(len(data) - 7, 0),), dtype="<u8", buffer=data, strides=(1,))
    same = np.ones(len(a), dtype=bool)
    for at in [*range(0, length - 7, 8), length - 8]:
        same &= eights[a + at] == eights[b + at]
    return same


def repeated_strings(doc: np.ndarray, begin: np.ndarray, size: np.ndarray, body: np.ndarray, prefix: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, offset) of every string of the segments that also starts in a smaller document."""
    none = np.empty(0, np.int64)
    # Strings that occur once cannot repeat: their hashes are grouped first, and only the others are sorted.
    counts = size - length + 1
    segment = np.repeat(np.arange(len(size)), counts)
    strings = np.arange(counts.sum()) + np.repeat(begin - (np.cumsum(counts) - counts), counts)
    if not len(strings):
        return none, none
    hashes = span_hash(prefix, strings, strings + length)
    order = np.argsort(hashes, kind="stable")
    first = np.flatnonzero(np.append(True, hashes[order][1:] != hashes[order][:-1]))
    many = np.diff(np.append(first, len(order)))
    order, many = order[np.repeat(many > 1, many)], many[many > 1]
    if not len(order):
        return none, none
    lead = np.cumsum(many) - many  # the first string of each hash, in order of position
    if _same_strings(body, strings[order], strings[np.repeat(order[lead], many)], length).all():
        # One suffix per hash is sorted, and stands for the equal ones, which follow it by position.
        heads = strings[order[lead]]
        back = np.argsort(heads)
        turn = back[np.searchsorted(heads[back], suffix_order(body, prefix, heads, length))]
        step = many[turn]
        order = order[np.arange(len(order)) + np.repeat(lead[turn] - (np.cumsum(step) - step), step)]
    else:  # different strings of one hash: every suffix is sorted
        chosen = np.sort(order)
        order = chosen[np.searchsorted(strings[chosen], suffix_order(body, prefix, strings[chosen], length))]
    owner = doc[segment[order]]
    alike = hashes[order[1:]] == hashes[order[:-1]]
    near = np.flatnonzero(alike)
    alike[near] = _same_strings(body, strings[order[near]], strings[order[near + 1]], length)
    first = np.flatnonzero(np.append(True, ~alike))
    least = np.minimum.reduceat(owner, first)
    later = owner > np.repeat(least, np.diff(np.append(first, len(owner))))
    found = np.sort(order[later])
    return segment[found], strings[found] - begin[segment[found]]


def _run_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Runs (doc, start, past) of bytes to remove."""
    for blobs in _bucketed(batches):
        parts = [_unpacked(b, SEGMENTS) for b in blobs]
        doc, at, size = (np.concatenate([p[n] for p, _ in parts]).astype(np.int64) for n, _ in SEGMENTS)
        body = np.concatenate([b for _, b in parts])
        known = size < 0
        out = [(doc[known], at[known], at[known] - size[known])]
        doc, at, size = doc[~known], at[~known], size[~known]
        begin, prefix = np.cumsum(size) - size, prefix_hash(body)
        # A segment that equals one of a smaller document repeats as a whole.
        alone = _to_send(body, prefix, doc, at, begin, begin + size)
        out.append((doc[~alone], at[~alone], at[~alone] + size[~alone]))
        doc, at, size, begin = doc[alone], at[alone], size[alone], begin[alone]
        segment, offset = repeated_strings(doc, begin, size, body, prefix, length)
        if len(segment):
            opens = np.ones(len(segment), dtype=bool)
            opens[1:] = (segment[1:] != segment[:-1]) | (offset[1:] != offset[:-1] + 1)
            first = np.flatnonzero(opens)
            last = np.append(first[1:], len(segment)) - 1
            own = segment[first]
            out.append((doc[own], at[own] + offset[first], at[own] + offset[last] + length))
        columns = [np.concatenate(c) for c in zip(*out)]
        if len(columns[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["doc", "start", "past"])


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, size, body): texts compressed, for their exchange."""
    for batch, _, _ in slices(batches):
        texts = [t.encode() for t in batch.column(1).to_pylist()]
        bodies = [pa.compress(t, codec="zstd", asbytes=True) if t else b"" for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(bodies, pa.binary())], ["key", "size", "body"])


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with ``text`` instead of (size, body), a few megabytes at a time; without a body there is no text."""
    for batch in batches:
        names = batch.schema.names
        size, body = (batch.column(names.index(n)).to_pylist() for n in ("size", "body"))
        others = [n for n in names if n not in ("key", "size", "body")]
        begin, held = 0, 0
        for end in range(1, batch.num_rows + 1):
            held += size[end - 1]
            if held < SLICE_BYTES and end < batch.num_rows:
                continue
            texts = [None if b is None else pa.decompress(b, decompressed_size=n, codec="zstd", asbytes=True) if n else b"" for n, b in zip(size[begin:end], body[begin:end])]
            part = batch.slice(begin, end - begin)
            text = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([part.column(names.index("key")), text, *[part.column(names.index(n)) for n in others]], ["key", "text", *others])
            begin, held = end, 0


def exact_copies(rows: DataFrame) -> DataFrame:
    """Stored (copy): keys of the rows (key, text) whose whole text stands in a row with a smaller key."""
    marked = stored(rows.select("key", F.sha2(F.col("text").cast("binary"), 256).alias("digest")))
    firsts = stored(marked.groupBy("digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    return stored(marked.join(firsts, "digest").filter("key > first").select(F.col("key").alias("copy")).distinct())


def repeated_spans(
    closed: DataFrame, texts: DataFrame, copies: DataFrame, parts: int, buckets: int = BUCKETS, length: int = LENGTH, gram: int = GRAM
) -> DataFrame:
    """(doc, start, past): byte runs whose ``length``-byte strings also start in a document with a smaller id.

    ``closed`` holds (key long, not null; size, body); ``texts`` is the same, partitioned by key. Whole copies are left out:
    what they hold stands in their first document. Runs may overlap and touch; together they cover exactly what repeats.
    """
    blobs = "bucket int, blob binary"
    own = closed.join(copies, F.col("key") == F.col("copy"), "left").select("key", "size", F.when(F.col("copy").isNull(), F.col("body")).alias("body"))
    known = own.mapInArrow(lambda b: _anchor_rows(_opened(b), buckets, length, gram), blobs)
    shared = known.repartition(parts, "bucket").mapInArrow(_shared_rows, "doc long, code long")
    spots = shared.groupBy("doc").agg(F.collect_list("code").alias("spots"))
    # An outer join, so that no filter is pushed below the exchange of the texts, which is used again.
    around = texts.join(spots, F.col("key") == F.col("doc"), "left").select("key", "size", "body", "spots")
    segments = around.mapInArrow(lambda b: _segment_rows(_wanted(b), buckets, length, gram), blobs)
    return segments.repartition(parts, "bucket").mapInArrow(lambda b: _run_rows(b, length), "doc long, start long, past long")


def merged(starts: list[int], pasts: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of the union."""
    out: list[list[int]] = []
    for start, past in sorted(zip(starts, pasts)):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], past)
        else:
            out.append([start, past])
    return [(a, b) for a, b in out]


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, _, _ in slices(batches):
        rows = []
        for key, text, runs in zip(*(batch.column(i).to_pylist() for i in range(3))):
            body = text.encode()
            spans = merged([r["start"] for r in runs], [r["past"] for r in runs])
            kept, at = [], 0
            for a, b in spans:
                kept.append(body[at:a])
                at = b
            rest = b"".join(kept) + body[at:]
            rows.append((key, len(body), sum(b - a for a, b in spans), [{"start": a, "past": b} for a, b in spans], rest))
        columns = list(zip(*rows)) if rows else [[]] * 5
        runs = pa.list_(pa.struct([("start", pa.int64()), ("past", pa.int64())]))
        types = (batch.column(0).type, pa.int64(), pa.int64(), runs, pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["key", "n_bytes", "n_removed", "removed", "kept"])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id``, n_bytes, n_removed, removed (maximal runs), kept (remaining bytes) for every row.

    Ids must be integers and unique, but for rows repeated as a whole, which do not make each other repeat; they decide
    which copy stays. A row without an id keeps all its bytes and makes no other row repeat. Null texts are empty.
    What is cut may split a character, so ``kept`` is binary.
    """
    kind = dict(docs.dtypes)[doc_id]
    rows = docs.select(F.col(doc_id).cast("long").alias("key"), text_or_empty(F.col(text)).alias("text"))
    volume = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = partitions_for(docs.sparkSession, volume, BYTES_PER_PARTITION)
    # Written once: anchors are read from there, and the exchange of the texts can only serve its two uses if no Python
    # stands below it.
    closed = stored(rows.mapInArrow(_closed, "key long, size long, body binary"), "none")
    keyed = closed.filter("key is not null")
    texts = keyed.repartition(parts, "key")
    copies = exact_copies(rows.filter("key is not null"))
    buckets = max(BUCKETS, -(-volume // BYTES_PER_BUCKET))
    runs = repeated_spans(keyed, texts, copies, parts, buckets, length, gram).groupBy("doc").agg(F.collect_set(F.struct("start", "past")).alias("runs"))
    none = F.array().cast("array<struct<start:long,past:long>>")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("size").alias("past")))
    removed = F.when(F.col("copy").isNotNull() & (F.col("size") >= length), whole).otherwise(F.coalesce("runs", none))
    joined = texts.join(runs, F.col("key") == F.col("doc"), "left").join(copies, F.col("key") == F.col("copy"), "left")
    joined = joined.select("key", "size", "body", removed.alias("runs"))
    full = joined.unionByName(closed.filter("key is null").withColumn("runs", none))
    schema = "key long, n_bytes long, n_removed long, removed array<struct<start:long,past:long>>, kept binary"
    return full.mapInArrow(lambda b: _cut_rows(_opened(b)), schema).select(F.col("key").cast(kind).alias(doc_id), "n_bytes", "n_removed", "removed", "kept")
