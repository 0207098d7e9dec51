"""Lempel-Ziv phrase fingerprints: the set of dictionary phrases of a text as a one-permutation minimum-hash signature."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.llm.shared import partitions_for, range_bounds, range_of, text_or_empty
from clientele.llm.words import U64, mixed, slices

BINS = 128
EMPTY = 0xFFFF
BYTES_PER_PARTITION = 16_000_000


def phrases(body: bytes, at: int, seen: set[bytes], stop: int | None = None) -> tuple[list[bytes], int]:
    """LZ78 phrases from ``at`` on: each is the longest known phrase plus one byte. ``seen`` grows with them.

    Parsing ends with the text, or before the first phrase that would reach past ``stop``; returns the phrases and
    where parsing ended. Every prefix of a known phrase is known, so the search for the length starts at the last one.
    """
    end, found, size = len(body), [], 1
    while at < end:
        if body[at : at + size] in seen:
            size += 1
            while at + size <= end and body[at : at + size] in seen:
                size += 1
        else:
            while size > 1 and body[at : at + size - 1] not in seen:
                size -= 1
        if stop is not None and at + size > stop:
            break
        phrase = body[at : at + size]
        seen.add(phrase)
        found.append(phrase)
        at += size
    return found, at


def signature(parts: list[list[bytes]]) -> np.ndarray:
    """Minimum of the phrase hashes in each of ``BINS`` bins (16 bits; ``EMPTY`` for a bin without any)."""
    out = np.full(BINS, EMPTY, dtype=np.int64)
    hashes = np.array([crc32(p, len(p)) for part in parts for p in part], dtype=U64)
    if len(hashes):
        spread = mixed(hashes)
        np.minimum.at(out, (spread & U64(BINS - 1)).astype(np.int64), ((spread >> U64(40)) % U64(EMPTY)).astype(np.int64))
    return out


def as_hex(marks: np.ndarray) -> str:
    return marks.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of common phrases (Jaccard); 1 for two texts without any."""
    used = (a != EMPTY) | (b != EMPTY)
    return float((a[used] == b[used]).mean()) if used.any() else 1.0


def edited_text(text: str, following: str) -> tuple[str, int]:
    """The text with its last quarter of code points replaced by as many of the following text; and where it changes."""
    n = len(text) // 4
    keep = len(text) - n
    return text[:keep] + following[:n], keep


def text_prints(text: str, following: str) -> tuple[np.ndarray, np.ndarray, str]:
    """Signatures of a text and of its edited text, and the latter. The common start is parsed once."""
    changed, keep = edited_text(text, following)
    body, other = text.encode(), changed.encode()
    common = len(text[:keep].encode())
    seen: set[bytes] = set()
    head, at = phrases(body, 0, seen, common)
    tail, _ = phrases(body, at, seen)
    own = signature([head, tail])
    seen = set(head)
    return own, signature([head, phrases(other, at, seen)[0]]), changed


def lz_signature(text: str) -> np.ndarray:
    return signature([phrases(text.encode(), 0, set())[0]])


FIELDS = ("key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _print_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (part, ahead, key): each document is finished when its successor in the part arrives.

    A row's signature needs the successor's text first, so one document waits at a time. The rows marked ``ahead`` close
    their part and are not documents of it.
    """
    waiting: tuple | None = None  # (part, key, text)
    undone: tuple | None = None  # a finished row that lacks only the likeness to its successor
    out: list[tuple] = []
    kind = None

    def flush():
        columns = list(zip(*out))
        types = (kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], list(FIELDS))
        out.clear()
        return batch

    for batch, _, _ in slices(batches):
        kind = batch.column(2).type
        for part, ahead, key, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            own = None
            if waiting is not None and waiting[0] == part:
                own, other, changed = text_prints(waiting[2], text)
                if undone is not None:
                    out.append((*undone[0], likeness(undone[1], own)))
                row = (waiting[1], len(waiting[2]), hashlib.sha256(changed.encode()).hexdigest(), as_hex(own), as_hex(other), likeness(own, other))
                undone = (row, own)
            if ahead:
                if undone is not None:
                    out.append((*undone[0], likeness(undone[1], lz_signature(text))))
                waiting = undone = None
            else:
                waiting = (part, key, text)
        if out:
            yield flush()


def fingerprint_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    Documents are ranged by id (nulls first, equal ids by text), each range is sorted in its own task, and the first
    document of the next range is sent along to close it, so texts move once and no task sees more than its range.
    Null texts are empty texts: no code points, an empty signature. A single document follows itself.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("key"), text_or_empty(F.col(text)).alias("text"))
    volume = rows.agg(F.sum(F.octet_length("text"))).first()[0]
    parts = partitions_for(spark, volume or 0, BYTES_PER_PARTITION)
    bounds = range_bounds(rows.select("key"), "key", parts)
    part = range_of("key", bounds).alias("part")
    # One row per range (their number is set above, not by the documents): its first id, with nulls before all others.
    firsts = rows.select("key", part).groupBy("part").agg(F.min(F.struct(F.col("key").isNotNull().alias("known"), "key")).alias("first"))
    firsts = sorted((r["part"], r["first"]["known"], r["first"]["key"]) for r in firsts.collect())
    closing = [(firsts[i - 1][0], key, known) for i, (_, known, key) in enumerate(firsts)]
    kind = dict(rows.dtypes)["key"]
    ahead = spark.createDataFrame(closing, f"closes int, first_key {kind}, known boolean").drop("known")
    placed = rows.select("*", part).join(F.broadcast(ahead), F.col("key").eqNullSafe(F.col("first_key")), "left")
    no, yes = F.lit(False), F.lit(True)
    copies = F.array(F.struct(F.col("part").alias("part"), no.alias("ahead")))
    more = F.concat(copies, F.array(F.struct(F.col("closes").alias("part"), yes.alias("ahead"))))
    dealt = placed.select("key", "text", F.explode(F.when(F.col("closes").isNull(), copies).otherwise(more)).alias("to"))
    dealt = dealt.select("to.part", "to.ahead", "key", "text").repartition(parts, "part")
    ordered = dealt.sortWithinPartitions("part", "ahead", F.col("key").asc_nulls_first(), "text")
    schema = f"key {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.mapInArrow(_print_rows, schema).withColumnRenamed("key", doc_id)
