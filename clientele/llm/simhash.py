"""SimHash near copies by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments. The perfect [23, 12, 7] Golay code maps each segment, and each of its
one-bit neighbours, to the nearest codeword: one or six codeword indices per segment, of which two segments within two
bits of each other share at least one (a common midpoint decodes to it). Two fingerprints within two bits have a segment
without any error and two with at most two errors, so they share the key (exact segment, codeword index of the next
segment) for some segment. Fingerprints are joined on these keys and verified bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.llm.columns import with_text_value
from clientele.llm.components import connected
from clientele.llm.shared import stored
from clientele.llm.words import slices

SEED, SHINGLE, REACH = 42, 3, 2
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # (lowest bit, bits)
GENERATOR = 0b110001110101  # of the Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
# Buckets of up to this many fingerprints are compared pair by pair; larger ones by midpoints, in linear time.
PAIRWISE = 32


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit majority of the XXH64 hashes of all word shingles; zero without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    size = min(shingle, len(words))
    body = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - size + 1].tolist()
    pieces = [body[s:e] for s, e in zip(starts, (ends[size - 1 :] - 1).tolist())]
    hashes = np.array(list(map(xxhash.xxh64_intdigest, pieces, repeat(SEED))), dtype=">u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int("".join("1" if 2 * c > len(hashes) else "0" for c in counts.tolist()), 2)


def _fingerprint_rows(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch, _, _ in slices(batches):
        marks = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks.view(np.int64))], ["id", "mark"])


@lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """(syndrome of the upper 12 bits, error pattern of each syndrome)."""

    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    upper = np.array([remainder(x << 11) for x in range(1 << 12)], dtype=np.int64)
    errors = np.zeros(1 << 11, dtype=np.int64)
    for weight in (1, 2, 3):
        for bits in combinations(range(23), weight):
            pattern = sum(1 << b for b in bits)
            errors[remainder(pattern)] = pattern
    return upper, errors


def codeword_index(words: np.ndarray) -> np.ndarray:
    """Index (upper 12 bits) of the codeword nearest to each 23-bit word."""
    upper, errors = _golay()
    syndrome = upper[words >> 11] ^ (words & 0x7FF)
    return (words ^ errors[syndrome]) >> 11


def fuzzy_indices(words: np.ndarray, bits: int) -> np.ndarray:
    """(words x (bits + 1)) codeword indices of each word and its one-bit neighbours."""
    flips = np.array([0] + [1 << b for b in range(bits)], dtype=np.int64)
    return codeword_index(words[:, None] ^ flips[None, :])


def fuzzy_keys(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of the fingerprint, key), each pair once."""
    segments = [((marks >> np.uint64(low)) & np.uint64((1 << bits) - 1)).astype(np.int64) for low, bits in SEGMENTS]
    at, keys = [], []
    for i, exact in enumerate(segments):
        j = (i + 1) % len(SEGMENTS)
        indices = np.sort(fuzzy_indices(segments[j], SEGMENTS[j][1]), axis=1)
        new = np.ones(indices.shape, dtype=bool)
        new[:, 1:] = indices[:, 1:] != indices[:, :-1]
        row, column = np.nonzero(new)
        at.append(row)
        keys.append((i << 40) | (exact[row] << 12) | indices[row, column])
    return np.concatenate(at), np.concatenate(keys)


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = batch.column(0).to_numpy(zero_copy_only=False)
        at, keys = fuzzy_keys(marks.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(marks[at]), pa.array(keys)], ["mark", "key"])


def near_pairs(marks: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column ``mark``) within two bits; every link stays connected.

    Buckets of up to ``PAIRWISE`` fingerprints yield their verified pairs. In a larger bucket every fingerprint is tied
    to the smallest one that has a one-bit midpoint in common with it: two fingerprints within two bits always share a
    midpoint, and all that share one are within two bits, so the same components come out of at most 65 rows each.
    """
    keyed = stored(marks.select("mark").mapInArrow(_key_rows, "mark long, key long"))
    sizes = stored(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    members = keyed.join(sizes.filter(F.col("n") <= PAIRWISE), "key").groupBy("key").agg(F.collect_list("mark").alias("marks"))
    pairs = members.select("marks", F.explode("marks").alias("a")).select("a", F.explode("marks").alias("b"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= REACH
    pairs = pairs.filter((F.col("a") < F.col("b")) & close)
    crowd = stored(keyed.join(sizes.filter(F.col("n") > PAIRWISE), "key").select("mark").distinct())
    bits = F.array(F.lit(0).cast("long"), *[F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(i)) for i in range(64)])
    middles = stored(crowd.select("mark", F.explode(F.transform(bits, lambda b: F.col("mark").bitwiseXOR(b))).alias("middle")))
    heads = stored(middles.groupBy("middle").agg(F.min("mark").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    stars = middles.join(heads, "middle").filter("mark <> a").select("a", F.col("mark").alias("b"))
    return pairs.unionByName(stars).distinct()


def simhash_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(``doc_id``, mark) for every row; null and empty texts have fingerprint zero."""
    kind = dict(docs.dtypes)[doc_id]
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(lambda b: _fingerprint_rows(b, shingle), f"id {kind}, mark long").withColumnRenamed("id", doc_id)


def mark_components(marks: DataFrame) -> DataFrame:
    """(mark, root) for every distinct fingerprint; root names its component."""
    distinct = stored(marks.select("mark").distinct())
    roots = connected(near_pairs(distinct))
    return distinct.join(roots, distinct["mark"] == roots["node"], "left").select("mark", F.coalesce("root", "mark").alias("root"))


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id``, mark, component_id (smallest id reachable by links of at most two bits) for every row.

    Equal fingerprints are one node, so copies never meet in pairs. A null id has a component like any other; the
    component's id is its smallest id that is not null. Other columns are ignored.
    """
    table = stored(simhash_table(docs, doc_id, text, shingle).withColumnRenamed(doc_id, "id"))
    roots = stored(mark_components(table))
    least = table.groupBy("mark").agg(F.min("id").alias("least"))
    named = roots.join(least, "mark")
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = stored(roots.join(smallest, "root").select("mark", "component_id"))
    return table.join(labels, "mark").select(F.col("id").alias(doc_id), "mark", "component_id")


def with_fingerprint(docs: DataFrame, text: str, name: str, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with the fingerprint of every row, for marking rows in place."""

    def marks(texts: list) -> np.ndarray:
        return np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64)

    return with_text_value(docs, text, name, "long", marks)
