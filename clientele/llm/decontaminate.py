"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item gives windows of consecutive words, a window is the set of its word shingles, and a document contains a
window only if it contains all of them. For full containment the necessary prefix is one token: the rarest shingle by
corpus frequency. Only documents' occurrences of such prefix tokens are joined; position and length bounds discard those
whose window would stick out of the document, and the words themselves are compared before a window counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clientele.llm.shared import stored
from clientele.llm.words import U64, WordTable, slices

WINDOW, SHINGLE = 13, 5
# A token filter of fixed size, whatever the benchmark's: 2^26 bits as at most 2^20 words of 64 bits.
FILTER_WORDS = 1 << 20


def _window_rows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in slices(batches):
        table = WordTable(data, offsets)
        items, body = batch.column(0).to_pylist(), table.data.tobytes()
        ids, texts, sizes = [], [], []
        for row in range(table.rows):
            a, b = table.first[row], table.first[row + 1]
            words = [body[s:e].decode() for s, e in zip(table.start[a:b], table.end[a:b])]
            size = min(window, len(words))
            for i in range(len(words) - size + 1 if size else 0):
                ids.append(items[row])
                texts.append(" ".join(words[i : i + size]))
                sizes.append(size)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string()), pa.array(sizes, pa.int32())], ["item", "text", "size"])


def item_windows(items: DataFrame, item_id: str, text: str, window: int = WINDOW) -> DataFrame:
    """(item, text, size): every run of ``window`` words of an item, or all its words if it has fewer; none for none."""
    rows = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text"))
    return rows.mapInArrow(lambda b: _window_rows(b, window), "item string, text string, size int").distinct()


def _shingle_rows(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in slices(batches):
        table = WordTable(data, offsets)
        counts = np.diff(table.first)
        out = []
        for size in np.unique(np.minimum(counts[counts > 0], shingle)).tolist():
            hashes, whole = table.shingle_hash(size), table.whole(size)
            row = table.row[: len(hashes)]
            keep = np.flatnonzero(whole & (np.minimum(counts[row], shingle) == size))
            out.append((row[keep], hashes[keep], keep - table.first[row[keep]], np.full(len(keep), size)))
        if out:
            row, hashes, at, size = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(hashes.view(np.int64)), pa.array(at.astype(np.int32)), pa.array(size.astype(np.int32))],
                ["text", "token", "offset", "length"],
            )


def token_filter(tokens: DataFrame) -> np.ndarray:
    """Bitmap of the ``token`` column: no token is missed, and its size does not depend on their number."""
    slot = F.pmod("token", F.lit(FILTER_WORDS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright("token", 32), F.lit(64)).cast("int"))
    rows = tokens.groupBy(slot.alias("slot")).agg(F.bit_or(bit).alias("bits")).toArrow()  # at most FILTER_WORDS rows
    found = np.zeros(FILTER_WORDS, dtype=np.int64)
    found[rows.column("slot").to_numpy()] = rows.column("bits").to_numpy()
    return found.view(U64)


def _passes(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    signed = hashes.view(np.int64)
    shift = ((signed >> 32) % 64).astype(U64)
    return ((bits[signed % FILTER_WORDS] >> shift) & U64(1)).astype(bool)


def suspected(spark: SparkSession, tokens: DataFrame):
    """A function of a long column: false only where the value is not among ``tokens``."""
    bits = spark.sparkContext.broadcast(token_filter(tokens))

    @F.pandas_udf("boolean")
    def suspect(values: pd.Series) -> pd.Series:
        return pd.Series(_passes(values.to_numpy(dtype=np.int64), bits.value), dtype=bool)

    return suspect


def _frequency_rows(batches: Iterator[pa.RecordBatch], bits, lengths: list[int]) -> Iterator[pa.RecordBatch]:
    for _, data, offsets in slices(batches):
        table = WordTable(data, offsets)
        found = [np.empty(0, U64)]
        for size in lengths:
            hashes = table.shingle_hash(size)
            found.append(hashes[table.whole(size) & _passes(hashes, bits.value)])
        tokens, counts = np.unique(np.concatenate(found), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(counts.astype(np.int64))], ["token", "n"])


CANDIDATES = pa.list_(pa.struct([("token", pa.int64()), ("at", pa.int32()), ("left", pa.int32()), ("around", pa.string())]))


def _document_rows(batches: Iterator[pa.RecordBatch], bits, lengths: list[int], window: int) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in slices(batches):
        table = WordTable(data, offsets)
        body, counts = table.data.tobytes(), np.diff(table.first)
        found: list[list[dict]] = [[] for _ in range(table.rows)]
        for size in lengths:
            hashes = table.shingle_hash(size)
            for i in np.flatnonzero(table.whole(size) & _passes(hashes, bits.value)).tolist():
                row = int(table.row[i])
                a, b = max(int(table.first[row]), i - window + 1), min(int(table.first[row + 1]), i + window)
                words = " ".join(body[s:e].decode() for s, e in zip(table.start[a:b].tolist(), table.end[a:b].tolist()))
                found[row].append({"token": int(hashes[i].view(np.int64)), "at": i - int(table.first[row]), "left": i - a, "around": words})
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts.astype(np.int64)), pa.array(found, CANDIDATES)], ["id", "n_words", "candidates"]
        )


def find_contamination(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE,
) -> DataFrame:
    """``doc_id``, n_words, n_hit, n_items, item_ids (ascending as strings), hits for every row of ``docs``.

    Words are runs of ASCII letters (in lower case), digits and characters beyond ASCII. ``hits`` lists the covered
    runs of words as (first, last + 1). Null and empty texts have no words and no hits; an empty benchmark hits
    nothing; rows with one id stay apart; a null id is kept. Other columns are ignored.
    """
    spark = docs.sparkSession
    windows = stored(item_windows(items, item_id, item_text, window))
    texts = stored(windows.select("text", "size").distinct())
    tokens = stored(texts.select("text").mapInArrow(lambda b: _shingle_rows(b, shingle), "text string, token long, offset int, length int"))
    lengths = sorted(r["length"] for r in tokens.select("length").distinct().collect())  # at most ``shingle`` values
    body = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))

    # Rarity: how often each benchmark shingle occurs in all documents.
    bits = spark.sparkContext.broadcast(token_filter(tokens))
    counted = body.select("text").mapInArrow(lambda b: _frequency_rows(b, bits, lengths), "token long, n long")
    frequency = counted.groupBy("token").agg(F.sum("n").alias("n"))
    ranked = tokens.join(frequency, "token", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    rarest = ranked.groupBy("text").agg(F.min(F.struct("n", "token", "offset")).alias("first"))
    prefixes = stored(
        rarest.join(texts, "text").filter("first.n > 0").select(
            "text", "size", F.col("first.token").alias("token"), F.col("first.offset").alias("offset")
        )
    )
    lead = spark.sparkContext.broadcast(token_filter(prefixes))
    schema = "id {}, n_words long, candidates array<struct<token:long,at:int,left:int,around:string>>".format(dict(docs.dtypes)[doc_id])
    table = body.mapInArrow(lambda b: _document_rows(b, lead, lengths, window), schema)
    table = stored(table.withColumn("row", F.monotonically_increasing_id()))

    occurrences = table.select("row", "n_words", F.explode("candidates").alias("c")).select("row", "n_words", "c.*")
    first = F.col("at") - F.col("offset")
    own = F.slice(F.split("around", " "), F.greatest(F.col("left") - F.col("offset"), F.lit(0)) + 1, F.col("size"))
    matches = stored(
        occurrences.join(prefixes, "token")
        .filter((F.col("left") >= F.col("offset")) & (first >= 0) & (first + F.col("size") <= F.col("n_words")))
        .filter(F.array_join(own, " ") == F.col("text"))
        .select("row", first.cast("long").alias("first"), (first + F.col("size")).cast("long").alias("past"), "text")
    )
    # A row's matches are at most its words times the two window lengths that can start there: bounded by the text.
    reach = Window.partitionBy("row").orderBy("first", "past")
    before = F.coalesce(F.max("past").over(reach.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1).cast("long"))
    runs = matches.select("row", "first", "past").distinct().withColumn("before", before)
    runs = runs.withColumn("run", F.sum((F.col("first") > F.col("before")).cast("int")).over(reach))
    runs = runs.groupBy("row", "run").agg(F.min("first").alias("first"), F.max("past").alias("past"))
    covered = runs.groupBy("row").agg(
        F.sum(F.col("past") - F.col("first")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("first", "past"))).alias("hits")
    )
    named = matches.select("row", "text").distinct().join(windows.select("item", "text"), "text").groupBy("row").agg(
        F.sort_array(F.collect_set("item")).alias("item_ids")
    )
    full = table.select("row", "id", "n_words").join(covered, "row", "left").join(named, "row", "left")
    none = F.array().cast("array<string>")
    return full.select(
        F.col("id").alias(doc_id), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("item_ids", none).alias("item_ids"), "hits",
    )


def is_contaminated() -> "F.Column":
    """A hit, and hit words make up a twentieth of the document or more."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
