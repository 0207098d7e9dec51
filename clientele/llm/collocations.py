"""Phrase collocations: frequent n-grams by mergeable Misra-Gries summaries, counted exactly in a second pass.

Texts are cut into blocks of words, each with a dictionary of its own words. A block counts its n-grams by hash and sends
one summary per hash part. A part merges the summaries that reach it with more counters than its mass divided by the
threshold: whatever is as frequent as the threshold keeps a counter, and the largest possible error is known. Hashes that
may be frequent go back to the blocks that have them, which count those phrases as texts; a part sums the texts' counts.
Nothing but these sums decides, so hashes that meet cost work and never change a result. The number of parts grows with
the number of words, so neither a block nor a part grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clientele.llm.shared import partitions_for, stored
from clientele.llm.terms import byte_class, packed, terms, unpacked
from clientele.llm.words import U64, mixed, slices

THRESHOLD, LONGEST = 30, 4
BLOCK_WORDS = 1 << 20
# N-grams of a part on average, so that its counters (mass / threshold) fit a task at any size; parts at least.
PART_MASS, PARTS = 1 << 24, 64
HASH_BITS = 36  # of a hash within its part: few enough to pack well, so many that hashes seldom meet
CUTS = b".,;:!?\n\x0b\x0c\r"
WORD = byte_class(lambda b: b not in b" \t" + CUTS)
CUT = byte_class(lambda b: b in CUTS)
NO_LANG = "und"


# ---- blocks of words

def _block_rows(batches: Iterator[pa.RecordBatch], block_words: int) -> Iterator[pa.RecordBatch]:
    """(block, langs, starts, mass, body): words as places in the block's own dictionary, and where a piece begins.

    A block ends with up to three further words of its last piece, so that phrases are whole wherever texts are cut.
    """
    task, number = TaskContext.get().partitionId(), 0
    waiting: list[tuple] = []

    def block(words, fresh, lang, langs, starts) -> pa.RecordBatch:
        nonlocal number
        found = words.dictionary_encode()
        ids = found.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        piece = np.cumsum(fresh)
        mass = sum(int((piece[n : starts + n] == piece[: len(piece) - n][:starts]).sum()) for n in range(min(LONGEST, len(ids))))
        names, langs_at = np.unique(lang, return_inverse=True)
        own = [langs[i] for i in names.tolist()]
        counts = np.bincount(langs_at[:starts], minlength=len(own))
        body = packed(pa.RecordBatch.from_arrays([pa.array(ids), pa.array(fresh), pa.array(langs_at.astype(np.int32))], ["id", "fresh", "lang"]))
        vocabulary = packed(pa.RecordBatch.from_arrays([found.dictionary.cast(pa.large_binary())], ["word"]))
        number += 1
        counted = pa.array([[{"lang": n, "n": c} for n, c in zip(own, counts.tolist())]], pa.list_(pa.struct([("lang", pa.string()), ("n", pa.int64())])))
        return pa.RecordBatch.from_arrays(
            [pa.array([(task << 32) + number]), counted, pa.array([starts]), pa.array([mass]), pa.array([body], pa.binary()), pa.array([vocabulary], pa.binary())],
            BLOCK_NAMES,
        )

    def cut(last: bool) -> Iterator[pa.RecordBatch]:
        words = pa.concat_arrays([w for w, *_ in waiting])
        fresh = np.concatenate([f for _, f, _ in waiting])
        langs, lang = [], []
        for _, _, own in waiting:
            names, at = own
            lang.append(at + len(langs))
            langs += names
        lang = np.concatenate(lang)
        # Equal languages of several slices become one.
        name, place = np.unique(np.array(langs, dtype=object).astype(str), return_inverse=True) if langs else (np.empty(0, str), lang)
        lang, langs = (place[lang] if langs else lang), name.tolist()
        begin = 0
        while len(words) - begin >= block_words + LONGEST - 1 or (last and begin < len(words)):
            end = min(begin + block_words, len(words))
            more = min(end + LONGEST - 1, len(words))
            own = fresh[begin:more].copy()
            own[0] = True
            yield block(words.slice(begin, more - begin), own, lang[begin:more], langs, end - begin)
            begin = end
        waiting.clear()
        if begin < len(words):
            waiting.append((words.slice(begin), fresh[begin:], (langs, lang[begin:])))

    for batch, data, offsets in slices(batches):
        if not len(data):
            continue
        found, start, row = terms(data, offsets, WORD)
        if not len(start):
            continue
        # A piece begins at a row's first word, and behind a cut.
        cuts = np.concatenate([[0], np.cumsum(CUT[data])])[start]
        fresh = np.ones(len(start), dtype=bool)
        fresh[1:] = (row[1:] != row[:-1]) | (cuts[1:] != cuts[:-1])
        lang = batch.column(0).dictionary_encode()
        waiting.append((found, fresh, (lang.dictionary.to_pylist(), lang.indices.to_numpy(zero_copy_only=False)[row])))
        if sum(len(w) for w, *_ in waiting) >= block_words + LONGEST - 1:
            yield from cut(False)
    if waiting:
        yield from cut(True)


BLOCK_NAMES = ["block", "langs", "starts", "mass", "body", "vocabulary"]
BLOCK_TYPE = "block long, langs array<struct<lang:string,n:long>>, starts long, mass long, body binary, vocabulary binary"


class Block:
    """Words of a block and the hashes of its n-grams."""

    def __init__(self, body: bytes, vocabulary: bytes, langs: list[str], starts: int) -> None:
        rows = unpacked(body)
        self.ids, self.lang = (rows.column(i).to_numpy() for i in (0, 2))
        self.piece = np.cumsum(rows.column(1).to_numpy(zero_copy_only=False), dtype=np.int64)
        self.words, self.langs, self.starts = unpacked(vocabulary).column(0), langs, starts
        own = np.array([xxhash.xxh64_intdigest(w, 1) for w in self.words.to_pylist()], dtype=U64)
        spoken = np.array([xxhash.xxh64_intdigest(n.encode(), 2) for n in langs], dtype=U64)
        self.word_hash, self.lang_hash = own[self.ids], spoken[self.lang]

    def grams(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(size, first words, hashes) of all phrases of 1 to four words that begin in the block."""
        total = self.lang_hash.copy()
        for size in range(1, min(LONGEST, len(self.ids)) + 1):
            n = min(self.starts, len(self.ids) - size + 1)
            total = total[:n] * U64(0x9E3779B97F4A7C15) + self.word_hash[size - 1 : size - 1 + n]
            at = np.flatnonzero(self.piece[:n] == self.piece[size - 1 : size - 1 + n])
            yield size, at, mixed(total[at] + U64(size))


def part_and_rest(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Part of a hash, and the bits that tell hashes of a part apart."""
    upper = hashes >> U64(64 - HASH_BITS)
    return ((hashes & U64((1 << 20) - 1)) * U64(parts) >> U64(20)).astype(np.int64) if parts < 1 << 20 else (hashes % U64(parts)).astype(np.int64), upper.astype(np.int64)


# ---- Misra-Gries summaries

def squeezed(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct values and the sums of their counts."""
    order = np.argsort(values, kind="stable")
    values = values[order]
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.empty(0, np.int64)
    return values[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


class Summary:
    """Misra-Gries summary: no count is too large, none is too small by more than ``error`` <= mass / (capacity + 1)."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.error = capacity, 0
        self.values, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, values: np.ndarray, counts: np.ndarray) -> None:
        """Take in another summary; they are merged when as many counters as the capacity have come in."""
        self.waiting.append((values, counts))
        self.size += len(values)
        if self.size >= self.capacity:
            self.merge()

    def merge(self) -> None:
        values = np.concatenate([self.values, *[v for v, _ in self.waiting]])
        counts = np.concatenate([self.counts, *[c for _, c in self.waiting]])
        self.waiting, self.size = [], 0
        values, counts = squeezed(values, counts)
        if len(values) > self.capacity:
            # Subtract the largest count that has no room: it is taken from capacity + 1 counters at once.
            place = len(counts) - self.capacity - 1
            cut = int(np.partition(counts, place)[place])
            keep = counts > cut
            values, counts = values[keep], counts[keep] - cut
            self.error += cut
        self.values, self.counts = values, counts


def _coded(values: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending values as byte planes of their steps, and counts; a compressed binary."""
    steps = np.diff(values, prepend=0).astype(np.uint64)
    planes = steps.view(np.uint8).reshape(-1, 8).T.copy()
    wide = int(counts.max(initial=0))
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if wide <= np.iinfo(k).max)
    own = [pa.array(p) for p in planes if p.any()]
    return packed(pa.RecordBatch.from_arrays([pa.array(counts.astype(kind)), *own], ["n", *[str(i) for i, p in enumerate(planes) if p.any()]]))


def _decoded(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    batch = unpacked(blob)
    steps = np.zeros((batch.num_rows, 8), dtype=np.uint8)
    for name in batch.schema.names[1:]:
        steps[:, int(name)] = batch.column(name).to_numpy()
    return np.cumsum(steps.view(np.uint64).ravel().astype(np.int64)), batch.column(0).to_numpy().astype(np.int64)


def _summary_rows(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """(part, block, mass, blob): a block's counts of the hashes of each part."""
    for batch in batches:
        for r in batch.to_pylist():
            block = Block(r["body"], r["vocabulary"], [x["lang"] for x in r["langs"]], r["starts"])
            part, rest = part_and_rest(np.concatenate([np.empty(0, U64), *[h for _, _, h in block.grams()]]), parts)
            shift = max(parts - 1, 1).bit_length()
            if shift + HASH_BITS < 64:
                key = np.sort((part << HASH_BITS) | rest)
                part, rest = key >> HASH_BITS, key & ((1 << HASH_BITS) - 1)
            else:
                order = np.lexsort((rest, part))
                part, rest = part[order], rest[order]
            first = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (rest[1:] != rest[:-1])])
            counts = np.diff(np.r_[first, len(rest)])
            part, rest = part[first], rest[first]
            cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            ends = np.r_[cuts[1:], len(part)]
            blobs = [_coded(rest[a:b], counts[a:b]) for a, b in zip(cuts.tolist(), ends.tolist())]
            mass = np.add.reduceat(counts, cuts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[cuts]), pa.array(np.full(len(cuts), r["block"])), pa.array(mass), pa.array(blobs, pa.binary())], ["part", "block", "mass", "blob"]
            )


def heavy(blobs: list[bytes]) -> np.ndarray:
    """Values that make up a thousandth or more of a block's summary: counted apart, so that they ask for no counters."""
    found = [np.empty(0, np.int64)]
    for blob in blobs:
        values, counts = _decoded(blob)
        found.append(values[(counts > 1) & (counts * 1000 >= counts.sum())])
    return np.unique(np.concatenate(found))


def merged(blobs: list[bytes], threshold: int) -> np.ndarray:
    """Ascending values of the summaries that may be as frequent as the threshold; every value that is, is there."""
    apart = heavy(blobs)
    known, mass = np.zeros(len(apart), dtype=np.int64), 0
    decoded = lambda: (_decoded(b) for b in blobs)
    for values, counts in decoded():
        at = np.searchsorted(apart, values)
        hit = (at < len(apart)) & (apart[np.minimum(at, max(len(apart) - 1, 0))] == values) if len(apart) else np.zeros(len(values), bool)
        known[at[hit]] += counts[hit]
        mass += int(counts[~hit].sum())
    summary = Summary(mass // threshold + 1)
    for values, counts in decoded():
        hit = np.isin(values, apart, assume_unique=True)
        summary.add(values[~hit], counts[~hit])
    summary.merge()
    return np.sort(np.concatenate([apart[known >= threshold], summary.values[summary.counts + summary.error >= threshold]]))


def _survivor_rows(table: pa.Table, threshold: int) -> pa.Table:
    """(block, part, blob) of one part: which hashes of each block's summary may be frequent."""
    blobs, blocks = table.column("blob").to_pylist(), table.column("block")
    alive = merged(blobs, threshold)
    part = table.column("part")[0].as_py()
    out, keep = [], []
    for i, blob in enumerate(blobs):
        values, _ = _decoded(blob)
        own = values[np.isin(values, alive, assume_unique=True)]
        if len(own):
            out.append(_coded(own, np.zeros(len(own), dtype=np.int64)))
            keep.append(i)
    return pa.table({"block": blocks.take(pa.array(keep, pa.int64())).combine_chunks(), "part": pa.array([part] * len(out), pa.int64()), "blob": pa.array(out, pa.binary())})


# ---- exact counts

def _phrase_rows(blocks: pa.Table, alive: pa.Table, parts: int) -> pa.Table:
    """(part, blob) of one block: texts and exact counts of the phrases whose hash is alive."""
    none = pa.table({"part": pa.array([], pa.int64()), "blob": pa.array([], pa.binary())})
    if not blocks.num_rows or not alive.num_rows:
        return none
    r = blocks.slice(0, 1).to_pylist()[0]
    block = Block(r["body"], r["vocabulary"], [x["lang"] for x in r["langs"]], r["starts"])
    values = [(p << HASH_BITS) | _decoded(b)[0] for p, b in zip(alive.column("part").to_pylist(), alive.column("blob").to_pylist())]
    wanted = np.sort(np.concatenate(values))
    slots = np.zeros(1 << 24, dtype=bool)
    slots[wanted & 0xFFFFFF] = True
    found = []
    for size, at, hashes in block.grams():
        part, rest = part_and_rest(hashes, parts)
        maybe = np.flatnonzero(slots[((part << HASH_BITS) | rest) & 0xFFFFFF])
        key = (part[maybe] << HASH_BITS) | rest[maybe]
        place = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
        maybe = maybe[wanted[place] == key]
        at, hashes, part = at[maybe], hashes[maybe], part[maybe]
        if not len(at):
            continue
        _, first, place, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        words = np.stack([block.ids[at + i] for i in range(size)] + [block.lang[at]])
        if (words != words[:, first[place]]).any():  # two phrases of one hash
            _, first, counts = np.unique(words, axis=1, return_index=True, return_counts=True)
        own = at[first]
        text = [block.words.take(pa.array(block.ids[own + i])) for i in range(size)]
        phrase = pc.binary_join_element_wise(*text, pa.scalar(b" ", pa.large_binary())) if size > 1 else text[0]
        lang = pa.array(block.langs, pa.string()).take(pa.array(block.lang[own]))
        found.append((part[first], lang, phrase, np.full(len(own), size), counts))
    if not found:
        return none
    part = np.concatenate([f[0] for f in found])
    order = np.argsort(part, kind="stable")
    rows = pa.RecordBatch.from_arrays(
        [pa.concat_arrays([f[1] for f in found]), pa.concat_arrays([f[2] for f in found]),
         pa.array(np.concatenate([f[3] for f in found]).astype(np.int8)), pa.array(np.concatenate([f[4] for f in found]))],
        ["lang", "phrase", "size", "f"],
    ).take(pa.array(order))
    part = part[order]
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    ends = np.r_[cuts[1:], len(part)]
    blobs = [packed(rows.slice(a, b - a)) for a, b in zip(cuts.tolist(), ends.tolist())]
    return pa.table({"part": pa.array(part[cuts]), "blob": pa.array(blobs, pa.binary())})


def _count_rows(table: pa.Table, threshold: int) -> pa.Table:
    """(lang, phrase, size, f) of one part: sums over all blocks that reach the threshold."""
    rows = pa.Table.from_batches([unpacked(b) for b in table.column("blob").to_pylist()])
    total = rows.group_by(["lang", "phrase", "size"]).aggregate([("f", "sum")])
    total = total.filter(pc.greater_equal(total.column("f_sum"), threshold))
    return pa.table(
        {"lang": total.column("lang").combine_chunks(), "phrase": total.column("phrase").cast(pa.binary()).cast(pa.string()).combine_chunks(),
         "size": total.column("size").cast(pa.int32()).combine_chunks(), "f": total.column("f_sum").combine_chunks()}
    )


def word_blocks(docs: DataFrame, text: str, lang: str, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Stored blocks of all words of a table."""
    body = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return stored(body.mapInArrow(lambda b: _block_rows(b, block_words), BLOCK_TYPE))


def frequent_phrases(blocks: DataFrame, threshold: int = THRESHOLD, part_mass: int = PART_MASS) -> DataFrame:
    """Stored (lang, phrase, size, f): every phrase of one to four words within a piece that occurs ``threshold`` times
    or more in its language, and its exact number of occurrences."""
    spark = blocks.sparkSession
    mass = blocks.agg(F.sum("mass")).first()[0] or 0
    parts = max(PARTS, -(-mass // part_mass))
    many = partitions_for(spark, parts, 2)
    sent = blocks.mapInArrow(lambda b: _summary_rows(b, parts), "part long, block long, mass long, blob binary").repartition(many, "part")
    alive = stored(sent.groupBy("part").applyInArrow(lambda t: _survivor_rows(t, threshold), "block long, part long, blob binary"))
    counted = blocks.groupBy("block").cogroup(alive.groupBy("block")).applyInArrow(
        lambda b, a: _phrase_rows(b, a, parts), "part long, blob binary"
    )
    summed = counted.repartition(many, "part").groupBy("part").applyInArrow(lambda t: _count_rows(t, threshold), "lang string, phrase string, size int, f long")
    return stored(summed)


def collocations(
    docs: DataFrame, limit: int | None = 2000, text: str = "text", lang: str = "lang", threshold: int = THRESHOLD, cover: int = 80,
    block_words: int = BLOCK_WORDS, part_mass: int = PART_MASS,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the phrases of two to four words that hold together best, per language.

    Words are runs of anything but blanks, tabs and the marks ``. , ; : ! ?`` and line breaks, A-Z in lower case; a
    phrase never crosses a mark or line break. ``a`` counts its occurrences (``threshold`` at least), ``n`` all words of
    the language. Of the cuts of a phrase into two parts with ``l`` and ``r`` occurrences the one with the lowest score
    floor(2000000 a / (l + r)) counts, ties go to the shorter first part. Phrases inside a longer frequent one that has
    ``cover`` percent of their occurrences or more are left out. Best first: score, a, phrase. ``limit`` None keeps all.

    A null language is ``und``; null and empty texts have no words; repeated rows count as often as they stand there.
    Other columns are ignored.
    """
    blocks = word_blocks(docs, text, lang, block_words)
    totals = blocks.select(F.explode("langs").alias("x")).groupBy("x.lang").agg(F.sum("x.n").alias("n"))
    counts = frequent_phrases(blocks, threshold, part_mass)
    words = F.split("phrase", " ", -1)
    longer = counts.filter("size > 1")
    cuts = longer.select("lang", "phrase", F.col("f").alias("a"), "size", words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest"),
    )
    part = counts.select("lang", F.col("phrase").alias("part"), "f")
    cuts = cuts.join(part.select(F.col("lang"), F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(part.select(F.col("lang"), F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    exact = "CAST(CAST(a AS DECIMAL(20,0)) * CAST(2000000 AS DECIMAL(7,0)) AS DECIMAL(38,0)) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))"
    scored = cuts.withColumn("score", F.expr(exact).cast("long"))
    least = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("x"))
    inner = longer.filter("size > 2").select("lang", "f", "size", words.alias("w"), F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"))
    inner = inner.select("lang", "f", "w", "m", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("at"))
    inner = inner.select("lang", "f", F.array_join(F.slice("w", F.col("at"), F.col("m")), " ").alias("phrase"))
    over = inner.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    kept = least.join(over, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (100 * F.col("most") < cover * F.col("x.a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.select("lang", "phrase", "x.*").withColumn("rank", F.row_number().over(order).cast("long"))
    ranked = ranked if limit is None else ranked.filter(F.col("rank") <= limit)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
