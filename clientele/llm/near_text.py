"""Near copies by shingle similarity: an exact prefix- and length-filtered set join.

All shingles are put in one order, rare ones first. Two sets with a similarity of t have a common shingle among the
first n - ceil(t n) + 1 of each (their prefixes), so sets are joined on the shingles of their prefixes only, and no pair
at or above t is missed, whatever the order. The common shingles of two prefixes are counted: those, and all that stands
behind the prefix that ends first, bound what the sets can have in common. Pairs that the bound lets through are compared
by their whole sets. Equal sets are one node.

Sets that share a crowded shingle mostly share all but their edits: prefixes say nothing about them. They are joined on
how they differ from one of them instead (``crowd_pairs``), which misses no pair either.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.llm.components import connected
from clientele.llm.decontaminate import _passes, token_filter
from clientele.llm.shared import Scratch, stored
from clientele.llm.words import U64, WordTable, mixed, slices

# Frequencies that order the shingles are counted per slot. They decide how much is compared, never what comes out.
SLOTS, CHUNK = 1 << 22, 1 << 14
SLACK = 1e-9  # of products with the similarity
# Rows of a shingle above the first are tied to drawn heads, above the second joined on what tells them from a head, and
# rows of one head or difference above the third are spread over several join keys.
CROWD, CROWDED, SALTED = 32, 256, 1024


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], list[int]]]:
    """Per slice its rows, their shingle sets (ascending) and the sets' names. A text of fewer words is one shingle."""
    for part, data, offsets in slices(batches):
        table = WordTable(data, offsets)
        sets, names = [], []
        for i in range(table.rows):
            words = table.hash[table.first[i] : table.first[i + 1]]
            n, span = max(len(words) - size + 1, 1), min(size, len(words))
            total = np.zeros(n if span else 0, dtype=U64)
            for j in range(span):
                total = total * U64(31) + words[j : j + n]
            found = np.unique(mixed(total).view(np.int64))
            sets.append(found)
            name = np.sum(mixed(found.view(U64) + U64(0x9E3779B97F4A7C15)), dtype=U64) + U64(len(found))
            names.append(int(mixed(np.array([name], dtype=U64)).view(np.int64)[0]))
        yield part, sets, names


def _scan_rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """A row (node, name of its set) per text; at the end of a task its shingle counts as (chunk, blob) rows."""
    counts = np.zeros(SLOTS, dtype=np.int32)
    for part, sets, names in _sets(batches, size):
        np.add.at(counts, np.concatenate(sets) % SLOTS, 1)
        nothing = pa.nulls(len(names), pa.binary())
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.int64()), pa.nulls(len(names), pa.int32()), nothing], ["node", "name", "chunk", "blob"])
    for chunk, blob in _count_blobs(counts):
        none = pa.nulls(1, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.array([chunk], pa.int32()), pa.array([blob], pa.binary())], ["node", "name", "chunk", "blob"])


def _count_blobs(counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    for chunk, own in enumerate(counts.reshape(-1, CHUNK)):
        if own.any():
            yield chunk, pa.compress(own.tobytes(), codec="zstd", asbytes=True)


def _sum_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = np.frombuffer(pa.decompress(blob, decompressed_size=4 * CHUNK, codec="zstd", asbytes=True), np.int32)
            sums[chunk] = sums.get(chunk, 0) + own.astype(np.int64)
    for chunk, own in sums.items():
        total = np.minimum(own, np.iinfo(np.int32).max).astype(np.int32).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([total], pa.binary())], ["chunk", "blob"])


def slot_counts(rows: DataFrame) -> np.ndarray:
    """Counts per slot; ``SLOTS`` numbers reach the driver, whatever the size of the texts."""
    found = np.zeros(SLOTS, dtype=np.int32).reshape(-1, CHUNK)
    blobs = rows.filter("chunk is not null").select("chunk", "blob").repartition("chunk")
    for r in blobs.mapInArrow(_sum_rows, "chunk int, blob binary").collect():
        found[r["chunk"]] = np.frombuffer(r["blob"], np.int32)
    return found.ravel()


def _prefix_rows(batches: Iterator[pa.RecordBatch], counts, size: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """(tokens, name, n, rest, rank, last) of every set: its prefix, its size, how much of it stands behind the prefix,
    and where the prefix ends in the order."""
    for _, sets, names in _sets(batches, size):
        heads, rows, done = [], [], set()
        for name, own in zip(names, sets):
            if not len(own) or name in done:
                continue
            done.add(name)
            often = counts.value[own % SLOTS]
            length = len(own) - int(np.ceil(similarity * len(own) - SLACK)) + 1
            head = np.lexsort((own, often))[: min(length, len(own))]
            heads.append(own[head])
            rows.append((name, len(own), len(own) - len(head), int(often[head[-1]]), int(own[head[-1]])))
        if rows:
            columns = [pa.array(heads, pa.list_(pa.int64())), *[pa.array(c, pa.int64()) for c in zip(*rows)]]
            yield pa.RecordBatch.from_arrays(columns, PREFIX_NAMES)


def _passing_rows(batches: Iterator[pa.RecordBatch], bits) -> Iterator[pa.RecordBatch]:
    """(token, name) rows of prefix shingles that the filter lets through."""
    for batch in batches:
        owner = np.repeat(np.arange(batch.num_rows), batch.column(0).value_lengths().to_numpy(zero_copy_only=False))
        tokens = batch.column(0).flatten().to_numpy(zero_copy_only=False)
        at = np.flatnonzero(_passes(tokens, bits.value))
        yield pa.RecordBatch.from_arrays([pa.array(tokens[at]), batch.column(1).take(pa.array(owner[at]))], ["token", "name"])


def _set_rows(batches: Iterator[pa.RecordBatch], wanted, size: int) -> Iterator[pa.RecordBatch]:
    for _, sets, names in _sets(batches, size):
        at = np.flatnonzero(_passes(np.array(names, dtype=np.int64), wanted.value)).tolist()
        yield pa.RecordBatch.from_arrays(
            [pa.array([names[i] for i in at], pa.int64()), pa.array([sets[i] for i in at], pa.list_(pa.int64()))], ["name", "shingles"]
        )


PREFIX_NAMES = ["tokens", "name", "n", "rest", "rank", "last"]


def shared_prefixes(texts: DataFrame, labels: DataFrame, counts, shingle: int, similarity: float) -> DataFrame:
    """Stored prefix rows with the label of their set, of shingles that stand in the prefixes of two labels or more."""
    spark, own = texts.sparkSession, "name long, n long, rest long, rank long, last long"
    with Scratch(spark) as scratch:
        made = stored(texts.select("node", "text").mapInArrow(lambda b: _prefix_rows(b, counts, shingle, similarity), f"tokens array<long>, {own}"))
        # All prefix shingles move once, as two numbers, to find those that two sets share; only rows of these move after that.
        with Scratch(spark) as inner:
            rows = made.select(F.explode("tokens").alias("token"), "name")
            several = rows.groupBy("token").agg(F.min("name").alias("low"), F.max("name").alias("high")).filter("low <> high")
            several = inner.keep(stored(several.select("token")))
        bits = spark.sparkContext.broadcast(token_filter(several))
        rows = made.select("tokens", "name").mapInArrow(lambda b: _passing_rows(b, bits), "token long, name long")
        shared = stored(rows.distinct().join(several, "token", "left_semi"))
        bits.unpersist()
        facts = made.select(*PREFIX_NAMES[1:]).distinct()
        return scratch.keep(of_two_labels(stored(shared.join(labels, "name").join(facts, "name"))))


def of_two_labels(rows: DataFrame) -> DataFrame:
    """Stored rows of tokens with two labels or more, and the number of the token's rows."""
    tokens = rows.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("rows"))
    with Scratch(rows.sparkSession) as scratch:
        return scratch.keep(stored(rows.join(stored(tokens.filter("low <> high").select("token", "rows")), "token")))


def star_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of every set of a crowded shingle and the head drawn for that shingle, at most one row per prefix row.

    They only save work: a large group of near copies has one label after them, and what they miss meets in
    ``candidate_pairs``.
    """
    crowd = rows.filter(F.col("rows") > CROWD)
    head = F.min(F.struct(F.xxhash64("name", "token").alias("draw"), "name", "n", "label")).alias("head")
    met = crowd.join(stored(crowd.groupBy("token").agg(head)), "token").filter(F.col("label") != F.col("head.label"))
    met = met.filter(F.least("n", "head.n") + SLACK >= similarity * F.greatest("n", "head.n"))
    return met.select(F.least("name", "head.name").alias("a"), F.greatest("name", "head.name").alias("b")).distinct()


def candidate_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of sets with different labels that can reach the similarity, by what their prefixes have in common.

    Pairs that also share a shingle which ``rows`` leaves out may be missing.
    """
    left, right = [rows.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("name", "n", "rest", "rank", "last", "label")]) for s in "ab"]
    sized = F.least("n_a", "n_b") + SLACK >= similarity * F.greatest("n_a", "n_b")
    met = left.join(right, "token").filter((F.col("name_a") < F.col("name_b")) & (F.col("label_a") != F.col("label_b")) & sized)
    first = F.struct("rank_a", "last_a") <= F.struct(F.col("rank_b").alias("rank_a"), F.col("last_b").alias("last_a"))
    met = met.select(F.col("name_a").alias("a"), F.col("name_b").alias("b"), (F.col("n_a") + F.col("n_b")).alias("both"), F.when(first, F.col("rest_a")).otherwise(F.col("rest_b")).alias("rest"))
    counted = met.groupBy("a", "b", "both", "rest").agg(F.count(F.lit(1)).alias("common"))
    return counted.filter((F.col("common") + F.col("rest")) * (1 + similarity) + SLACK >= similarity * F.col("both")).select("a", "b")


def _dealt(rows: DataFrame, repeated: DataFrame, keys: list[str], sizes: DataFrame) -> DataFrame:
    """The two sides joined on the keys; ``sizes`` has the number of rows of each. Those of a crowded key are dealt over
    several salts on one side (by ``name_a``) and repeated for each of them on the other."""
    salts = sizes.select(*keys, F.ceil(F.col("rows") / SALTED).alias("salts"))
    left = rows.join(salts, keys).withColumn("salt", F.pmod(F.xxhash64("name_a"), "salts")).drop("salts")
    right = repeated.join(salts, keys).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    return left.join(right, [*keys, "salt"]).drop("salt")


def crowd_differences(texts: DataFrame, crowd: DataFrame, shingle: int) -> DataFrame:
    """Stored (head, name, label, n, head_n, tokens): by which shingles sets differ from the heads of their shingles.

    Shingles that mostly the same sets share have the same head, so a set has few of them.
    """
    with Scratch(texts.sparkSession) as scratch:
        heads = crowd.groupBy("token").agg(F.min(F.struct(F.xxhash64("name").alias("draw"), "name")).getField("name").alias("head"))
        members = stored(crowd.join(stored(heads), "token").select("head", "name", "label").distinct())
        sizes = stored(members.groupBy("head").agg(F.count(F.lit(1)).alias("rows")))
        sets = _sets_of(texts, members.select("name").distinct(), shingle)
        own = members.join(sets, "name").select("head", F.col("name").alias("name_a"), "label", F.col("shingles").alias("own"))
        met = _dealt(own, sets.select(F.col("name").alias("head"), F.col("shingles").alias("base")), ["head"], sizes)
        tokens = F.concat(F.array_except("own", "base"), F.array_except("base", "own"))
        found = met.select("head", F.col("name_a").alias("name"), "label", F.size("own").alias("n"), F.size("base").alias("head_n"), tokens.alias("tokens"))
        return scratch.keep(stored(found))


def crowd_pairs(differences: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of sets with different labels and one head that can reach the similarity, and of sets similar to their head.

    Two sets differ by the shingles that only one of them has in its difference from the head, and may differ by
    (1 - t) / (1 + t) of their sizes. Differences are in one order per head, rare shingles first. If two of them have to
    overlap, the first shingle they share is followed by enough others in both. If they need not overlap, both sets are
    similar to the head.
    """
    spread = (1 - similarity) / (1 + similarity)
    with Scratch(differences.sparkSession) as scratch:
        rows = differences.select("head", "name", "label", "n", F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
        often = rows.groupBy("head", "token").agg(F.count(F.lit(1)).alias("often"))
        placed = rows.join(stored(often), ["head", "token"]).groupBy("head", "name", "label", "n", "size")
        placed = placed.agg(F.sort_array(F.collect_list(F.struct("often", "token"))).alias("order"))
        # No partner asks for more of the order than this.
        reach = F.floor(F.col("n") * ((1 - similarity) / similarity) + SLACK).cast("int") + 1
        placed = placed.select("head", "name", "label", "n", "size", F.posexplode(F.slice("order", F.lit(1), reach)).alias("at", "shared"))
        placed = placed.select("head", "name", "label", "n", "size", "at", F.col("shared.token").alias("token"))
        placed = stored(placed.filter("shared.often > 1"))
        kinds = placed.groupBy("head", "token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("rows"))
        sides = [placed.select("head", "token", *[F.col(c).alias(f"{c}_{s}") for c in ("name", "n", "size", "at", "label")]) for s in "ab"]
        met = _dealt(*sides, ["head", "token"], stored(kinds.filter("low <> high").select("head", "token", "rows")))
        need = (F.col("size_a") + F.col("size_b") - spread * (F.col("n_a") + F.col("n_b"))) / 2 - SLACK
        enough = F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b")) >= need
        sized = F.least("n_a", "n_b") + SLACK >= similarity * F.greatest("n_a", "n_b")
        met = met.filter((F.col("name_a") < F.col("name_b")) & (F.col("label_a") != F.col("label_b")) & sized & enough)
        near = differences.filter((F.col("name") != F.col("head")) & (F.size("tokens") <= spread * (F.col("n") + F.col("head_n")) + SLACK))
        near = near.select(F.least("name", "head").alias("a"), F.greatest("name", "head").alias("b"))
        return scratch.keep(stored(met.select(F.col("name_a").alias("a"), F.col("name_b").alias("b")).unionByName(near).distinct()))


def similar_pairs(sets: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets (name, shingles) overlap enough."""
    left = sets.select(F.col("name").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("name").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    both = pairs.join(left, "a").join(right, "b")
    return both.filter(common + SLACK >= similarity * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def _label_links(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    left = labels.select(F.col("name").alias("a"), F.col("label").alias("la"))
    right = labels.select(F.col("name").alias("b"), F.col("label").alias("lb"))
    return stored(pairs.join(left, "a").join(right, "b").select(F.col("la").alias("a"), F.col("lb").alias("b")).filter("a <> b").distinct())


def similar_links(texts: DataFrame, known: DataFrame | None = None, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Stored links (a, b) that connect all labels with similar texts; ``texts`` is a stored table of (node long; text).

    ``known`` gives (node, label) for every node; without it a node is its own label. Texts of one label are known to
    belong together and are not compared with each other. Texts without words are alike.
    """
    spark = texts.sparkSession
    with Scratch(spark) as scratch:
        scan = stored(texts.select("node", "text").mapInArrow(lambda b: _scan_rows(b, shingle), "node long, name long, chunk int, blob binary"))
        named = scan.filter("chunk is null").select("node", "name").distinct()
        named = named.withColumn("label", F.col("node")) if known is None else named.join(known, "node")
        named = stored(named.select("name", "label").distinct())
        labels = stored(named.groupBy("name").agg(F.min("label").alias("label")))
        equal = named.withColumnRenamed("label", "b").join(labels.withColumnRenamed("label", "a"), "name").filter("a <> b")
        links = stored(equal.select("a", "b").distinct())
        counts = spark.sparkContext.broadcast(slot_counts(scan))
        scratch.drop(scan, named)
        rows = shared_prefixes(texts, labels, counts, shingle, similarity)
        counts.unpersist()
        heads = stored(star_pairs(rows, similarity))
        links = stored(links.unionByName(stored(_label_links(_verified(texts, heads, shingle, similarity), labels))))
        # Sets that are connected by now need no more links among each other.
        with Scratch(spark) as inner:
            groups = inner.keep(stored(connected(links)))
        merged = labels.join(groups, labels["label"] == groups["node"], "left").select("name", F.coalesce("root", "label").alias("label"))
        labels = stored(merged)
        after = of_two_labels(rows.drop("label", "rows").join(labels, "name"))
        scratch.drop(rows)
        pairs = stored(candidate_pairs(after.filter(F.col("rows") <= CROWDED), similarity))
        crowd = after.filter(F.col("rows") > CROWDED)
        if not crowd.isEmpty():
            with Scratch(spark) as inner:
                more = inner.keep(crowd_pairs(crowd_differences(texts, crowd, shingle), similarity))
            pairs = stored(pairs.unionByName(more).distinct())
        scratch.drop(after)
        found = stored(_label_links(_verified(texts, pairs, shingle, similarity), labels))
        return scratch.keep(stored(links.unionByName(found)))


def _sets_of(texts: DataFrame, names: DataFrame, shingle: int) -> DataFrame:
    """Stored (name, shingles) of the sets with these distinct names."""
    with Scratch(texts.sparkSession) as scratch:
        ends = stored(names.select(F.col("name").alias("token")))
        wanted = texts.sparkSession.sparkContext.broadcast(token_filter(ends))
        sets = texts.select("node", "text").mapInArrow(lambda b: _set_rows(b, wanted, shingle), "name long, shingles array<long>")
        sets = sets.join(ends.withColumnRenamed("token", "name"), "name", "left_semi").groupBy("name").agg(F.min("shingles").alias("shingles"))
        sets = scratch.keep(stored(sets))
        wanted.unpersist()
        return sets


def _verified(texts: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Stored pairs (a, b) whose sets overlap enough; the shingles of those sets alone are written, for that long."""
    with Scratch(texts.sparkSession) as scratch:
        sets = _sets_of(texts, pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct(), shingle)
        return scratch.keep(stored(similar_pairs(sets, pairs, similarity)))


def similar_groups(texts: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(node, root) of nodes that have a near copy; ``texts`` is a stored table of (node long, unique; text)."""
    return connected(similar_links(texts, None, shingle, similarity))
