"""Nearest neighbours by cross-polytope hashing.

A table hashes a unit vector by fast pseudo-rotations (random signs and Hadamard transforms, three times over) to the
nearest signed axis; several such hashes are concatenated, the last over as few axes as the table's size asks for, so
that a bucket holds about ``BUCKET`` vectors whatever their number. A query looks into the buckets whose axes lie nearest
to it, in order. How many is found out from a bounded sample of queries, whose true neighbours are searched in all rows.
Rows that share a bucket with a query are compared by the inner product itself, in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clientele.llm.shared import partitions_for, stored

BUCKET = 512  # vectors of a bucket, on average
BLOCK = 1024  # rows, and queries, of a bucket that are compared at once: a crowded bucket is cut into such blocks
FLUSH = 1 << 19  # best rows that a task holds before it keeps the best of each query only
MARGIN = 4  # rows beyond the limit that block products may rank


@dataclass(frozen=True)
class Hashing:
    """``tables`` of ``hashes`` hashes each, over ``width`` dimensions (a power of two); the last has ``axes`` axes.

    ``top`` is the largest length, for vectors of unequal lengths: they get one more coordinate that makes them equal,
    which leaves inner products with queries (0 there) as they are. None for vectors of one length.
    """

    width: int
    tables: int
    hashes: int
    axes: int
    top: float | None
    seed: int = 7

    def signs(self, table: int, hash_: int) -> np.ndarray:
        return np.random.default_rng((self.seed, table, hash_)).choice((-1.0, 1.0), (3, self.width))

    def lifted(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        out = np.zeros((len(vectors), self.width))
        out[:, : vectors.shape[1]] = vectors
        if self.top is not None and not query:
            out[:, vectors.shape[1]] = np.sqrt(np.maximum(self.top**2 - np.einsum("ij,ij->i", vectors, vectors), 0))
        length = np.sqrt(np.einsum("ij,ij->i", out, out))
        return out / np.where(length > 0, length, 1)[:, None]

    def axis_values(self, unit: np.ndarray, table: int) -> list[np.ndarray]:
        """Per hash (vectors x 2 axes): how near each signed axis is."""
        found = []
        for h in range(self.hashes):
            turned = unit
            for sign in self.signs(table, h):
                turned = hadamard(turned * sign)
            turned = turned[:, : self.axes if h == self.hashes - 1 else self.width]
            found.append(np.concatenate([turned, -turned], axis=1))
        return found

    def buckets(self, unit: np.ndarray, table: int) -> np.ndarray:
        code = np.zeros(len(unit), dtype=np.int64)
        for values in self.axis_values(unit, table):
            code = code * values.shape[1] + np.argmax(values, axis=1)
        return code

    @property
    def count(self) -> int:
        return (2 * self.width) ** (self.hashes - 1) * 2 * self.axes

    def probes(self, unit: np.ndarray, table: int, many: int) -> np.ndarray:
        """(vectors x many) buckets by the sum of their axes' values, best first."""
        sums, codes = np.zeros((len(unit), 1)), np.zeros((len(unit), 1), dtype=np.int64)
        for values in self.axis_values(unit, table):
            # The best of the whole sum start with one of the best of its first summands.
            sums = (sums[:, :, None] + values[:, None, :]).reshape(len(unit), -1)
            codes = (codes[:, :, None] * values.shape[1] + np.arange(values.shape[1])).reshape(len(unit), -1)
            keep = np.argsort(-sums, axis=1, kind="stable")[:, :many]
            sums, codes = np.take_along_axis(sums, keep, 1), np.take_along_axis(codes, keep, 1)
        return codes


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of every row, with unit scale."""
    n, width = rows.shape
    half = 1
    while half < width:
        rows = rows.reshape(n, -1, 2, half)
        rows = np.stack([rows[:, :, 0] + rows[:, :, 1], rows[:, :, 0] - rows[:, :, 1]], axis=2)
        half *= 2
    return rows.reshape(n, width) / math.sqrt(width)


def plan(rows: int, dimension: int, top: float | None, tables: int, bucket: int = BUCKET) -> Hashing:
    width = 1 << max(dimension - 1 + (top is not None), 1).bit_length()
    wanted, hashes = max(rows / bucket, 2), 1
    while (2 * width) ** hashes < wanted:
        hashes += 1
    last = wanted / (2 * width) ** (hashes - 1)
    return Hashing(width, tables, hashes, min(width, 1 << max(math.ceil(math.log2(max(last, 2))) - 1, 0)), top)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(vectors: DataFrame, name: str) -> Column:
    """No null, no component that is null or not finite, and one component at least that is not zero."""
    sound = F.forall(name, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))  # NaN is above infinity
    return F.coalesce(sound & F.exists(name, lambda x: x != 0), F.lit(False))


def exact_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, each summed without loss before it is rounded."""
    return np.array([math.fsum(p) for p in (left * right).tolist()])


def best_of(owner: np.ndarray, score: np.ndarray, rank: np.ndarray, limit: int) -> np.ndarray:
    """Positions of each owner's ``limit`` best."""
    order = np.lexsort((rank, -score, owner))
    first = np.r_[True, owner[order][1:] != owner[order][:-1]] if len(order) else np.empty(0, bool)
    begin = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0)) if len(order) else order
    return order[np.arange(len(order)) - begin < limit]


def _block_rows(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Best (query, node, score) of rows that come sorted by cell, those of the table before the queries."""
    cell, held, names = None, [], []
    owner, node, score = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]

    def flush() -> pa.RecordBatch:
        o, n, s = np.concatenate(owner), np.concatenate(node), np.concatenate(score)
        # A row that several tables found is there several times, with one score.
        once = np.unique(np.stack([o, n]), axis=1, return_index=True)[1]
        o, n, s = o[once], n[once], s[once]
        keep = best_of(o, s, n, limit)
        owner[:], node[:], score[:] = [o[keep]], [n[keep]], [s[keep]]
        return pa.RecordBatch.from_arrays([pa.array(o[keep]), pa.array(n[keep]), pa.array(s[keep])], ["query", "node", "score"])

    for batch in batches:
        table, where, salt, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 3))
        asks = batch.column(4).to_numpy(zero_copy_only=False)
        body = matrix(batch.column(5))
        key = np.stack([table, where, salt, asks.astype(np.int64)])
        cuts = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)])
        for begin, end in zip(cuts.tolist(), [*cuts[1:].tolist(), len(ids)]):
            now = tuple(key[:3, begin].tolist())
            if now != cell:
                cell, held, names = now, [], []
            if not asks[begin]:
                held.append(body[begin:end])
                names.append(ids[begin:end])
                continue
            if not held:
                continue
            rows, own = np.concatenate(held), np.concatenate(names)
            held, names = [rows], [own]
            for at in range(begin, end, BLOCK):
                asked, q = body[at : min(at + BLOCK, end)], ids[at : min(at + BLOCK, end)]
                found = asked @ rows.T
                many = min(limit, found.shape[1])
                best = np.argpartition(-found, many - 1, axis=1)[:, :many]
                owner.append(np.repeat(q, many))
                node.append(own[best].ravel())
                score.append(np.take_along_axis(found, best, 1).ravel())
                if sum(map(len, owner)) > FLUSH:
                    full = flush()
                    if full.num_rows > FLUSH // 2:
                        yield full
                        owner[:], node[:], score[:] = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
    yield flush()


def _cells(nodes: DataFrame, queries: DataFrame, hashing: Hashing, probes: int) -> DataFrame:
    """(t, bucket, salt, node, asks, v): rows of the table and queries, in blocks of buckets that both are in.

    A bucket of many rows is cut into blocks by row, one of many queries by query; every row meets every query once.
    """

    def coded(batches: Iterator[pa.RecordBatch], query: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(begin, BLOCK)
                unit = hashing.lifted(matrix(piece.column(1)), query)
                for t in range(hashing.tables):
                    codes = hashing.probes(unit, t, probes) if query else hashing.buckets(unit, t)[:, None]
                    n = codes.shape[1]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(codes.size, t)), pa.array(codes.ravel()), pa.array(np.repeat(piece.column(0).to_numpy(), n))], ["t", "bucket", "node"]
                    )

    own = "t long, bucket long, node long"
    rows = stored(nodes.select("node", "v").mapInArrow(lambda b: coded(b, False), own))
    asks = stored(queries.select("node", "v").mapInArrow(lambda b: coded(b, True), own))
    counts = rows.groupBy("t", "bucket").agg(F.count(F.lit(1)).alias("rows")).join(
        asks.groupBy("t", "bucket").agg(F.count(F.lit(1)).alias("asks")), ["t", "bucket"]
    )
    counts = stored(counts.select("t", "bucket", F.ceil(F.col("rows") / BLOCK).alias("r"), F.ceil(F.col("asks") / BLOCK).alias("q")))

    def dealt(side: DataFrame, own: str, other: str, query: bool) -> DataFrame:
        mine = F.pmod(F.xxhash64("node"), F.col(own))
        there = F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias("far")
        both = side.join(counts, ["t", "bucket"]).select("t", "bucket", "node", mine.alias("near"), "r", there)
        row, ask = ("far", "near") if query else ("near", "far")
        return both.select("t", "bucket", (F.col(ask) * F.col("r") + F.col(row)).alias("salt"), "node", F.lit(query).alias("asks"))

    met = dealt(rows, "r", "q", False).join(nodes.select("node", "v"), "node").unionByName(
        dealt(asks, "q", "r", True).join(queries.select("node", "v"), "node")
    )
    return met.select("t", "bucket", "salt", "node", "asks", "v")


def _true_neighbours(nodes: DataFrame, sample: list, limit: int) -> dict[int, list]:
    """The best rows of a bounded sample of queries among all rows, by product with each of them."""
    spark = nodes.sparkSession
    asked = spark.sparkContext.broadcast((np.array([r["node"] for r in sample]), np.array([r["v"] for r in sample], dtype=np.float64)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = asked.value
        owner, node, score, body = [], [], [], []
        for batch in batches:
            own, mine = batch.column(0).to_numpy(), matrix(batch.column(1))
            found = q @ mine.T
            found[ids[:, None] == own[None, :]] = -np.inf
            many = min(limit, len(own))
            best = np.argpartition(-found, many - 1, axis=1)[:, :many] if many else np.empty((len(q), 0), np.int64)
            owner.append(np.repeat(np.arange(len(q)), many))
            node.append(own[best].ravel())
            score.append(np.take_along_axis(found, best, 1).ravel())
            body.append(mine[best.ravel()])
            o, n, s, b = np.concatenate(owner), np.concatenate(node), np.concatenate(score), np.concatenate(body)
            keep = best_of(o, s, n, limit)
            owner, node, score, body = [o[keep]], [n[keep]], [s[keep]], [b[keep]]
        if owner:
            yield pa.RecordBatch.from_arrays([pa.array(owner[0]), pa.array(node[0]), pa.array(score[0]), pa.array(list(body[0]), pa.list_(pa.float64()))], ["q", "node", "score", "v"])

    found = nodes.select("node", "v").mapInArrow(rows, "q long, node long, score double, v array<double>")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "node")
    out: dict[int, list] = {}
    for r in found.filter("score > -1e308").withColumn("i", F.row_number().over(order)).filter(F.col("i") <= limit).collect():
        out.setdefault(r["q"], []).append(r["v"])
    return out


def probes_for(hashing: Hashing, sample: np.ndarray, neighbours: dict[int, list], recall: float) -> int:
    """The fewest buckets per table by which so large a share of the sample's neighbours is found."""
    asked = hashing.lifted(sample, True)
    first = []
    for q, found in neighbours.items():
        codes = [hashing.buckets(hashing.lifted(np.array(found), False), t) for t in range(hashing.tables)]
        place = np.full(len(found), hashing.count)
        for t, own in enumerate(codes):
            order = hashing.probes(asked[q : q + 1], t, hashing.count)[0]
            at = np.empty(hashing.count, dtype=np.int64)
            at[order] = np.arange(hashing.count)
            place = np.minimum(place, at[own])
        first.append(place)
    if not first:
        return 1
    places = np.sort(np.concatenate(first))
    return int(places[min(math.ceil(recall * len(places)), len(places)) - 1]) + 1


def nearest(
    vectors: DataFrame, asks: Column, limit: int = 20, vec_id: str = "vec_id", vector: str = "embedding",
    tables: int = 4, recall: float = 0.96, sample: int = 256, bucket: int = BUCKET,
) -> DataFrame:
    """query_id, rank, ``vec_id``, score: for each row that satisfies ``asks`` the ``limit`` rows found with the largest
    inner product, largest first, ties by smaller id; never the query's own row.

    Rows take no part if their vector is null, zero, has a null or non-finite component, or another number of components
    than most rows have; neither do rows with a null id. Rows with equal ids are rows of their own. All others are
    indexed. Equal vectors are one node of the index, of which the smallest ``limit`` + 1 ids can matter to a query. A
    bounded ``sample`` of the queries is searched in all rows, and a query looks into as many buckets as that sample
    needs to find the share ``recall`` of its neighbours. Scores are in double precision. Other columns are ignored.
    """
    kind = dict(vectors.dtypes)[vec_id]
    body = vectors.select(F.col(vec_id).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(asks, F.lit(False)).alias("asks"))
    body = stored(body.filter(F.col("id").isNotNull() & usable(body, "v")).withColumn("row", F.monotonically_increasing_id()))
    sizes = body.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    empty = f"query_id {kind}, rank int, {vec_id} {kind}, score double"
    if most is None:
        return vectors.sparkSession.createDataFrame([], empty)
    body = body.filter(F.size("v") == most["size"])

    # One node per distinct vector: its smallest row number names it.
    named = body.withColumn("digest", F.md5(F.to_json("v").cast("binary")))
    same = Window.partitionBy("digest").orderBy("id", "row")
    heads = named.groupBy("digest").agg(F.min("row").alias("node"))
    few = named.select("digest", "id", "row").withColumn("i", F.row_number().over(same)).filter(F.col("i") <= limit + 1)
    members = stored(few.join(heads, "digest").select("node", "id", "row"))
    askers = stored(named.filter("asks").select("digest", "id", "row").join(heads, "digest").select("node", F.col("id").alias("query_id"), F.col("row").alias("own")))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    nodes = stored(named.join(heads.select(F.col("node").alias("row")), "row").select(F.col("row").alias("node"), "v", length.alias("length")))
    facts = nodes.agg(F.count(F.lit(1)), F.min("length"), F.max("length")).first()
    top = facts[2] if facts[2] - facts[1] > 1e-3 * facts[2] else None
    hashing = plan(facts[0], most["size"], top, tables, bucket)
    queries = stored(nodes.join(askers.select("node").distinct(), "node", "left_semi"))
    drawn = queries.orderBy(F.xxhash64("node"), "node").limit(sample).select("node", "v").collect()  # the bounded sample
    if not drawn:
        return vectors.sparkSession.createDataFrame([], empty)
    probes = probes_for(hashing, np.array([r["v"] for r in drawn]), _true_neighbours(nodes, drawn, limit), recall)

    cells = _cells(nodes, queries, hashing, probes)
    many = partitions_for(vectors.sparkSession, facts[0] * hashing.tables * most["size"] * 8, 1 << 26)
    dealt = cells.repartition(many, "t", "bucket", "salt").sortWithinPartitions("t", "bucket", "salt", "asks")
    wide = limit + MARGIN
    found = dealt.mapInArrow(lambda b: _block_rows(b, wide), "query long, node long, score double")
    # A query's own vector is a node as well: it may come from a bucket, and is there in any case.
    own = queries.select(F.col("node").alias("query"), "node").withColumn("score", F.lit(float("inf")))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    found = found.unionByName(own).groupBy("query", "node").agg(F.max("score").alias("score"))
    found = stored(found.withColumn("i", F.row_number().over(best)).filter(F.col("i") <= wide + 1).drop("i", "score"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            products = exact_products(matrix(batch.column(2)), matrix(batch.column(3))) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(products)], ["query", "node", "score"])

    both = found.join(queries.select(F.col("node").alias("query"), F.col("v").alias("a")), "query").join(nodes.select("node", F.col("v").alias("b")), "node")
    exact = stored(both.select("query", "node", "a", "b").mapInArrow(scored, "query long, node long, score double"))
    # Queries with one vector have one list of nodes; ids are put in per query.
    lists = askers.withColumnRenamed("node", "query").join(exact, "query").join(members, "node").filter("row <> own")
    order = Window.partitionBy("own").orderBy(F.desc("score"), "id", "row")
    ranked = lists.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return ranked.select("query_id", "rank", F.col("id").alias(vec_id), "score")
