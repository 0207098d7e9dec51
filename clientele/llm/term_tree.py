"""Ranked lexical search by a document FP-tree and branch-and-bound.

Every document is restricted to the terms of the queries, its terms are put in one order (frequent ones first), and
documents of a tree share the path of their common first terms. A node knows, for each term, the largest count of any
document below it, and the smallest length weight m: a term's part of a score grows with its count and falls with m, so
they bound the score of all documents below. For each query the tree is walked depth first, best child first, and a
subtree is left out when its bound cannot reach the query's best documents so far.

Documents are dealt to tasks by ranges of their paths, so that paths are shared across the whole table; a task works
through them in trees of a bounded size. A sample of trees gives each query a score that its last result has at least:
with that in hand, the walk over all trees returns little more than the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clientele.llm.shared import fresh_name, partitions_for, stored
from clientele.llm.terms import terms
from clientele.llm.words import WORD_BYTE, slices

SCALE = 1_000_000_000
LEAF = 16  # documents of a subtree that is not divided further
TREE_DOCS, TREE_CELLS = 8192, 1 << 24  # documents of a tree; and nodes x terms, which bound its memory
BLOCK_TERMS = 1 << 17  # terms of the queries that are searched together, on average; their number bounds what is broadcast
TASK_DOCS = 1 << 15
HEADS = 16  # one in so many documents gives the first bounds


def part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A term's part of a score before its weight: grows with tf, falls with m."""
    tf = tf.astype(np.int64)
    return (SCALE * tf) // (1000 * tf + 20 * m)


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, term binary), each pair once: the terms of all texts of an item."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches):
            found, _, row = terms(data, offsets, WORD_BYTE)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), found.cast(pa.binary())], ["item", "term"])

    body = items.select(F.col(item_id).alias("item"), F.col(text).alias("text"))
    return body.mapInArrow(rows, f"item {dict(items.dtypes)[item_id]}, term binary").distinct()


def _vector_rows(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    """(id, n, terms, counts): all terms of a document counted, those of the vocabulary listed in ascending order."""
    words = pa.array(vocabulary.value, pa.large_binary())
    size = max(len(words), 1)
    for batch, data, offsets in slices(batches):
        found, _, row = terms(data, offsets, WORD_BYTE)
        known = pc.index_in(found, words).fill_null(-1).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(known >= 0)
        key, count = np.unique(row[at].astype(np.int64) * size + known[at], return_counts=True)
        ends = pa.array(np.searchsorted(key, np.arange(batch.num_rows + 1) * size).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (key % size, count)]
        n = np.bincount(row, minlength=batch.num_rows).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *lists], ["id", "n", "terms", "counts"])


class Tree:
    """Documents of one tree, in path order, and its nodes in arrays: children of a node follow each other in ``child``."""

    def __init__(self, ends: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray, rank: np.ndarray, vocabulary: int) -> None:
        """``rank`` orders equal scores; terms of a document ascend in the order of paths."""
        code = term.astype(">u4").tobytes()
        paths = [code[4 * a : 4 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        order = np.array(sorted(range(len(paths)), key=paths.__getitem__), dtype=np.int64)
        lengths = np.diff(ends)[order]
        self.ends = np.concatenate([[0], np.cumsum(lengths)])
        take = np.repeat(ends[:-1][order] - self.ends[:-1], lengths) + np.arange(self.ends[-1])
        self.term, self.tf, self.m, self.rank, self.order = term[take], tf[take], m[order], rank[order], order
        self.paths = [paths[i] for i in order.tolist()]
        self.low, self.high, self.children = [], [], []
        self._node(0, len(self.paths), 0)
        leaf = [i for i, c in enumerate(self.children) if not c]
        self.most = np.zeros((len(self.low), vocabulary), dtype=np.int32)
        self.least = np.zeros(len(self.low), dtype=np.int64)
        self.first = np.zeros(len(self.low), dtype=np.int64)
        owner = np.empty(len(self.paths), dtype=np.int64)
        for i in leaf:
            owner[self.low[i] : self.high[i]] = i
        np.maximum.at(self.most, (np.repeat(owner, lengths), self.term), self.tf)
        for i in range(len(self.low) - 1, -1, -1):  # children stand behind their parent
            below = self.children[i]
            if below:
                np.max(self.most[below], axis=0, out=self.most[i])
                self.least[i], self.first[i] = self.least[below].min(), self.first[below].min()
            else:
                own = slice(self.low[i], self.high[i])
                self.least[i], self.first[i] = self.m[own].min(), self.rank[own].min()

    def _node(self, low: int, high: int, depth: int) -> None:
        """Nodes of documents low to high, which share their first ``depth`` terms."""
        todo = [(low, high, depth, -1)]
        while todo:
            low, high, depth, parent = todo.pop()
            me = len(self.low)
            self.low.append(low)
            self.high.append(high)
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(me)
            if high - low <= LEAF or self.paths[low] == self.paths[high - 1]:
                continue
            head, tail = self.paths[low], self.paths[high - 1]  # sorted: what these two share, all share
            while head[4 * depth : 4 * depth + 4] == tail[4 * depth : 4 * depth + 4]:
                depth += 1
            begin, runs = low, []
            while begin < high:
                step, end = self.paths[begin][4 * depth : 4 * depth + 4], begin + 1
                while end < high and self.paths[end][4 * depth : 4 * depth + 4] == step:
                    end += 1
                small = end - begin <= LEAF and runs and runs[-1][2] and end - runs[-1][0] <= LEAF
                if small:  # small sisters are one leaf
                    runs[-1] = (runs[-1][0], end, True)
                else:
                    runs.append((begin, end, end - begin <= LEAF))
                begin = end
            todo += [(a, b, depth if flat else depth + 1, me) for a, b, flat in runs]

    def best(self, own: np.ndarray, weight: np.ndarray, least: int, limit: int, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the ``limit`` best with a score of at least ``least``; ``slot`` is scratch space of -1s."""
        bound = part(self.most[:, own], self.least[:, None]) @ weight
        slot[own] = np.arange(len(own))
        docs, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        last = np.iinfo(np.int64).max  # rank that a document with the score ``least`` must stay below
        stack = [0]
        while stack:
            node = stack.pop()
            if bound[node] < least or (bound[node] == least and self.first[node] > last):
                continue
            if self.children[node]:
                stack += sorted(self.children[node], key=bound.__getitem__)
                continue
            low, high = self.low[node], self.high[node]
            entries = slice(self.ends[low], self.ends[high])
            at = slot[self.term[entries]]
            hit = np.flatnonzero(at >= 0)
            doc = np.repeat(np.arange(low, high), np.diff(self.ends[low : high + 1]))[hit]
            parts = weight[at[hit]] * part(self.tf[entries][hit], self.m[doc])
            sums = np.zeros(high - low, dtype=np.int64)
            np.add.at(sums, doc - low, parts)
            good = np.flatnonzero(sums >= least)
            docs, scores = np.concatenate([docs, good + low]), np.concatenate([scores, sums[good]])
            if len(docs) > limit:
                keep = np.lexsort((self.rank[docs], -scores))[:limit]
                docs, scores = docs[keep], scores[keep]
                least, last = int(scores[-1]), int(self.rank[docs[-1]])
        slot[own] = -1
        return self.order[docs], scores


def _search_rows(batches: Iterator[pa.RecordBatch], model, limit: int, size: int) -> Iterator[pa.RecordBatch]:
    queries, weights, place, least, totals = model.value
    n_docs, n_terms = totals
    vocabulary = len(place)
    slot = np.full(vocabulary, -1, dtype=np.int64)

    def searched(rows: pa.Table) -> pa.RecordBatch:
        ids, n = rows.column("id").combine_chunks(), rows.column("n").to_numpy()
        lists = rows.column("terms").combine_chunks()
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
        term = place[lists.flatten().to_numpy(zero_copy_only=False)]
        tf = rows.column("counts").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(n)), np.diff(ends))
        order = np.lexsort((term, row))
        rank = np.empty(len(n), dtype=np.int64)
        rank[pc.sort_indices(ids).to_numpy()] = np.arange(len(n))
        m = 50 + (50 * n * n_docs) // n_terms
        tree = Tree(ends, term[order], tf[order], m, rank, vocabulary)
        found = [tree.best(place[own], weights[own], max(bar, 1), limit, slot) for own, bar in zip(queries, least)]
        docs = np.concatenate([np.empty(0, np.int64), *[d for d, _ in found]])
        item = np.repeat(np.arange(len(found)), [len(d) for d, _ in found])
        score = np.concatenate([np.empty(0, np.int64), *[s for _, s in found]])
        return pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), ids.take(pa.array(docs)), pa.array(score)], ["item", "id", "score"])

    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        waiting.append(batch)
        while sum(b.num_rows for b in waiting) >= size:
            table = pa.Table.from_batches(waiting)
            yield searched(table.slice(0, size))
            waiting = table.slice(size).to_batches()
    if sum(b.num_rows for b in waiting):
        yield searched(pa.Table.from_batches(waiting))


def _block(docs: DataFrame, pairs: DataFrame, limit: int) -> DataFrame:
    """Results for the items of one block; their terms and weights are what reaches the driver and the tasks."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["id"]
    rows = pairs.groupBy("item").agg(F.collect_list("term").alias("terms")).collect()
    words = sorted({bytes(t) for r in rows for t in r["terms"]})
    number = {w: i for i, w in enumerate(words)}
    queries = [np.array(sorted(number[bytes(t)] for t in r["terms"]), dtype=np.int64) for r in rows]

    schema = f"id {kind}, n long, terms array<int>, counts array<int>"
    listed = spark.sparkContext.broadcast(words)
    vectors = stored(docs.mapInArrow(lambda b: _vector_rows(b, listed), schema))
    totals = vectors.agg(F.sum((F.col("n") > 0).cast("long")), F.sum("n")).first()
    n_docs, n_terms = totals[0] or 0, max(totals[1] or 0, 1)
    # One row per term of the block comes back.
    held = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.ln(F.lit(2 * n_docs + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    df, weights = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
    for r in held.select("term", "df", weight.alias("w")).collect():
        df[r["term"]], weights[r["term"]] = r["df"], r["w"]
    place = np.empty(len(words), dtype=np.int64)
    place[np.lexsort((np.arange(len(words)), -df))] = np.arange(len(words))

    size = max(4 * LEAF, min(TREE_DOCS, TREE_CELLS * LEAF // (4 * max(len(words), 1))))
    restricted = vectors.filter(F.size("terms") > 0)

    def search(part_of: DataFrame, least: list[int]) -> DataFrame:
        model = spark.sparkContext.broadcast((queries, weights, place, least, (n_docs, n_terms)))
        return part_of.mapInArrow(lambda b: _search_rows(b, model, limit, size), f"item int, id {kind}, score long")

    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    top = lambda found: found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit)
    heads = restricted.filter(F.pmod(F.xxhash64("id", "n"), F.lit(HEADS)) == 0)
    least = [1] * len(queries)
    for r in top(search(heads, least)).filter(F.col("rank") == limit).collect():  # a row per item
        least[r["item"]] = r["score"]

    # Range exchange by path (terms in the order of paths), then by id, so that copies do not meet in one task.
    ordered = spark.sparkContext.broadcast(place)

    def pathed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [np.sort(ordered.value[t.values.to_numpy()])[:8].astype(">u4").tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary())], [*batch.schema.names, "path"])

    many = partitions_for(spark, vectors.count(), TASK_DOCS)
    dealt = restricted.mapInArrow(pathed, f"{schema}, path binary").repartitionByRange(many, "path", "id").drop("path")
    named = spark.createDataFrame([(i, r["item"]) for i, r in enumerate(rows)], f"item int, name {dict(pairs.dtypes)['item']}")
    return top(search(dealt, least)).join(named, "item").select(F.col("name").alias("item"), "rank", "id", "score")


def ranked_documents(
    docs: DataFrame, items: DataFrame, limit: int = 50, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """``item_id``, rank, ``doc_id``, score of each item's ``limit`` best rows of ``docs`` with a score above 0.

    Terms are maximal runs of ASCII letters (in lower case), digits and characters beyond ASCII. Null and empty texts
    have none: such documents are never found, such items find nothing. Rows of one item id are one item with the terms
    of all of them; a null id is an id. Rows of one document id are ranked one by one; equal scores go by ascending id,
    null last. Other columns are ignored. Items are searched in blocks of about ``block_terms`` terms, each against all
    documents.
    """
    if item_id == doc_id:
        raise ValueError("Item and document ids need different names.")
    pairs = stored(item_terms(items, item_id, item_text))
    body = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    blocks = max(1, -(-pairs.count() // block_terms))
    block = fresh_name(pairs, "block")
    dealt = pairs.withColumn(block, F.pmod(F.xxhash64("item"), F.lit(blocks)))
    out = None
    for i in range(blocks):
        found = _block(body, dealt.filter(F.col(block) == i).drop(block), limit)
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("item").alias(item_id), "rank", F.col("id").alias(doc_id), "score")
