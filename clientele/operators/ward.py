"""Ward's hierarchy over micro-clusters.

Ward needs only group sizes and centres. A table of at most ``ward_exact`` distinct rows has a cell for each of them, and
the hierarchy is exact. Beyond that Spark groups the customers into at most ``ward_cells`` cells of a converged K-means
fit. Stability subsamples get cells of their own. Neighbours of cells are searched on Spark (``agglomerate.py``); the
merge tree is bounded by the cells, not by the number of customers.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientele.errors import DataProblem
from clientele.operators.agglomerate import agglomerate
from clientele.operators.fits import Fit, FitSettings, check_k, check_realized
from clientele.operators.kmeans import distinct_rows, fit_cells, nearest_centre

CELL = "__cell"


@dataclass
class MergeTree:
    """Merges by rising height; node ``leaves + i`` is made by merge ``i``."""

    weights: np.ndarray
    left: np.ndarray
    right: np.ndarray
    height: np.ndarray
    size: np.ndarray

    @property
    def leaves(self) -> int:
        return len(self.weights)

    def node_size(self, node: int) -> int:
        return int(self.weights[node] if node < self.leaves else self.size[node - self.leaves])

    def cut(self, k: int) -> np.ndarray:
        """Group number per leaf after undoing the top ``k - 1`` merges; empty leaves get -1."""
        parent = np.arange(self.leaves + len(self.left))
        for i in range(len(self.left) - (k - 1)):
            parent[self.left[i]] = parent[self.right[i]] = self.leaves + i
        for node in range(len(parent) - 1, -1, -1):
            parent[node] = parent[parent[node]]
        groups: dict[int, int] = {}
        return np.array(
            [groups.setdefault(int(parent[leaf]), len(groups)) for leaf in range(self.leaves)]
        )


@dataclass
class Cells:
    """Sizes and centres of the occupied cells."""

    counts: np.ndarray
    centres: np.ndarray
    exact: bool  # every distinct row has a cell of its own


def named_tree(weights: np.ndarray, merges: Sequence[tuple[float, int, int, float]]) -> MergeTree:
    """The tree of merges that come by rising height, each naming one leaf of either part."""
    m = len(weights)
    left, right, height, total = [], [], [], []
    leader, node = list(range(m)), list(range(m))

    def find(x: int) -> int:
        while leader[x] != x:
            leader[x] = leader[leader[x]]
            x = leader[x]
        return x

    for i, (h, a, b, n) in enumerate(merges):
        ra, rb = find(a), find(b)
        pair = sorted((node[ra], node[rb]))
        left.append(pair[0])
        right.append(pair[1])
        height.append(h)
        total.append(n)
        leader[ra] = rb
        node[rb] = m + i
    return MergeTree(weights, np.array(left, int), np.array(right, int), np.array(height), np.array(total))


def build_trees(spark: SparkSession, leaves: Sequence[tuple[np.ndarray, np.ndarray]]) -> list[MergeTree]:
    """Ward trees over (weights, centres) of several tables, built together."""
    return [named_tree(weights, merges) for (weights, _), merges in zip(leaves, agglomerate(spark, leaves))]


def ward_cells(frame: DataFrame, subsets: Sequence[int | None], seed: int, settings: FitSettings) -> list[Cells]:
    """Cells of the prepared table (None) or of its stability subsamples: its distinct rows, if the table has no more
    than ``ward_exact`` of them, or else those of a K-means partition."""
    rows = distinct_rows(frame, subsets, seed, settings.ward_exact)
    if rows is not None:
        return [Cells(counts[counts > 0], rows.points[counts > 0], True) for counts in (rows.counts[s] for s in subsets)]
    found = fit_cells(frame, settings.ward_cells, subsets, seed, settings)
    cells = []
    for subset in subsets:
        partition = found[subset]
        held = partition.counts > 0
        cells.append(Cells(partition.counts[held], partition.centres[held], False))
    return cells


class WardHierarchy:
    """Cells and merge tree of one prepared table, shared by all segment counts."""

    def __init__(self, frame: DataFrame, seed: int, settings: FitSettings, cells: Cells | None = None, tree: MergeTree | None = None):
        self._frame, self._seed, self._settings = frame, seed, settings
        self.cells = cells or ward_cells(frame, [None], seed, settings)[0]
        self.tree = tree or build_trees(frame.sparkSession, [(self.cells.counts, self.cells.centres)])[0]

    @property
    def detail(self) -> str:
        return "exact" if self.cells.exact else f"over {self.tree.leaves} cells"

    def fit(self, k: int, rows: int) -> Fit:
        check_k(k, rows)
        check_realized(min(self.tree.leaves, k), k)
        centres = self.cells.centres
        # A folded literal: one expression node instead of one per cell.
        chosen = F.split(F.lit(",".join(map(str, self.tree.cut(k)))), ",").cast("array<int>")

        def label(table: DataFrame, name: str) -> DataFrame:
            return nearest_centre(table, centres, CELL).withColumn(name, F.get(chosen, F.col(CELL))).drop(CELL)

        return Fit("hierarchical", k, label, detail=self.detail)

    def subsampled(self, repeats: int) -> list["WardHierarchy"]:
        """Hierarchies of the stability subsamples, from cells of their own."""
        cells = ward_cells(self._frame, list(range(repeats)), self._seed, self._settings)
        trees = build_trees(self._frame.sparkSession, [(own.counts, own.centres) for own in cells])
        return [WardHierarchy(self._frame, self._seed, self._settings, own, tree) for own, tree in zip(cells, trees)]

    # ---------------------------------------------------------------------------------------------------- views

    def merges(self) -> DataFrame:
        """One row per merge: step, the node it makes, its two parts with their customers, height and customers."""
        tree = self.tree
        rows = [
            (i, tree.leaves + i, int(l), int(r), tree.node_size(int(l)), tree.node_size(int(r)), float(h), int(n))
            for i, (l, r, h, n) in enumerate(zip(tree.left, tree.right, tree.height, tree.size))
        ]
        return self._frame.sparkSession.createDataFrame(
            rows, "step int, node int, left int, right int, left_customers long, right_customers long, height double, customers long"
        )

    def icicle(self, max_segments: int = 8) -> DataFrame:
        """Nested splits from the whole base down to ``max_segments`` groups: id, parent, customers, share, label."""
        total = int(self.tree.weights.sum())
        if total < 4:
            raise DataProblem("A hierarchy view needs four customers or more.")
        shown = min(max_segments, self.tree.leaves) - 1
        kept = self.merges().filter(F.col("step") >= len(self.tree.left) - shown)
        parts = kept.select(
            F.col("node").alias("parent"),
            F.inline(F.array(*[F.struct(F.col(side).alias("id"), F.col(f"{side}_customers").alias("customers")) for side in ("left", "right")])),
        )
        root = kept.filter(F.col("step") == len(self.tree.left) - 1).select(F.lit("").alias("parent"), F.col("node").alias("id"), "customers")
        nodes = root.select(F.col("id").cast("string"), "parent", "customers").unionByName(
            parts.select(F.col("id").cast("string"), F.col("parent").cast("string"), "customers")
        )
        share = 100 * F.col("customers") / F.lit(total)
        text = F.concat(F.format_number("customers", 0), F.lit(" customers · "), F.format_string("%.0f%%", share))
        return nodes.select("id", "parent", "customers", share.alias("share_%"), text.alias("label"))

    def top_merges(self, leaves: int = 25) -> DataFrame:
        """The last merges of the tree: which nodes joined, at what distance, and how many customers they hold."""
        last = len(self.tree.left)
        return self.merges().filter(F.col("step") >= last - (leaves - 1)).select(
            "step", F.col("left").cast("string"), F.col("right").cast("string"), "left_customers", "right_customers", "height", "customers"
        )


def hierarchy_views(frame: DataFrame, max_segments: int = 8, leaves: int = 25, seed: int = 42, settings: FitSettings | None = None):
    """Icicle rows and top merges of the prepared table."""
    tree = WardHierarchy(frame, seed, settings or FitSettings())
    return tree.icicle(max_segments), tree.top_merges(leaves)
