"""Ward merges in rounds of reciprocal nearest neighbours, searched as Spark jobs.

Ward's cost is reducible: a merged pair is never nearer to a third group than the nearer of its parts was. So all pairs
of groups that are each other's nearest neighbour may be merged at once, in any order, and the tree is the one that
merging the cheapest pair over and over gives. A round searches the neighbours of groups that are new or have lost
theirs; everything else still holds. The searches of all trees (a table's and its subsamples') are one Spark job per
round: groups that search are dealt over the tasks, and compared with all groups, block by block. What is broadcast are
sizes and centres, bounded by the number of leaves that the caller allows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

BLOCK_CELLS = 2_000_000  # costs that a task holds at a time
# Up to so many comparisons a round costs less than starting a job for it.
SMALL_ROUND = 4_000_000


@dataclass
class Groups:
    """Groups of one tree while it is built: live ones have a size above zero."""

    size: np.ndarray
    centre: np.ndarray
    node: np.ndarray
    near: np.ndarray = field(init=False)
    cost: np.ndarray = field(init=False)
    merges: list[tuple[float, int, int, float]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.near = np.full(len(self.size), -1)
        self.cost = np.full(len(self.size), np.inf)

    @property
    def live(self) -> np.ndarray:
        return np.flatnonzero(self.size > 0)

    def to_search(self) -> np.ndarray:
        live = self.live
        return live[self.near[live] < 0] if len(live) > 1 else live[:0]

    def merge_mutual(self) -> None:
        """Merge every pair that names each other; the group with the smaller place takes over its partner."""
        live = self.live
        other = self.near[live]
        pairs = live[(self.near[other] == live) & (live < other)]
        partner = self.near[pairs]
        a, b = self.size[pairs], self.size[partner]
        for x, y, c, n in zip(pairs.tolist(), partner.tolist(), self.cost[pairs].tolist(), (a + b).tolist()):
            self.merges.append((float(np.sqrt(2 * c)), x, y, n))
        self.centre[pairs] = (a[:, None] * self.centre[pairs] + b[:, None] * self.centre[partner]) / (a + b)[:, None]
        self.size[pairs] = a + b
        self.size[partner] = 0
        gone = np.zeros(len(self.size), dtype=bool)
        gone[pairs] = gone[partner] = True
        left = self.live
        lost = left[gone[left] | gone[np.maximum(self.near[left], 0)]]
        self.near[lost], self.cost[lost] = -1, np.inf


def nearest_groups(size: np.ndarray, centre: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, cost) of the group that each asked group merges with at the least cost; ties go to the smallest place."""
    near, least = np.empty(len(asked), dtype=np.int64), np.empty(len(asked))
    block = max(1, BLOCK_CELLS // max(len(size), 1))
    for at in range(0, len(asked), block):
        own = asked[at : at + block]
        gaps = np.zeros((len(own), len(size)))
        for d in range(centre.shape[1]):  # differences, not products: equal centres are at distance zero
            gap = centre[own, d][:, None] - centre[None, :, d]
            gaps += gap * gap
        gaps *= size[own][:, None] * size[None, :] / (size[own][:, None] + size[None, :])
        gaps[np.arange(len(own)), own] = np.inf
        near[at : at + block] = gaps.argmin(axis=1)
        least[at : at + block] = gaps[np.arange(len(own)), near[at : at + block]]
    return near, least


def _search(spark: SparkSession, state: list[tuple[np.ndarray, np.ndarray]], asked: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Neighbours of the asked groups of every tree, places within the live groups of that tree."""
    work = sum(len(a) * len(s) for a, (s, _) in zip(asked, state))
    if work <= SMALL_ROUND:
        return [nearest_groups(s, c, a) for a, (s, c) in zip(asked, state)]
    shared = spark.sparkContext.broadcast(state)

    def found(batches):
        for batch in batches:
            tree, place = (batch.column(i).to_numpy() for i in (0, 1))
            for t in np.unique(tree).tolist():
                own = place[tree == t]
                near, cost = nearest_groups(*shared.value[t], own)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), t)), pa.array(own), pa.array(near), pa.array(cost)], ["tree", "place", "near", "cost"])

    trees = pa.array(np.repeat(np.arange(len(asked)), [len(a) for a in asked]))
    rows = spark.createDataFrame(pa.table({"tree": trees, "place": pa.array(np.concatenate(asked).astype(np.int64))}))
    tasks = min(spark.sparkContext.defaultParallelism, max(1, work // SMALL_ROUND))
    table = rows.repartition(tasks).mapInArrow(found, "tree long, place long, near long, cost double").toArrow()
    shared.unpersist()
    tree, place, near, cost = (table.column(i).to_numpy() for i in range(4))
    out = []
    for t, own in enumerate(asked):
        mine = np.flatnonzero(tree == t)
        mine = mine[np.argsort(place[mine])]
        out.append((near[mine], cost[mine]))
    return out


def agglomerate(spark: SparkSession, leaves: Sequence[tuple[np.ndarray, np.ndarray]]) -> list[list[tuple[float, int, int, float]]]:
    """Merges (height, place, place, customers) of every tree, by rising height; the first place names the merged group.

    ``leaves`` holds (sizes above zero, centres) of each tree. Equal costs go to the smaller place.
    """
    trees = [Groups(size.astype(float).copy(), centre.astype(float).copy(), np.arange(len(size))) for size, centre in leaves]
    while True:
        lives = [t.live for t in trees]
        asked = [t.to_search() for t in trees]
        if not any(len(a) for a in asked):
            break
        state = [(t.size[live], t.centre[live]) for t, live in zip(trees, lives)]
        inside = [np.searchsorted(live, a) for live, a in zip(lives, asked)]
        for tree, live, own, (near, cost) in zip(trees, lives, asked, _search(spark, state, inside)):
            tree.near[own], tree.cost[own] = live[near], cost
            if len(own):
                tree.merge_mutual()
    return [sorted(t.merges, key=lambda m: m[0]) for t in trees]
