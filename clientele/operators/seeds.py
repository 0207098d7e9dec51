"""Starting points from the whole table: weighted candidates in the manner of k-means||.

Each round draws rows in proportion to their squared distance from the candidates so far. A row's draw is an exponential
race: a hash of its id, turned into an exponential variate and divided by the squared distance. The smallest variates
win, so one pass draws an exact number of rows without knowing the total cost, and no result depends on partitioning.
Candidates are then weighted by the rows that lie nearest to them. Full table and subsamples share the passes and
nothing else: each has draws of its own.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clientele.functions.nearest import LEAF_COLUMNS, Leaves, gathered

ROUNDS = 5
BLOCK_CELLS = 2_000_000
MANY_CENTRES = 64  # from which on rows are cut into leaves before they are compared


def nearest_gap(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distance of each row to its nearest centre."""
    own, squares = np.empty(len(rows)), (centres**2).sum(axis=1)
    block = max(1, BLOCK_CELLS // len(centres))
    for at in range(0, len(rows), block):
        part = rows[at : at + block]
        own[at : at + block] = (squares - 2 * part @ centres.T).min(axis=1) + (part**2).sum(axis=1)
    return np.maximum(own, 0.0)


def _draw(points: DataFrame, known: dict[int | None, np.ndarray], size: int, round_: int, seed: int) -> dict[int | None, np.ndarray]:
    """Up to ``size`` further rows for each subset."""
    subsets = list(known)
    masks = [s for s in subsets if s is not None]
    largest = max((len(rows) for rows in known.values()), default=0)
    cut = largest >= MANY_CENTRES and max(rows.shape[1] for rows in known.values()) <= LEAF_COLUMNS

    def race(batches):
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0), np.empty((0, 0)))] * len(subsets)
        for batch in gathered(batches) if cut else batches:
            if not batch.num_rows:
                continue
            flat = batch.column("point").flatten().to_numpy(zero_copy_only=False)
            rows = flat.reshape(batch.num_rows, -1)
            leaves = Leaves(rows) if cut else None
            if cut:
                batch, rows = batch.take(pa.array(leaves.order)), leaves.rows
            draws = batch.column("draw").to_numpy(zero_copy_only=False).view(np.uint64)
            for i, subset in enumerate(subsets):
                inside = np.ones(len(rows), bool) if subset is None else batch.column(f"in_{subset}").to_numpy(zero_copy_only=False).astype(bool)
                own = rows[inside]
                if not len(own):
                    continue
                mixed = draws[inside] ^ np.uint64((0x9E3779B97F4A7C15 * (i + 1)) % 2**64)
                mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                mixed ^= mixed >> np.uint64(29)
                race_ = -np.log((mixed >> np.uint64(11)).astype(float) / 2.0**53 + 2.0**-54)
                if len(known[subset]):
                    if cut:
                        gap = np.maximum(leaves.nearest(known[subset])[1][inside] + (own**2).sum(axis=1), 0.0)
                    else:
                        gap = nearest_gap(own, known[subset])
                    far = gap > 1e-12 * ((own**2).sum(axis=1) + 1e-300)
                    own, race_ = own[far], race_[far] / gap[far]
                if not len(own):
                    continue
                keys = np.concatenate([best[i][0], race_])
                kept = np.vstack([best[i][1], own]) if len(best[i][0]) else own
                first = np.argsort(keys, kind="stable")[:size]
                best[i] = (keys[first], kept[first])
        for i, (keys, kept) in enumerate(best):
            if len(keys):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), i, np.int32)), pa.array(keys), pa.array(list(kept), pa.list_(pa.float64()))],
                    ["subset", "race", "point"],
                )

    table = points.select("point", F.xxhash64(F.col("id").cast("string"), F.lit(seed), F.lit(round_)).alias("draw"), *[f"in_{r}" for r in masks])
    drawn = table.mapInArrow(race, "subset int, race double, point array<double>")
    ranked = drawn.withColumn("place", F.row_number().over(Window.partitionBy("subset").orderBy("race", "point")))
    found: dict[int | None, list] = {s: [] for s in subsets}
    for row in ranked.filter(F.col("place") <= size).select("subset", "point").collect():  # size x subsets rows at most
        found[subsets[row["subset"]]].append(row["point"])
    return {s: np.array(rows, float) for s, rows in found.items()}


def candidates(points: DataFrame, subsets: Sequence[int | None], total: int, seed: int, rounds: int = ROUNDS) -> dict[int | None, np.ndarray]:
    """Distinct candidates per subset, at most ``total`` each; all distinct rows where there are no more than that."""
    size = math.ceil(total / rounds)
    known: dict[int | None, np.ndarray] = {s: np.empty((0, 0)) for s in subsets}
    for round_ in range(rounds):
        for subset, rows in _draw(points, known, size, round_, seed).items():
            if len(rows):
                both = np.vstack([known[subset], rows]) if len(known[subset]) else rows
                known[subset] = np.unique(both, axis=0)
    return {s: rows[:total] for s, rows in known.items()}


def spread_seeds(points: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ over weighted candidates: each further seed is the best of a few draws by weighted squared distance."""
    tries = 2 + int(np.log(k))
    chosen = [points[rng.choice(len(points), p=weights / weights.sum())]]
    gap = ((points - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < k:
        cost = gap * weights
        total = cost.sum()
        if total <= 0:
            chosen.append(points[rng.integers(len(points))])
            continue
        draws = np.minimum(np.searchsorted(np.cumsum(cost), rng.random(tries) * total), len(points) - 1)
        options = [np.minimum(gap, ((points - points[d]) ** 2).sum(axis=1)) for d in draws]
        best = int(np.argmin([(option * weights).sum() for option in options]))
        chosen.append(points[draws[best]])
        gap = options[best]
    return np.array(chosen)


def settle(points: np.ndarray, weights: np.ndarray, centres: np.ndarray, tolerance: float) -> tuple[np.ndarray, float]:
    """Weighted Lloyd steps over the candidates, to bring a start near its end before the table is read for it."""
    squares, eye = (points**2).sum(axis=1), np.eye(len(centres))
    for _ in range(100):
        gaps = (centres**2).sum(axis=1) - 2 * points @ centres.T
        label = gaps.argmin(axis=1)
        cost = float(((gaps[np.arange(len(points)), label] + squares) * weights).sum())
        hot = eye[label] * weights[:, None]
        mass = hot.sum(axis=0)
        moved = np.where(mass[:, None] > 0, hot.T @ points / np.maximum(mass, 1e-300)[:, None], centres)
        shift = ((moved - centres) ** 2).sum()
        centres = moved
        if shift <= tolerance:
            break
    return centres, cost
