"""The K-means partition of least cost along a single column, without starts.

On a line a segment is a stretch of values, so a partition is a set of cuts. Tasks sum the values up in buckets, a few
thousand in all. A cut between two buckets has an exact cost; a cut inside of a bucket costs no less than what is left
when the bucket is taken out. Buckets in which a cut might still be cheaper than the best known cuts are split, the
others are left alone, until no bucket can do better: a handful of passes at any size.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BUCKETS = 2048
SUMS = "bucket int, n double, s double, q double, low double, high double"


def _bucket_sums(points: DataFrame, subset: int | None, edges: np.ndarray, origin: float) -> np.ndarray:
    """Per bucket that holds values: its number, count, sum and squares about the origin, least and largest value."""
    mask = None if subset is None else f"in_{subset}"
    names = ["bucket", "n", "s", "q", "low", "high"]

    def partial(batches):
        n, s, q = (np.zeros(len(edges)) for _ in range(3))
        low, high = np.full(len(edges), np.inf), np.full(len(edges), -np.inf)
        for batch in batches:
            x = batch.column("point").flatten().to_numpy(zero_copy_only=False)
            if mask is not None:
                x = x[batch.column(mask).to_numpy(zero_copy_only=False).astype(bool)]
            at = np.searchsorted(edges, x, side="right") - 1
            away = x - origin
            n += np.bincount(at, minlength=len(edges))
            s += np.bincount(at, weights=away, minlength=len(edges))
            q += np.bincount(at, weights=away * away, minlength=len(edges))
            np.minimum.at(low, at, x)
            np.maximum.at(high, at, x)
        held = np.flatnonzero(n)
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array(held.astype("int32")), *[pa.array(c[held]) for c in (n, s, q, low, high)]], names)

    table = points.select("point", *([mask] if mask else [])).mapInArrow(partial, SUMS)
    found = table.groupBy("bucket").agg({"n": "sum", "s": "sum", "q": "sum", "low": "min", "high": "max"})
    rows = found.select("bucket", "sum(n)", "sum(s)", "sum(q)", "min(low)", "max(high)").collect()  # a row per bucket
    return np.array(sorted(map(tuple, rows)), dtype=float).reshape(-1, 6)


class _Buckets:
    """Costs of cuts between and inside of buckets; stretch costs come from running sums."""

    def __init__(self, sums: np.ndarray, inner: np.ndarray):
        n, s, q = (np.concatenate(([0.0], np.cumsum(sums[:, i]))) for i in (1, 2, 3))
        self.n, self.s, self.size = n, s, len(sums)
        count, total = n[None, :] - n[:, None], s[None, :] - s[:, None]
        cost = q[None, :] - q[:, None] - total**2 / np.where(count > 0, count, 1)
        self.cost = np.where(np.tri(self.size + 1, k=-1, dtype=bool), np.inf, np.maximum(cost, 0.0))
        self.inner = inner  # a cut may lie inside

    def best(self, k: int) -> tuple[float, list[int]]:
        """The cheapest cuts between buckets."""
        known, back = self.cost[0], []
        for _ in range(k - 1):
            options = known[:, None] + self.cost
            np.fill_diagonal(options, np.inf)  # no segment is empty
            back.append(options.argmin(axis=0))
            known = options.min(axis=0)
        cuts, at = [], self.size
        for column in reversed(back):
            at = int(column[at])
            cuts.append(at)
        return float(known[self.size]), cuts[::-1]

    def least(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """No partition with a cut inside of a bucket, or at its left edge, costs less than this; per bucket."""
        out = np.where(self.inner, 0.0, np.inf)
        ahead = [self.cost[0]]  # by cut: up to the left edge of a bucket
        within = [self.cost[0][:-1] + out]
        behind = [self.cost[:, self.size]]
        for _ in range(k - 2):
            start = np.minimum(ahead[-1], np.concatenate(([np.inf], within[-1])))
            ahead.append((start[:, None] + self.cost).min(axis=0))
            within.append(np.minimum(ahead[-1][:-1], within[-1]) + out)
            end = np.minimum(behind[-1], np.concatenate((behind[-1][1:] + out, [np.inf])))
            behind.append((self.cost + end[None, :]).min(axis=1))
        inside = np.min([within[j] + behind[k - 2 - j][1:] for j in range(k - 1)], axis=0)
        return inside, np.min([ahead[j][:-1] + behind[k - 2 - j][:-1] for j in range(k - 1)], axis=0)


def _finer(sums: np.ndarray, closed: np.ndarray, kept: np.ndarray, split: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Left edges of the next buckets, and which of these hold no cut: buckets to split are cut evenly, and closed
    neighbours become one, if no cut is to be made between them."""
    parts = max(2, (BUCKETS - 2 * int((~closed).sum())) // len(split))
    edges, solid, cut = [], [], set(split.tolist())
    for i, row in enumerate(sums):
        if i and closed[i] and closed[i - 1] and not kept[i]:
            continue
        inner = np.linspace(row[4], row[5], parts + 1)[1:].tolist() if i in cut else []
        edges += [row[4] if i else -np.inf, *inner]
        solid += [bool(closed[i])] + [False] * len(inner)
    left, first = np.unique(edges, return_index=True)
    return left, np.array(solid)[first]


def least_cost(points: DataFrame, subset: int | None, counts: Sequence[int]) -> dict[int, tuple[np.ndarray, float, np.ndarray] | int]:
    """Per segment count the centres, the cost and the sizes of the cheapest partition, or how many distinct values there
    are if that is less than the count."""
    sums = _bucket_sums(points, subset, np.array([-np.inf]), 0.0)
    if not len(sums):
        return {k: 0 for k in counts}
    origin = float(sums[0, 2] / sums[0, 1])
    found: dict[int, tuple[np.ndarray, float, np.ndarray] | int] = {k: 1 for k in counts}
    closed, kept = sums[:, 4] == sums[:, 5], np.ones(1, bool)
    split = np.flatnonzero(~closed)
    while len(split):
        edges, solid = _finer(sums, closed, kept, split)
        sums = _bucket_sums(points, subset, edges, origin)
        solid = solid[sums[:, 0].astype(int)] | (sums[:, 4] == sums[:, 5])
        buckets, kept = _Buckets(sums, ~solid), np.zeros(len(sums), bool)
        hope = np.full(len(sums), np.inf)  # how far below the best known cost a cut inside might come
        for k in counts:
            if len(sums) < k:
                found[k], kept[:] = len(sums), True
                hope[~solid] = -np.inf
                continue
            cost, cuts = buckets.best(k)
            ends = np.array([0, *cuts, buckets.size])
            size, total = np.diff(buckets.n[ends]), np.diff(buckets.s[ends])
            found[k] = (origin + total / size)[:, None], cost, size
            noise = 1e-13 * buckets.cost[0, -1]
            inside, at = buckets.least(k)
            kept |= at <= cost + noise
            hope = np.where(inside < cost - noise, np.minimum(hope, inside - cost), hope)
        closed = hope == np.inf
        split = np.argsort(hope, kind="stable")[: min(int((~closed).sum()), max(1, BUCKETS // 4))]  # the most promising first
    return found
