"""K-means for many starts, segment counts and subsamples at once.

A comparison needs hundreds of K-means fits on the same rows: several starts, for several segment counts, on the full
table and on every stability subsample. Fitting them one by one would read the table thousands of times. Here one pass
over the table advances *all* unfinished fits by one Lloyd step: a task computes the distances of its rows to all
centres with one matrix product, and returns per fit its cost, counts and sums, which Spark adds up by fit. The driver
sees k × (p + 1) numbers per fit.

Starts are k-means++ draws over weighted candidates of the whole table (``seeds.py``); every clearly different one is then
advanced on all rows. Draws and subsamples depend on customer ids alone: a result does not change with partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.errors import DataProblem
from clientele.functions.geometry import INLINE_TERMS, with_distances
from clientele.functions.nearest import CELLS_PER_BLOCK, LEAF_COLUMNS, Leaves, gathered
from clientele.operators.fits import Fit, FitSettings, check_k, check_realized, with_subsamples
from clientele.operators.line import least_cost
from clientele.operators.seeds import candidates, settle, spread_seeds

POINT = "point"
NUMBERS_PER_PASS = 200_000  # centre coordinates advanced together
ROWS_PER_BLOCK = 4096
FEW_CENTRES = 32  # up to which rows are added up by matrix products
FEW_TASKS = 64  # whose arrays the driver adds itself
MEETING = 1e-2  # share of the convergence tolerance within which two starts are one
CANDIDATES_PER_GROUP = 20
LEAST_CANDIDATES = 200


@dataclass
class Partition:
    """One fitted K-means: centres with the cost and the counts they give."""

    centres: np.ndarray
    cost: float
    counts: np.ndarray
    converged: bool = True

    @property
    def realized(self) -> int:
        return int((self.counts > 0).sum())


@dataclass
class _Start:
    key: tuple
    subsample: int | None
    centres: np.ndarray
    result: Partition | None = None
    slack: float = 1.0  # allowed shift, in tolerances
    ahead: "_Start | None" = None  # the start that this one has met


def points_table(frame: DataFrame, subsamples: int = 0, seed: int = 42) -> DataFrame:
    """Rows as arrays, with one membership column per stability subsample."""
    frame = with_subsamples(frame, subsamples, seed)
    return frame.select("id", vector_to_array("features").alias(POINT), *[f"in_{r}" for r in range(subsamples)])


@contextmanager
def reused(points: DataFrame) -> Iterator[DataFrame]:
    """Points that many passes read: rows are turned into arrays, and draws into memberships, once."""
    kept = points.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()


def distinct_starts(
    points: np.ndarray, weights: np.ndarray, k: int, starts: int, seed: int, tolerance: float
) -> list[np.ndarray]:
    """All clearly different outcomes of many seeded starts over the candidates, cheapest first."""
    if len(points) < k:
        raise DataProblem(f"The fit produced {len(points)} distinct groups instead of the requested {k}.")
    found = []
    for start in range(starts):
        rng = np.random.default_rng([seed, k, start])
        found.append(settle(points, weights, spread_seeds(points, weights, k, rng), tolerance))
    found.sort(key=lambda item: item[1])
    kept: list[tuple[np.ndarray, float]] = []
    for centres, cost in found:
        if all(abs(cost - other) > 1e-6 * max(other, 1e-12) for _, other in kept):
            kept.append((centres, cost))
    return [centres for centres, _ in kept]


# ---------------------------------------------------------------------------------------------- Lloyd steps, on Spark


def _step(points: DataFrame, starts: Sequence[_Start]) -> list[tuple[float, np.ndarray, np.ndarray, np.ndarray]]:
    """Cost, counts, sums and the row farthest from its centre, of every start over the whole table in one pass."""
    by_subsample: dict[int | None, list[tuple[int, np.ndarray]]] = {}
    for index, start in enumerate(starts):
        by_subsample.setdefault(start.subsample, []).append((index, start.centres))
    shapes = [start.centres.shape for start in starts]
    width = shapes[0][1]
    cells, most, few, column_name = CELLS_PER_BLOCK, ROWS_PER_BLOCK, FEW_CENTRES, POINT
    cut = max(k for k, _ in shapes) > few and width <= LEAF_COLUMNS

    def partial(batches):
        cost = [0.0] * len(shapes)
        counts = [np.zeros(k) for k, _ in shapes]
        sums = [np.zeros(shape) for shape in shapes]
        far = [np.zeros(width + 1) for _ in shapes]
        norms = {index: (centres**2).sum(axis=1)[:, None] for members in by_subsample.values() for index, centres in members}
        largest = max(k for k, _ in shapes)
        block = max(1, min(most, cells // largest))
        for batch in gathered(batches) if cut else batches:
            if not batch.num_rows:
                continue
            rows = batch.column(column_name).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            leaves = Leaves(rows) if cut else None
            for subsample, members in by_subsample.items():
                inside = None
                if subsample is not None:
                    inside = batch.column(f"in_{subsample}").to_numpy(zero_copy_only=False).astype(bool)
                if cut:
                    inside = slice(None) if inside is None else inside[leaves.order]
                    chosen = leaves.rows[inside]
                    squares = (chosen**2).sum(axis=1)
                    for index, centres in members if len(chosen) else ():
                        label, nearest = (found[inside] for found in leaves.nearest(centres))
                        counts[index] += np.bincount(label, minlength=len(centres))
                        for d in range(width):
                            sums[index][:, d] += np.bincount(label, weights=chosen[:, d], minlength=len(centres))
                        gap = np.maximum(nearest + squares, 0)
                        cost[index] += float(gap.sum())
                        worst = int(gap.argmax())
                        if gap[worst] > far[index][0]:
                            far[index] = np.concatenate(([gap[worst]], chosen[worst]))
                    continue
                chosen = rows if inside is None else rows[inside]
                for begin in range(0, len(chosen), block):
                    part = chosen[begin : begin + block]
                    squares = (part**2).sum(axis=1)
                    columns = np.ascontiguousarray(part.T)
                    counted = np.column_stack((np.ones(len(part)), part))
                    for index, centres in members:
                        k = len(centres)
                        gaps = (-2 * centres) @ columns
                        gaps += norms[index]
                        nearest = gaps.min(axis=0)
                        hot = (gaps == nearest).astype(float) if k <= few else None
                        if hot is None or hot.sum() != len(part):  # many centres, or a row amid two of them
                            label = gaps.argmin(axis=0)
                            counts[index] += np.bincount(label, minlength=k)
                            for d in range(width):
                                sums[index][:, d] += np.bincount(label, weights=part[:, d], minlength=k)
                        else:
                            added = hot @ counted
                            counts[index] += added[:, 0]
                            sums[index] += added[:, 1:]
                        gap = np.maximum(nearest + squares, 0)
                        cost[index] += float(gap.sum())
                        worst = int(gap.argmax())
                        if gap[worst] > far[index][0]:
                            far[index] = np.concatenate(([gap[worst]], part[worst]))
        numbers = [np.concatenate(([c], n, s.ravel(), f)) for c, n, s, f in zip(cost, counts, sums, far)]
        yield owner_rows(numbers)

    masks = sorted({s for s in by_subsample if s is not None})
    table = points.select(POINT, *[f"in_{r}" for r in masks])
    tail = width + 1
    totals = added(table.mapInArrow(partial, OWNER_SCHEMA), len(shapes), tail)
    return [(t[0], t[1 : 1 + k], t[1 + k : 1 + k + k * p].reshape(k, p), t[1 + k + k * p :]) for t, (k, p) in zip(totals, shapes)]


OWNER_SCHEMA = "owner int, numbers array<double>"


def owner_rows(numbers: Sequence[np.ndarray]) -> pa.RecordBatch:
    """One row per fit and task, whatever the model's size."""
    return pa.RecordBatch.from_arrays(
        [pa.array(np.arange(len(numbers), dtype="int32")), pa.array(list(numbers), pa.list_(pa.float64()))], ["owner", "numbers"]
    )


def _merged(one: np.ndarray | None, other: np.ndarray, tail: int) -> np.ndarray:
    """Element-wise sum; the last ``tail`` numbers are (size, payload) of which the larger one stays."""
    if one is None:
        return other
    total = one + other
    if tail:
        total[-tail:] = one[-tail:] if one[-tail] >= other[-tail] else other[-tail:]
    return total


def added(partials: DataFrame, owners: int, tail: int = 0) -> list[np.ndarray]:
    """Sums of the tasks' arrays per owner: first within about the square root of the tasks' number of groups, then on
    the driver, which sees one array per group and owner. The arrays of a few tasks go to the driver at once."""
    merge = _merged
    tasks = partials._jdf.queryExecution().toRdd().getNumPartitions()

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            lists = batch.column(1)
            for i, owner in enumerate(batch.column(0).to_pylist()):
                held[owner] = merge(held.get(owner), np.array(lists[i].values.to_numpy(zero_copy_only=False)), tail)
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.int32()), pa.array(list(held.values()), pa.list_(pa.float64()))], ["owner", "numbers"]
            )

    if tasks <= FEW_TASKS:
        table = partials.toArrow()
    else:
        groups = math.isqrt(tasks)
        grouped = partials.withColumn("bunch", F.pmod(F.spark_partition_id(), F.lit(groups))).repartition(F.col("owner"), F.col("bunch"))
        table = grouped.select("owner", "numbers").mapInArrow(add, OWNER_SCHEMA).toArrow()
    found: list[np.ndarray | None] = [None] * owners
    order = np.argsort(table.column("owner").to_numpy(), kind="stable")
    lists = table.column("numbers").combine_chunks()
    for i in order.tolist():
        owner = table.column("owner")[i].as_py()
        found[owner] = _merged(found[owner], np.array(lists[i].values.to_numpy(zero_copy_only=False)), tail)
    return found


def met(starts: Sequence[_Start], tolerance: float) -> list[_Start]:
    """Starts of one fit whose centres have come together, but for what convergence allows, go on as one."""
    left: dict[tuple, list[tuple[_Start, np.ndarray]]] = {}
    for start in starts:
        own = start.centres[np.lexsort(start.centres.T[::-1])]
        for other, centres in left.setdefault(start.key, []):
            if ((own - centres) ** 2).sum() <= MEETING * tolerance * start.slack:
                start.ahead = other
                break
        else:
            left[start.key].append((start, own))
    return [start for held in left.values() for start, _ in held]


def polish(points: DataFrame, starts: Sequence[_Start], tolerance: float, max_iterations: int) -> None:
    """Advance all starts to convergence; each pass over the table serves every unfinished start."""
    waves: list[list[_Start]] = [[]]
    for start in starts:
        if waves[-1] and sum(s.centres.size for s in waves[-1]) + start.centres.size > NUMBERS_PER_PASS:
            waves.append([])
        waves[-1].append(start)
    for wave in waves:
        active = list(wave)
        for _ in range(max_iterations):
            if not active:
                break
            unfinished = []
            for start, (cost, counts, sums, far) in zip(active, _step(points, active)):
                moved = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], start.centres)
                empty = np.flatnonzero(counts == 0)
                if len(empty) and far[0] > 0:
                    moved[empty[0]] = far[1:]  # the row that its centre serves worst founds the missing group
                done = ((moved - start.centres) ** 2).sum() <= tolerance * start.slack
                start.result = Partition(start.centres, cost, counts, done)
                if not done:
                    start.centres = moved
                    unfinished.append(start)
            active = met(unfinished, tolerance)
        for start in wave:
            last = start
            while last.ahead is not None:
                last = last.ahead
            start.result = last.result


def fit_partitions(
    frame: DataFrame,
    wanted: Sequence[tuple[int, int | None]],
    seed: int,
    settings: FitSettings,
    subsamples: int = 0,
    every: bool = True,
) -> dict[tuple[int, int | None], list[Partition] | DataProblem]:
    """All different partitions, cheapest first, for each ``(k, subsample)``; subsample None is the full table.

    Full table and subsamples get the same number of starts, each from candidates of its own rows. A single column has a
    partition of least cost that needs no start (``line.py``); it leads, and without ``every`` it is the only one.
    """
    with reused(points_table(frame, subsamples, seed)) as points:
        return _partitions(points, wanted, seed, settings, every)


def _partitions(
    points: DataFrame, wanted: Sequence[tuple[int, int | None]], seed: int, settings: FitSettings, every: bool
) -> dict[tuple[int, int | None], list[Partition] | DataProblem]:
    most = max(k for k, _ in wanted)
    sets = list(dict.fromkeys(s for _, s in wanted))
    head = points.select(POINT).first()
    along = line_partitions(points, wanted) if head is not None and len(head[POINT]) == 1 else {}
    if along and not every:
        return {key: found if isinstance(found, DataProblem) else [found] for key, found in along.items()}
    drawn = candidates(points, sets, max(LEAST_CANDIDATES, CANDIDATES_PER_GROUP * most), seed)
    shares = _step(points, [_Start((s,), s, drawn[s]) for s in sets if len(drawn[s])])
    weights = dict(zip([s for s in sets if len(drawn[s])], (counts for _, counts, _, _ in shares)))
    starts: list[_Start] = []
    results: dict[tuple[int, int | None], list[Partition] | DataProblem] = {}
    tolerances = []
    for k, subsample in wanted:
        rows, own = drawn[subsample], weights.get(subsample)
        shifted = seed if subsample is None else seed + subsample + 1
        try:
            if not len(rows):
                raise DataProblem(f"Fewer than {k} customers are left for {k} segments.")
            mean = np.average(rows, axis=0, weights=own)
            tolerance = settings.shift_tolerance * float(np.average((rows - mean) ** 2, axis=0, weights=own).mean())
            tolerances.append(tolerance)
            for centres in distinct_starts(rows, own, k, settings.kmeans_starts, shifted, tolerance):
                starts.append(_Start((k, subsample), subsample, centres))
        except DataProblem as problem:
            results[(k, subsample)] = problem
    polish(points, starts, min(tolerances, default=0.0), settings.max_iterations)
    for start in starts:
        results.setdefault(start.key, []).append(start.result)
    for key, found in results.items():
        if isinstance(found, list):
            if isinstance(along.get(key), Partition):
                found.append(along[key])
            found.sort(key=lambda partition: (-partition.realized, partition.cost))
    return results


def line_partitions(points: DataFrame, wanted: Sequence[tuple[int, int | None]]) -> dict[tuple[int, int | None], Partition | DataProblem]:
    """The partition of least cost for each ``(k, subsample)`` of a table with a single column."""
    found: dict[tuple[int, int | None], Partition | DataProblem] = {}
    for subset in dict.fromkeys(s for _, s in wanted):
        counts = [k for k, s in wanted if s == subset]
        for k, best in least_cost(points, subset, counts).items():
            if isinstance(best, int):
                found[(k, subset)] = DataProblem(f"The fit produced {best} distinct groups instead of the requested {k}.")
            else:
                found[(k, subset)] = Partition(*best)
    return found


def fit_cells(
    frame: DataFrame, cells: int, subsets: Sequence[int | None], seed: int, settings: FitSettings
) -> dict[int | None, Partition]:
    """One partition into up to ``cells`` cells per subset (full table: None), all advanced in shared passes.

    A table with no more distinct rows than cells gets a cell for each of them. A partition of thousands of cells is
    called converged when its centres move, on average, by no more than a few centres are allowed to in all.
    """
    most = max((s + 1 for s in subsets if s is not None), default=0)
    with reused(points_table(frame, most, seed)) as points:
        drawn = candidates(points, subsets, cells, seed)
        starts = [_Start((cells, s), s, drawn[s], slack=max(1.0, len(drawn[s]) / 4)) for s in subsets]
        spread = float(drawn[subsets[0]].var(axis=0).mean())
        polish(points, starts, settings.shift_tolerance * spread, settings.max_iterations)
    return {start.subsample: start.result for start in starts}


@dataclass
class DistinctRows:
    """All distinct rows of a table, ascending, and how many customers of each subset have them."""

    points: np.ndarray
    counts: dict[int | None, np.ndarray]


def distinct_rows(frame: DataFrame, subsets: Sequence[int | None], seed: int, most: int) -> DistinctRows | None:
    """The distinct rows of a table that has no more than ``most``; None for others.

    A sketch that needs no shuffle of rows turns large tables away; the count itself then decides.
    """
    masks = [s for s in subsets if s is not None]
    points = points_table(frame, max((s + 1 for s in masks), default=0), seed)
    if points.agg(F.approx_count_distinct(F.xxhash64(POINT), 0.02)).first()[0] > 1.2 * most:
        return None
    inside = [F.count_if(F.col(f"in_{s}")).alias(f"n_{s}") for s in masks]
    # At most one row more than the caller allows reaches the driver.
    found = points.groupBy(POINT).agg(F.count(F.lit(1)).alias("n"), *inside).limit(most + 1).collect()
    if not 0 < len(found) <= most:
        return None
    found.sort(key=lambda r: r[POINT])
    counts = {s: np.array([r["n" if s is None else f"n_{s}"] for r in found], dtype=float) for s in subsets}
    return DistinctRows(np.array([r[POINT] for r in found], dtype=float), counts)


def landmark_weights(points: DataFrame, landmarks: dict[int | None, np.ndarray]) -> dict[int | None, np.ndarray]:
    """Rows nearest to each landmark, per subset, in one pass."""
    found = _step(points, [_Start((s,), s, rows) for s, rows in landmarks.items()])
    return dict(zip(landmarks, (counts for _, counts, _, _ in found)))


def nearest_centre(frame: DataFrame, centres: np.ndarray, name: str, features: str = "features") -> DataFrame:
    """Add the zero-based index of the nearest centre."""
    if centres.size > INLINE_TERMS:
        return frame.withColumn(name, _nearest_in_batches(centres)(vector_to_array(features)))
    scratch = f"__away_{name}"
    away = F.col(scratch)
    nearest = (F.array_position(away, F.array_min(away)) - 1).cast("int")
    return with_distances(frame, centres, scratch, features).withColumn(name, nearest).drop(scratch)


def _nearest_in_batches(centres: np.ndarray):
    squares, doubled = (centres**2).sum(axis=1), -2 * centres.T
    block = max(1, CELLS_PER_BLOCK // len(centres))

    @F.pandas_udf("int")
    def nearest(points: pd.Series) -> pd.Series:
        found = np.empty(len(points), "int32")
        if len(points) and centres.shape[1] <= LEAF_COLUMNS:
            leaves = Leaves(np.vstack(points.to_numpy()))
            found[leaves.order] = leaves.nearest(centres)[0]
            return pd.Series(found)
        for begin in range(0, len(points), block):
            gaps = np.vstack(points.iloc[begin : begin + block].to_numpy()) @ doubled
            gaps += squares
            found[begin : begin + block] = gaps.argmin(axis=1)
        return pd.Series(found)

    return nearest


def partition_fit(partition: Partition, k: int, detail: str) -> Fit:
    check_realized(partition.realized, k)
    if not partition.converged:
        detail += ", not converged"
    return Fit("kmeans", k, lambda table, name: nearest_centre(table, partition.centres, name), detail=detail)


def fit_kmeans(frame: DataFrame, rows: int, k: int, seed: int, settings: FitSettings) -> Fit:
    """A single fit on the full table."""
    check_k(k, rows)
    found = fit_partitions(frame, [(k, None)], seed, settings)[(k, None)]
    if isinstance(found, DataProblem):
        raise found
    return partition_fit(found[0], k, f"{settings.kmeans_starts} starts")
