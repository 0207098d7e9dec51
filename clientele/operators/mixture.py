"""Gaussian mixtures with full covariances, fitted by expectation-maximisation as a series of Spark aggregates.

As with K-means, one pass over the table advances all unfinished mixtures: every segment count, start and stability
subsample. Tasks turn their rows into sums per component, Spark adds the sums up, and 1 + p + p² numbers per component
reach the driver. Starts come from K-means partitions, and a small ridge keeps covariances invertible.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.errors import DataProblem
from clientele.operators.fits import Fit, FitSettings, check_k, check_realized
from clientele.operators.kmeans import (
    OWNER_SCHEMA,
    POINT,
    Partition,
    added,
    fit_partitions,
    owner_rows,
    points_table,
    reused,
)

RIDGE = 1e-6
TOLERANCE = 1e-3  # change of the mean log-likelihood per customer
BLOCK_ROWS = 4096
NUMBERS_PER_PASS = 500_000


@dataclass
class _Climb:
    """One mixture on its way up."""

    key: tuple
    subsample: int | None
    centres: np.ndarray
    rows: int
    weights: np.ndarray | None = None  # None until the hard K-means assignment has been turned into a mixture
    covariances: np.ndarray | None = None
    before: float = -math.inf
    converged: bool = False
    finished: bool = False
    likelihood: float = -math.inf
    won: np.ndarray | None = None
    failed: bool = False

    def scorer(self):
        """Arrays that score rows: centres alone for the hard start, whitened components afterwards."""
        if self.weights is None:
            return None, None
        p = self.centres.shape[1]
        factors = np.stack([np.linalg.inv(np.linalg.cholesky(c)).T for c in self.covariances])
        log_det = np.log(np.abs(np.diagonal(factors, axis1=1, axis2=2))).sum(axis=1)
        return factors, log_det + np.log(self.weights) - 0.5 * p * math.log(2 * math.pi)

    def update(self, mass: np.ndarray, first: np.ndarray, second: np.ndarray) -> None:
        """New parameters from sums about the current centres, which keeps the covariances well conditioned."""
        mass = mass + 10 * np.finfo(float).eps
        shift = first / mass[:, None]
        spread = second / mass[:, None, None] - shift[:, :, None] * shift[:, None, :]
        self.covariances = spread + RIDGE * np.eye(first.shape[1])
        self.centres = self.centres + shift
        self.weights = mass / mass.sum()


def _make_share():
    """Responsibilities and log densities of rows, as a closure that travels to Python workers by value."""

    def share(rows, centres, factors, constants):
        if factors is None:
            away = np.stack([((rows - c) ** 2).sum(axis=1) for c in centres], axis=1)
            return np.eye(len(centres))[away.argmin(axis=1)], np.zeros(len(rows))
        logs = np.stack(
            [c - 0.5 * (((rows - m) @ f) ** 2).sum(axis=1) for m, f, c in zip(centres, factors, constants)], axis=1
        )
        top = logs.max(axis=1, keepdims=True)
        density = top[:, 0] + np.log(np.exp(logs - top).sum(axis=1))
        return np.exp(logs - density[:, None]), density

    return share


def _step(points: DataFrame, climbs: Sequence[_Climb]) -> list[tuple]:
    """Per mixture: log-likelihood, mass, rows won, first and second sums about its centres; one pass for all."""
    work = [(c.subsample, c.centres, *c.scorer()) for c in climbs]
    width = climbs[0].centres.shape[1]
    share, column_name, block = _make_share(), POINT, BLOCK_ROWS

    def partial(batches):
        totals = [
            (np.zeros(1), np.zeros(len(c)), np.zeros(len(c)), np.zeros(c.shape), np.zeros((len(c), width, width)))
            for _, c, _, _ in work
        ]
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.column(column_name).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            for (subsample, centres, factors, constants), (likelihood, mass, won, first, second) in zip(work, totals):
                chosen = rows
                if subsample is not None:
                    chosen = rows[batch.column(f"in_{subsample}").to_numpy(zero_copy_only=False).astype(bool)]
                for begin in range(0, len(chosen), block):
                    part = chosen[begin : begin + block]
                    portion, density = share(part, centres, factors, constants)
                    likelihood += density.sum()
                    mass += portion.sum(axis=0)
                    won += np.bincount(portion.argmax(axis=1), minlength=len(centres))
                    for j, centre in enumerate(centres):
                        gap = part - centre
                        weighted = portion[:, j, None] * gap
                        first[j] += weighted.sum(axis=0)
                        second[j] += weighted.T @ gap
        yield owner_rows([np.concatenate([x.ravel() for x in total]) for total in totals])

    masks = sorted({s for s, *_ in work if s is not None})
    table = points.select(POINT, *[f"in_{r}" for r in masks])
    sizes = [len(c) for _, c, _, _ in work]
    totals = added(table.mapInArrow(partial, OWNER_SCHEMA), len(work))
    return [
        (
            t[0],
            t[1 : 1 + k],
            t[1 + k : 1 + 2 * k],
            t[1 + 2 * k : 1 + 2 * k + k * width].reshape(k, width),
            t[1 + 2 * k + k * width :].reshape(k, width, width),
        )
        for t, k in zip(totals, sizes)
    ]


def _climb_all(points: DataFrame, climbs: Sequence[_Climb], max_iterations: int) -> None:
    waves: list[list[_Climb]] = [[]]
    for climb in climbs:
        cost = climb.centres.size * climb.centres.shape[1]
        if waves[-1] and sum(c.centres.size * c.centres.shape[1] for c in waves[-1]) + cost > NUMBERS_PER_PASS:
            waves.append([])
        waves[-1].append(climb)
    for wave in waves:
        active = list(wave)
        # One pass for the hard start, one after the last update for the final likelihood.
        for _ in range(max_iterations + 2):
            for climb in active:
                try:
                    climb.scorer()
                except np.linalg.LinAlgError:
                    climb.failed = climb.finished = True
            active = [c for c in active if not c.finished]
            if not active:
                break
            for climb, (likelihood, mass, won, first, second) in zip(active, _step(points, active)):
                if climb.converged:
                    climb.likelihood, climb.won, climb.finished = likelihood, won, True
                    continue
                hard = climb.weights is None
                climb.update(mass, first, second)
                if not hard:
                    climb.converged = abs(likelihood / climb.rows - climb.before) < TOLERANCE
                    climb.before = likelihood / climb.rows


def mixture_minimum_rows(k: int, columns: int) -> int:
    return k * max(30, 5 * columns)


def check_mixture_rows(rows: int, k: int, columns: int) -> None:
    needed = mixture_minimum_rows(k, columns)
    if rows < needed:
        raise DataProblem(
            f"A full-covariance mixture of {k} groups over {columns} model columns needs {needed} customers or more."
        )


def fit_mixtures(
    frame: DataFrame,
    wanted: Sequence[tuple[int, int | None]],
    sizes: dict[int | None, int],
    columns: int,
    seed: int,
    settings: FitSettings,
    subsamples: int = 0,
    partitions: dict[tuple[int, int | None], list[Partition] | DataProblem] | None = None,
) -> dict[tuple[int, int | None], Fit | DataProblem]:
    """One fit, or the reason there is none, per ``(k, subsample)``; ``sizes`` holds the rows of each subsample."""
    results: dict[tuple[int, int | None], Fit | DataProblem] = {}
    able = []
    for k, subsample in wanted:
        try:
            check_k(k, sizes[subsample])
            check_mixture_rows(sizes[subsample], k, columns)
            able.append((k, subsample))
        except DataProblem as problem:
            results[(k, subsample)] = problem
    if not able:
        return results
    missing = [key for key in able if partitions is None or key not in partitions]
    known = dict(partitions or {})
    if missing:
        known.update(fit_partitions(frame, missing, seed, settings, subsamples))
    climbs = []
    for key in able:
        found = known[key]
        if isinstance(found, DataProblem):
            results[key] = found
            continue
        whole = different([p for p in found if p.realized == key[0]])[: settings.gmm_starts]
        if not whole:
            results[key] = DataProblem(f"The fit produced {found[0].realized} distinct groups instead of the requested {key[0]}.")
        climbs += [_Climb(key, key[1], p.centres, sizes[key[1]]) for p in whole]
    with reused(points_table(frame, subsamples, seed)) as points:
        _climb_all(points, climbs, settings.max_iterations)
    for key in able:
        own = [c for c in climbs if c.key == key]
        if own:
            results[key] = _outcome(key[0], own, settings)
    return results


def different(partitions: Sequence[Partition]) -> list[Partition]:
    """Partitions, cheapest first, without those that ended where another did: the starts of a mixture are distinct."""
    kept: list[Partition] = []
    for own in partitions:
        if all(abs(own.cost - other.cost) > 1e-6 * max(other.cost, 1e-12) for other in kept):
            kept.append(own)
    return kept


def _outcome(k: int, climbs: Sequence[_Climb], settings: FitSettings) -> Fit | DataProblem:
    usable = [c for c in climbs if not c.failed]
    if not usable:
        return DataProblem("Its covariances or distances could not be computed.")
    best = max(usable, key=lambda c: c.likelihood)
    if not best.finished:
        return DataProblem("The likelihood was still rising after the last allowed step.")
    try:
        check_realized(int((best.won > 0).sum()), k)
    except DataProblem as problem:
        return problem
    factors, constants = best.scorer()
    centres, share = best.centres, _make_share()

    @F.pandas_udf("struct<place:int,share:double>")
    def most_likely(batch: pd.Series) -> pd.DataFrame:
        if not len(batch):
            return pd.DataFrame({"place": np.array([], "int32"), "share": np.array([], float)})
        portion, _ = share(np.vstack(batch.to_numpy()), centres, factors, constants)
        return pd.DataFrame({"place": portion.argmax(axis=1).astype("int32"), "share": portion.max(axis=1)})

    def label(table: DataFrame, name: str) -> DataFrame:
        return table.withColumn(name, most_likely(vector_to_array("features")).getField("place"))

    def posterior(table: DataFrame, name: str) -> DataFrame:
        return table.withColumn(name, most_likely(vector_to_array("features")).getField("share"))

    return Fit("gmm", k, label, posterior, float(best.likelihood), f"{len(climbs)} start{'s'[: len(climbs) != 1]}")


def fit_gmm(frame: DataFrame, rows: int, k: int, seed: int, settings: FitSettings, columns: int) -> Fit:
    """A single fit on the full table."""
    check_k(k, rows)
    found = fit_mixtures(frame, [(k, None)], {None: rows}, columns, seed, settings)[(k, None)]
    if isinstance(found, DataProblem):
        raise found
    return found


def information_criteria(log_likelihood: float, k: int, columns: int, rows: int) -> tuple[float, float]:
    """BIC and AIC of a full-covariance mixture."""
    free = k * columns * (columns + 1) / 2 + k * columns + k - 1
    return -2 * log_likelihood + free * math.log(rows), -2 * log_likelihood + 2 * free
