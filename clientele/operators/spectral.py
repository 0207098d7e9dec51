"""Spectral clustering of the full similarity graph, or of landmark customers (Nyström extension).

The similarity graph is never built. For a table of at most ``spectral_exact`` distinct rows its leading eigenvectors come
from products with it (``eigen.py``). Beyond that at most ``landmarks`` rows, drawn from the whole table where it is spread
out (``seeds.py``) and weighted by the customers nearest to them, give a landmark x landmark affinity. Either way the
eigenvectors are extended to every customer as a projection, and K-means runs on the embedding. Stability subsamples have
graphs or landmarks of their own.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.errors import DataProblem
from clientele.operators.eigen import Eigen, Graph, affinity, leading_eigenvectors
from clientele.operators.fits import Fit, FitSettings, check_k, check_realized, with_subsamples
from clientele.operators.kmeans import distinct_rows, fit_partitions, landmark_weights, nearest_centre, points_table, reused
from clientele.operators.seeds import candidates

EMBEDDED = "__embedding"
AFFINITIES_PER_BLOCK = 500_000  # that a task holds at a time


@dataclass
class _Basis:
    landmarks: np.ndarray
    weights: np.ndarray
    functions: np.ndarray  # weighted eigenfunctions at the landmarks, over their eigenvalues
    gamma: float


def _extended(rows: np.ndarray, weights: np.ndarray, values: np.ndarray, vectors: np.ndarray, root: np.ndarray) -> _Basis:
    """Eigenfunctions of the random walk over weighted rows, ready to be extended to any row."""
    functions = vectors * (root / np.maximum(weights, 1e-300))[:, None] * np.sqrt(weights.sum())
    return _Basis(rows, weights, weights[:, None] * functions / np.maximum(values, 1e-12), 1.0 / rows.shape[1])


def _landmark_basis(landmarks: np.ndarray, weights: np.ndarray, most: int) -> _Basis:
    own = affinity(landmarks, landmarks, 1.0 / landmarks.shape[1])
    root = np.sqrt(weights / (own @ weights))
    values, vectors = np.linalg.eigh(own * np.outer(root, root))
    top = np.argsort(values)[::-1][:most]
    return _extended(landmarks, weights, values[top], vectors[:, top], root)


def _embedding(basis: _Basis):
    landmarks, weights, functions, gamma = basis.landmarks, basis.weights, basis.functions, basis.gamma
    squares, doubled = (landmarks**2).sum(axis=1), -2 * landmarks.T
    block = max(1, AFFINITIES_PER_BLOCK // len(landmarks))

    @F.pandas_udf("array<double>")
    def embed(points: pd.Series) -> pd.Series:
        found: list[np.ndarray] = []
        for begin in range(0, len(points), block):
            rows = np.vstack(points.iloc[begin : begin + block].to_numpy())
            affinity = rows @ doubled
            affinity += squares
            affinity += (rows**2).sum(axis=1)[:, None]
            np.maximum(affinity, 0.0, out=affinity)
            affinity *= -gamma
            np.exp(affinity, out=affinity)
            own = np.maximum(affinity @ weights, 1e-300)
            found.extend(affinity @ functions / own[:, None])
        return pd.Series(found, dtype=object)

    return embed


class SpectralEmbedding:
    """Graph or landmarks of one prepared table, with fits on the full table and on its stability subsamples."""

    def __init__(self, frame: DataFrame, rows: int, seed: int, settings: FitSettings, repeats: int = 0):
        frame = with_subsamples(frame, repeats, seed)
        self._frame, self._rows, self._seed, self._settings = frame, rows, seed, settings
        self._sets: list[int | None] = [None, *range(repeats)]
        self._eigen: dict[int | None, Eigen] = {}
        known = distinct_rows(frame, self._sets, seed, settings.spectral_exact)
        self.exact = known is not None
        if known is not None:
            held = {s: known.counts[s] > 0 for s in self._sets}
            self._points = {s: known.points[held[s]] for s in self._sets}
            self._weights = {s: known.counts[s][held[s]] for s in self._sets}
        else:
            with reused(points_table(frame, repeats, seed)) as points:
                self._points = candidates(points, self._sets, settings.landmarks, seed)
                counted = landmark_weights(points, self._points)
            self._weights = {s: np.maximum(counted[s], 1e-9) for s in self._sets}

    @property
    def detail(self) -> str:
        return "exact" if self.exact else f"{len(self._points[None])} landmarks"

    def eigen(self, most: int) -> dict[int | None, Eigen]:
        """Leading eigenvectors of the full graph of every subset, for a table with few distinct rows."""
        if any(len(e.values) < min(most, len(e.vectors)) for e in self._eigen.values()) or not self._eigen:
            graphs = [Graph(self._points[s], self._weights[s]) for s in self._sets]
            self._eigen = dict(zip(self._sets, leading_eigenvectors(self._frame.sparkSession, graphs, most, self._seed)))
        return self._eigen

    def _basis(self, repeat: int | None, most: int) -> _Basis:
        rows, weights = self._points[repeat], self._weights[repeat]
        if not self.exact:
            return _landmark_basis(rows, weights, most)
        found = self.eigen(most)[repeat]
        return _extended(rows, weights, found.values[:most], found.vectors[:, :most], found.root)

    def fits(self, counts: Sequence[int], repeat: int | None = None) -> dict[int, Fit | DataProblem]:
        """One fit per segment count. The embedding is computed once for all of them and dropped afterwards."""
        points = self._points[repeat]
        table = self._frame if repeat is None else self._frame.filter(f"in_{repeat}")
        most = min(max(counts), len(points))
        embed = _embedding(self._basis(repeat, most))
        embedded = table.select("id", embed(vector_to_array("features")).alias(EMBEDDED))
        embedded = embedded.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            # Held until all counts are fitted: the affinities are computed once per subset.
            return {k: self._fit(k, most, embed, embedded, repeat) for k in counts}
        finally:
            embedded.unpersist()

    def _fit(self, k: int, most: int, embed, embedded: DataFrame, repeat: int | None) -> Fit | DataProblem:
        seed = self._seed if repeat is None else self._seed + repeat + 1
        try:
            check_k(k, self._rows)
            check_realized(min(k, most), k)
            chosen = array_to_vector(F.slice(EMBEDDED, 1, k)).alias("features")
            found = fit_partitions(embedded.select("id", chosen), [(k, None)], seed, self._settings)[(k, None)]
            if isinstance(found, DataProblem):
                return found
            check_realized(found[0].realized, k)
        except DataProblem as problem:
            return problem
        centres = found[0].centres

        def label(table: DataFrame, name: str) -> DataFrame:
            placed = table.withColumn("__spectral", array_to_vector(F.slice(embed(vector_to_array("features")), 1, k)))
            return nearest_centre(placed, centres, name, "__spectral").drop("__spectral")

        return Fit("spectral", k, label, detail=self.detail)
