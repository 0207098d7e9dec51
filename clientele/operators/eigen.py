"""Leading eigenvectors of similarity graphs by a block Krylov method; the graph is never stored.

All that the method needs of a graph is its product with a few vectors. A Spark task computes the affinities of its rows
with all rows, block by block, multiplies, and forgets them. The products of all graphs (a table's and its subsamples')
are one job per step. Rows, weights and vectors are what is broadcast; the caller bounds the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

BLOCK_CELLS = 2_000_000  # affinities that a task holds at a time
EXTRA = 4  # vectors of a block beyond those asked for
RESIDUAL = 1e-10
MOST_STEPS = 60


def affinity(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    squares = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.exp(-gamma * np.maximum(squares, 0.0))


@dataclass
class Graph:
    """Distinct rows with weights: the graph has an edge of weight exp(-gamma d^2) between all customers."""

    rows: np.ndarray
    weights: np.ndarray

    @property
    def gamma(self) -> float:
        return 1.0 / self.rows.shape[1]


@dataclass
class Eigen:
    values: np.ndarray  # descending
    vectors: np.ndarray
    root: np.ndarray  # square roots of weight over degree
    residuals: np.ndarray


def affinity_products(spark: SparkSession, graphs: Sequence[Graph], factors: Sequence[np.ndarray | None]) -> list[np.ndarray | None]:
    """Affinity matrix times factor for every graph that has one, in one job."""
    shared = spark.sparkContext.broadcast([(g.rows, g.gamma, f) if f is not None else None for g, f in zip(graphs, factors)])

    def product(batches):
        for batch in batches:
            which, first, past = (batch.column(i).to_pylist() for i in range(3))
            for g, begin, end in zip(which, first, past):
                rows, gamma, factor = shared.value[g]
                own = affinity(rows[begin:end], rows, gamma) @ factor
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), g)), pa.array(np.arange(begin, end)), pa.array(list(own), pa.list_(pa.float64()))], ["graph", "row", "values"]
                )

    pieces = []
    for g, (graph, factor) in enumerate(zip(graphs, factors)):
        n = len(graph.rows)
        step = max(1, min(BLOCK_CELLS // max(n, 1), -(-n // 4)))
        pieces += [(g, at, min(at + step, n)) for at in range(0, n, step)] if factor is not None else []
    work = spark.createDataFrame(pieces, "graph long, first long, past long").repartition(min(len(pieces), spark.sparkContext.defaultParallelism))
    table = work.mapInArrow(product, "graph long, row long, values array<double>").toArrow()
    shared.unpersist()
    graph, row = (table.column(i).to_numpy() for i in (0, 1))
    values = table.column(2).combine_chunks()
    flat, ends = values.flatten().to_numpy(), np.concatenate([[0], np.cumsum(values.value_lengths().to_numpy())])
    out: list[np.ndarray | None] = []
    for g, factor in enumerate(factors):
        if factor is None:
            out.append(None)
            continue
        mine = np.flatnonzero(graph == g)
        mine = mine[np.argsort(row[mine])]
        own = np.empty((len(mine), factor.shape[1]))
        for i, at in enumerate(mine.tolist()):
            own[i] = flat[ends[at] : ends[at + 1]]
        out.append(own)
    return out


class _Krylov:
    """One graph's growing orthonormal basis and its products."""

    def __init__(self, graph: Graph, degree: np.ndarray, wanted: int, seed: int) -> None:
        self.wanted = min(wanted, len(graph.rows))
        self.root = np.sqrt(graph.weights / degree)
        size = min(self.wanted + EXTRA, len(graph.rows))
        start = np.random.default_rng(seed).normal(size=(len(graph.rows), size))
        start[:, 0] = np.sqrt(graph.weights * degree)  # the first eigenvector
        self.basis = np.empty((len(graph.rows), 0))
        self.images = np.empty((len(graph.rows), 0))
        self.block = self._fresh(start)
        self.found: Eigen | None = None

    def _fresh(self, vectors: np.ndarray) -> np.ndarray:
        """Orthonormal directions of ``vectors`` beyond the basis; what is left of a vector in rounding errors is none."""
        scale = np.linalg.norm(vectors, axis=0).max(initial=1e-300)
        for _ in range(2):  # once loses digits
            vectors = vectors - self.basis @ (self.basis.T @ vectors)
        found, size, _ = np.linalg.svd(vectors, full_matrices=False)
        found = found[:, size > 1e-12 * scale][:, : len(self.basis) - self.basis.shape[1]]
        return np.linalg.qr(found - self.basis @ (self.basis.T @ found))[0]

    def advance(self, product: np.ndarray) -> None:
        """Take in the affinity's product with root x block, and see how good the best vectors of the basis are."""
        image = self.root[:, None] * product
        self.basis, self.images = np.hstack([self.basis, self.block]), np.hstack([self.images, image])
        small = self.basis.T @ self.images
        values, inner = np.linalg.eigh((small + small.T) / 2)
        top = np.argsort(values)[::-1][: self.wanted]
        values, vectors = values[top], self.basis @ inner[:, top]
        residuals = np.linalg.norm(self.images @ inner[:, top] - vectors * values, axis=0)
        self.found = Eigen(values, vectors, self.root, residuals)
        self.block = self._fresh(image)

    @property
    def done(self) -> bool:
        if self.found is None:
            return False
        whole = not self.block.shape[1] or self.basis.shape[1] >= len(self.basis)
        return whole or (len(self.found.values) == self.wanted and bool((self.found.residuals < RESIDUAL).all()))


def leading_eigenvectors(spark: SparkSession, graphs: Sequence[Graph], wanted: int, seed: int = 42) -> list[Eigen]:
    """The ``wanted`` largest eigenvalues of every graph's normalised affinity, with vectors and residuals."""
    degrees = affinity_products(spark, graphs, [g.weights[:, None] for g in graphs])
    states = [_Krylov(g, d[:, 0], wanted, seed) for g, d in zip(graphs, degrees)]
    for _ in range(MOST_STEPS):
        factors = [None if s.done else s.root[:, None] * s.block for s in states]
        if all(f is None for f in factors):
            break
        for state, product in zip(states, affinity_products(spark, graphs, factors)):
            if product is not None:
                state.advance(product)
    return [s.found for s in states]
