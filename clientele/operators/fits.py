"""What a clustering fit is, how much work it may do, and the checks all methods share.

Every fit ends as a projection that adds a label column to the prepared table. The model behind it is small (centres,
mixture components, a merge tree over micro-clusters, landmark eigenvectors), so labelling a billion customers needs no
shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.errors import DataProblem

METHODS = {
    "kmeans": "K-means",
    "gmm": "Gaussian mixture",
    "hierarchical": "Hierarchical (Ward)",
    "spectral": "Spectral (flexible shapes)",
}
SUBSAMPLE_SHARE = 0.8
FEW_DRAWS = 4096  # draws that are looked at themselves


@dataclass(frozen=True)
class FitSettings:
    """Work per fit, the same for the full table and for every stability subsample."""

    kmeans_starts: int = 20
    gmm_starts: int = 5
    max_iterations: int = 500
    shift_tolerance: float = 1e-4  # squared shift of all centres, in mean column variances, at which K-means ends
    ward_exact: int = 5000  # distinct rows up to which a hierarchy is exact
    ward_cells: int = 2000  # cells of a larger table
    spectral_exact: int = 2500  # distinct rows up to which the whole similarity graph counts
    landmarks: int = 1000  # landmarks of a larger table
    max_segments: int = 50


@dataclass
class Fit:
    """A fitted candidate. ``label(frame, name)`` adds the label column to any table with ``features``."""

    algorithm: str
    k: int
    label: Callable[[DataFrame, str], DataFrame]
    posterior: Callable[[DataFrame, str], DataFrame] | None = None
    log_likelihood: float | None = None
    detail: str = "exact"


def check_k(k: int, rows: int) -> None:
    if k < 2 or k >= rows:
        raise DataProblem("The number of segments must be at least two and below the number of customers.")


def check_realized(found: int, k: int) -> None:
    if found != k:
        raise DataProblem(f"The fit produced {found} distinct groups instead of the requested {k}.")


def _draw(repeat: int, seed: int) -> Column:
    """A pseudo-random number of each customer for a subsample: it depends on the id only, so it survives any re-run."""
    return F.xxhash64(F.col("id").cast("string"), F.lit(seed), F.lit(repeat))


def subsample_size(rows: int, share: float = SUBSAMPLE_SHARE) -> int:
    return min(rows - 1, round(share * rows))


def smallest_draws(frame: DataFrame, repeats: int, seed: int, size: int, few: int = FEW_DRAWS) -> list[int]:
    """Per repeat the ``size``-th smallest draw of all customers.

    All repeats share passes that count draws by their leading bits, first of all draws, then of those in the range that
    holds the wanted place; a range with a few thousand draws is looked at itself. A pass brings at most 2^10 counts per
    repeat to the driver.
    """
    low, place, width = [-(2**63)] * repeats, [size] * repeats, [64] * repeats
    inside = [10**30] * repeats
    cuts: list[int | None] = [None] * repeats

    def ranges(todo: list[int]) -> DataFrame:
        own = [F.struct(F.lit(r).alias("repeat"), _draw(r, seed).alias("draw")) for r in todo]
        held = frame.select(F.inline(F.array(*own)))
        keep = F.lit(False)
        for r in todo:
            high = low[r] + 2 ** width[r] - 1
            keep = keep | ((F.col("repeat") == r) & F.col("draw").between(low[r], high))
        return held.filter(keep)

    while any(c is None for c in cuts):
        wide = [r for r in range(repeats) if cuts[r] is None and inside[r] > few and width[r] > 10]
        near = [r for r in range(repeats) if cuts[r] is None and r not in wide]
        if wide:
            shift = F.create_map(*[F.lit(x) for r in wide for x in (r, width[r] - 10)])[F.col("repeat")]
            counts = ranges(wide).groupBy("repeat", F.call_function("shiftright", F.col("draw"), shift).alias("first"))
            found: dict[int, list[tuple[int, int]]] = {}
            for row in counts.agg(F.count(F.lit(1)).alias("n")).collect():
                found.setdefault(row["repeat"], []).append((row["first"], row["n"]))
            for r in wide:
                for first, n in sorted(found[r]):
                    if place[r] <= n:
                        width[r] -= 10
                        low[r], inside[r] = first << width[r], n
                        break
                    place[r] -= n
        if near:
            draws: dict[int, list[int]] = {}
            for row in ranges(near).collect():
                draws.setdefault(row["repeat"], []).append(row["draw"])
            for r in near:
                cuts[r] = sorted(draws[r])[place[r] - 1]
    return cuts


def with_subsamples(frame: DataFrame, repeats: int, seed: int, share: float = SUBSAMPLE_SHARE) -> DataFrame:
    """``frame`` with a column ``in_0``, ``in_1``, ... per stability subsample: each draws, without replacement, exactly
    the rounded share of the customers (and leaves one out at least)."""
    if all(f"in_{r}" in frame.columns for r in range(repeats)):
        return frame
    size = subsample_size(frame.count(), share)
    if size < 1:
        return frame.select("*", *[F.lit(False).alias(f"in_{r}") for r in range(repeats)])
    cuts = smallest_draws(frame, repeats, seed, size)
    return frame.select("*", *[(_draw(r, seed) <= F.lit(cut)).alias(f"in_{r}") for r, cut in enumerate(cuts)])
