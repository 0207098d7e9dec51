"""The comparison grid: fit every (method, segment count), collect the evidence, rank."""

from __future__ import annotations

import statistics
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientele.errors import DataProblem
from clientele.functions import rules
from clientele.operators import diagnostics as D
from clientele.operators.fits import (
    METHODS,
    Fit,
    FitSettings,
    check_k,
    with_subsamples,
)
from clientele.operators.kmeans import fit_partitions, partition_fit
from clientele.operators.mixture import fit_mixtures, information_criteria
from clientele.operators.solution import SegmentSolution, describe_solution
from clientele.operators.spectral import SpectralEmbedding
from clientele.operators.ward import WardHierarchy
from clientele.session import durable

DRIVER_THREADS = 4
PART_NUMBERS = 1_000_000  # feature values in a partition of the prepared table, where cores alone ask for fewer partitions

CANDIDATE_SCHEMA = T.StructType(
    [
        T.StructField("order", T.IntegerType()),
        T.StructField("algorithm_key", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("segments", T.IntegerType()),
        T.StructField("customers", T.LongType()),
        T.StructField("silhouette", T.DoubleType()),
        T.StructField("stability", T.DoubleType()),
        T.StructField("stability_std", T.DoubleType()),
        T.StructField("stability_repeats", T.IntegerType()),
        T.StructField("stability_successful_repeats", T.IntegerType()),
        T.StructField("calinski_harabasz", T.DoubleType()),
        T.StructField("davies_bouldin", T.DoubleType()),
        T.StructField("smallest_segment_%", T.DoubleType()),
        T.StructField("smallest_segment_customers", T.LongType()),
        T.StructField("largest_segment_%", T.DoubleType()),
        T.StructField("balance", T.DoubleType()),
        T.StructField("bic", T.DoubleType()),
        T.StructField("aic", T.DoubleType()),
        T.StructField("method_detail", T.StringType()),
        T.StructField("cross_method_agreement", T.DoubleType()),
    ]
)
FAILURE_SCHEMA = "method string, segments int, reason string"


@dataclass(frozen=True)
class GridPlan:
    """What to compare by default for a table, and what to warn about."""

    algorithms: tuple[str, ...]
    k_values: tuple[int, ...]
    warnings: tuple[str, ...]


def plan_grid(
    customers: int,
    categorical: bool = False,
    binary_numeric: bool = False,
    k_values: Sequence[int] | None = None,
    ward_up_to: int | None = None,
) -> GridPlan:
    """Default methods and segment counts.

    Mixtures are left out when a basis is categorical or binary. Ward is compared at any size; ``ward_up_to`` leaves it out
    beyond so many customers.
    """
    algorithms = ["kmeans"]
    if not (categorical or binary_numeric):
        algorithms.append("gmm")
    if ward_up_to is None or customers <= ward_up_to:
        algorithms.append("hierarchical")
    most = min(FitSettings().max_segments, customers - 1)
    chosen = tuple(sorted(set(k_values))) if k_values is not None else tuple(range(3, min(6, most) + 1))
    if any(k < 2 or k > most for k in chosen):
        raise DataProblem(f"Segment counts must lie between 2 and {most}.")
    notes = []
    if chosen and (max(chosen) > 8 or customers / max(chosen) < 20):
        notes.append("Expect small or unstable groups at this many segments.")
    return GridPlan(tuple(algorithms), chosen, tuple(notes))


@dataclass
class ComparisonResult:
    """Ranked diagnostics, failures, one label column per candidate, and the fitted models."""

    diagnostics: DataFrame
    failures: DataFrame
    labels: DataFrame  # id, features, and one integer column per candidate
    label_columns: dict[tuple[str, int], str]
    fits: dict[tuple[str, int], Fit]
    rows: int
    columns: int

    def long_labels(self) -> DataFrame:
        """``(algorithm, k, id, label)``, one row per customer and candidate."""
        cells = [
            F.struct(F.lit(a).alias("algorithm"), F.lit(k).alias("k"), F.col("id"), F.col(c).alias("label"))
            for (a, k), c in self.label_columns.items()
        ]
        return self.labels.select(F.inline(F.array(*cells)))

    def best(self) -> tuple[str, int]:
        row = self.diagnostics.filter("recommended").select("algorithm_key", "segments").first()
        return row["algorithm_key"], row["segments"]


def ready(prepared: DataFrame) -> DataFrame:
    """The prepared table kept, sorted within stretches of ids; fits then see the same rows in the same order.

    Fits read it dozens of times, so it has no more partitions than cores, or than ``PART_NUMBERS`` asks for.
    """
    if prepared.storageLevel != StorageLevel.NONE:
        return prepared
    # A small table would otherwise arrive in one partition and be fitted by one core.
    spark = prepared.sparkSession
    cores = spark.sparkContext.defaultParallelism
    parts = max(cores, int(spark.conf.get("spark.sql.shuffle.partitions")))
    frame = durable(prepared.select("id", "features").repartition(parts, "id").sortWithinPartitions("id"))
    if parts == cores:
        return frame
    numbers = frame.agg(F.sum(F.size(vector_to_array("features")).cast("long"))).first()[0] or 0
    fewer = max(cores, -(-numbers // PART_NUMBERS))
    if fewer >= parts:
        return frame
    merged = frame.coalesce(fewer).persist(StorageLevel.MEMORY_AND_DISK)
    merged.count()
    frame.unpersist()
    return merged


@dataclass
class CandidateFits:
    """Fits of a grid on the full table and on the stability subsamples; a ``DataProblem`` where there is none."""

    base: dict[tuple[str, int], Fit | DataProblem]
    refits: dict[tuple[str, int, int], Fit | DataProblem]


def fit_grid(
    frame: DataFrame,
    rows: int,
    columns: int,
    algorithms: Sequence[str],
    counts: Sequence[int],
    repeats: int,
    seed: int,
    settings: FitSettings,
    threads: int = DRIVER_THREADS,
) -> CandidateFits:
    """Fit every method at every segment count, and again on ``repeats`` subsamples.

    Within a method all segment counts and subsamples share passes over the table. K-means partitions also start the
    mixtures. Methods run from separate driver threads so that their jobs overlap.
    """
    found = CandidateFits({}, {})
    frame = with_subsamples(frame, repeats, seed)
    everywhere = [None, *range(repeats)]
    wanted = [(k, subsample) for subsample in everywhere for k in counts]

    def store(algorithm: str, k: int, subsample: int | None, fit: Fit | DataProblem) -> None:
        if subsample is None:
            found.base[(algorithm, k)] = fit
        else:
            found.refits[(algorithm, k, subsample)] = fit

    def guarded(make) -> Fit | DataProblem:
        try:
            return make()
        except DataProblem as problem:
            return problem
        except np.linalg.LinAlgError:
            return DataProblem("Its covariances or distances could not be computed.")

    def centre_methods() -> None:
        partitions = fit_partitions(frame, wanted, seed, settings, repeats, every="gmm" in algorithms)
        if "kmeans" in algorithms:
            for (k, subsample), outcome in partitions.items():
                fit = outcome
                if not isinstance(outcome, DataProblem):
                    fit = guarded(lambda: partition_fit(outcome[0], k, f"{settings.kmeans_starts} starts"))
                store("kmeans", k, subsample, fit)
        if "gmm" in algorithms:
            counted = frame.agg(*[F.count_if(f"in_{r}").alias(f"n{r}") for r in range(repeats)]).first() if repeats else {}
            sizes = {None: rows, **{r: counted[f"n{r}"] for r in range(repeats)}}
            for (k, subsample), fit in fit_mixtures(
                frame, wanted, sizes, columns, seed, settings, repeats, partitions
            ).items():
                store("gmm", k, subsample, fit)

    def ward() -> None:
        full = WardHierarchy(frame, seed, settings)
        for subsample, tree in zip(everywhere, [full, *(full.subsampled(repeats) if repeats else [])]):
            for k in counts:
                store("hierarchical", k, subsample, guarded(lambda: tree.fit(k, rows)))

    def spectral() -> None:
        embedding = SpectralEmbedding(frame, rows, seed, settings, repeats)
        for subsample in everywhere:
            for k, fit in embedding.fits(counts, subsample).items():
                store("spectral", k, subsample, fit)

    work = []
    if {"kmeans", "gmm"} & set(algorithms):
        work.append(centre_methods)
    if "hierarchical" in algorithms:
        work.append(ward)
    if "spectral" in algorithms:
        work.append(spectral)
    with ThreadPoolExecutor(min(threads, len(work))) as pool:
        run = inheritable_thread_target(frame.sparkSession)
        for task in [pool.submit(run(job)) for job in work]:
            task.result()
    return found


def fit_candidate(
    prepared: DataFrame, algorithm: str, k: int, seed: int = 42, settings: FitSettings | None = None
) -> Fit:
    """Any method at any segment count, without a comparison."""
    if algorithm not in METHODS:
        raise DataProblem(f"Unknown method: {algorithm}")
    frame = ready(prepared)
    rows = frame.count()
    check_k(k, rows)
    columns = frame.select("features").first()["features"].size
    fit = fit_grid(frame, rows, columns, [algorithm], [k], 0, seed, settings or FitSettings()).base[(algorithm, k)]
    if isinstance(fit, DataProblem):
        raise fit
    return fit


def fit_solution(
    prepared: DataFrame, algorithm: str, k: int, seed: int = 42, settings: FitSettings | None = None
) -> SegmentSolution:
    """Fit one candidate and describe it: named segments, confidence, two-axis map."""
    frame = ready(prepared)
    fit = fit_candidate(frame, algorithm, k, seed, settings)
    labelled = fit.label(frame, "raw_label")
    if algorithm in ("hierarchical", "spectral"):
        labelled = durable(labelled)  # a label is looked up among many cells or landmarks: once, not for every figure
    return describe_solution(labelled, "raw_label", fit)


def grid_stability(
    labels: DataFrame,
    label_columns: dict[tuple[str, int], str],
    refits: dict[tuple[str, int, int], Fit | DataProblem],
    repeats: int,
) -> dict[tuple[str, int], tuple[float, float, int]]:
    """Per candidate the mean and spread of its agreement with refits on 80 % subsamples, and how many refits worked.

    A refit adds one label column; one contingency pass serves all candidates and repeats of a method. A refit that
    fails counts as zero.
    """
    scores: dict[tuple[str, int], list[float]] = {candidate: [] for candidate in label_columns}
    for algorithm in dict.fromkeys(a for a, _ in label_columns):
        table, pairs = labels, {}
        for (method, k), name in label_columns.items():
            for repeat in range(repeats) if method == algorithm else ():
                refit = refits[(method, k, repeat)]
                if isinstance(refit, DataProblem):
                    continue
                again = f"r{k}_{repeat}"
                table = refit.label(table, again)
                table = table.withColumn(again, F.when(F.col(f"in_{repeat}"), F.col(again)))
                pairs[f"{k}|{repeat}"] = (name, again)
        for row in D.pair_agreement(table, pairs).collect() if pairs else []:
            scores[(algorithm, int(row["pair"].split("|")[0]))].append(row["ari"])
    found = {}
    for candidate, own in scores.items():
        whole = own + [0.0] * (repeats - len(own))
        found[candidate] = (statistics.fmean(whole), statistics.stdev(whole), len(own))
    return found


def compare_solutions(
    prepared: DataFrame,
    algorithms: Sequence[str] = ("kmeans", "gmm", "hierarchical"),
    k_values: Sequence[int] = (3, 4, 5, 6),
    stability_repeats: int = 6,
    seed: int = 42,
    settings: FitSettings | None = None,
    threads: int = DRIVER_THREADS,
) -> ComparisonResult:
    """Compare candidates on separation, stability, size, agreement and simplicity.

    ``prepared`` is ``(id, features)`` as made by ``PrepModel.matrix``. Candidates run from a few driver threads so that
    their small jobs overlap; every job itself is spread over the executors.
    """
    settings = settings or FitSettings()
    unknown = [name for name in algorithms if name not in METHODS]
    if unknown:
        raise DataProblem("Unknown method: " + ", ".join(unknown))
    if not algorithms or not k_values:
        raise DataProblem("Choose one method and one segment count at least.")
    frame = ready(prepared)
    rows = frame.count()
    if rows < rules.MIN_CUSTOMERS:
        raise DataProblem(f"A comparison needs {rules.MIN_CUSTOMERS} prepared customers or more.")
    columns = frame.select("features").first()["features"].size
    if columns > rules.MAX_MODEL_COLUMNS:
        raise DataProblem(f"A comparison takes {rules.MAX_MODEL_COLUMNS} model columns at most.")
    repeats = max(2, stability_repeats)
    frame = with_subsamples(frame, repeats, seed)
    counts = [k for k in sorted(set(k_values)) if k < rows]
    grid = [(algorithm, k) for algorithm in algorithms for k in counts]
    found = fit_grid(frame, rows, columns, algorithms, counts, repeats, seed, settings, threads)
    failures: list[tuple[str, int, str]] = []
    fits: dict[tuple[str, int], Fit] = {}
    for candidate in grid:
        outcome = found.base[candidate]
        if isinstance(outcome, Fit):
            fits[candidate] = outcome
        else:
            failures.append((METHODS[candidate[0]], candidate[1], str(outcome)))
    if not fits:
        raise DataProblem("None of the candidates could be fitted; try other bases or segment counts.")

    label_columns = {candidate: f"label_{i}" for i, candidate in enumerate(fits)}
    labels = frame
    for candidate, name in label_columns.items():
        labels = fits[candidate].label(labels, name)
    labels = durable(labels.select("id", "features", *[f"in_{r}" for r in range(repeats)], *label_columns.values()))

    separation = D.silhouettes(labels, list(label_columns.values()), seed=seed)
    peers = {
        f"{a}|{b}|{k}": (label_columns[(a, k)], label_columns[(b, k)])
        for k in counts
        for a, b in combinations([name for name in algorithms if (name, k) in fits], 2)
    }
    agreement: dict[tuple[str, int], list[float]] = {}
    if peers:
        for row in D.pair_agreement(labels, peers).collect():
            a, b, k = row["pair"].split("|")
            agreement.setdefault((a, int(k)), []).append(row["ari"])
            agreement.setdefault((b, int(k)), []).append(row["ari"])

    scored = [candidate for candidate in fits if label_columns[candidate] in separation]
    failures += [(METHODS[a], k, "Its covariances or distances could not be computed.") for a, k in fits if (a, k) not in scored]
    columns_of = [label_columns[candidate] for candidate in scored]
    statistics_of = D.grouped_statistics(labels, columns_of) if scored else {}
    spread_of = D.grouped_spread(labels, statistics_of) if scored else {}
    stability_of = grid_stability(labels, {c: label_columns[c] for c in scored}, found.refits, repeats)
    labels = labels.drop(*[f"in_{r}" for r in range(repeats)])

    evaluated = []
    for candidate in scored:
        algorithm, k = candidate
        name, fit = label_columns[candidate], fits[candidate]
        stats = statistics_of[name]
        share = stats.counts / stats.total
        stability, spread, successes = stability_of[candidate]
        bic, aic = (
            information_criteria(fit.log_likelihood, k, columns, rows) if fit.log_likelihood is not None else (None, None)
        )
        peers_of = agreement.get(candidate)
        evaluated.append((
            list(fits).index(candidate),
            algorithm,
            METHODS[algorithm],
            k,
            stats.total,
            float(separation[name]),
            stability,
            spread,
            repeats,
            successes,
            D.calinski_harabasz(stats),
            D.davies_bouldin(stats, spread_of[name]),
            float(100 * share.min()),
            int(stats.counts.min()),
            float(100 * share.max()),
            float(-(share * np.log(share + 1e-12)).sum() / max(np.log(len(share)), 1e-12)),
            bic,
            aic,
            fit.detail,
            statistics.fmean(peers_of) if peers_of else None,
        ))
    if not evaluated:
        raise DataProblem("None of the fitted candidates could be scored; try other bases or segment counts.")
    spark = frame.sparkSession
    candidates = spark.createDataFrame(evaluated, CANDIDATE_SCHEMA)
    ranked = D.rank_candidates(D.quality_label(D.evidence_score(candidates))).orderBy("position")
    return ComparisonResult(
        ranked, spark.createDataFrame(failures, FAILURE_SCHEMA), labels, label_columns, fits, rows, columns
    )
