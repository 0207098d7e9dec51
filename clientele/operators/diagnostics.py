"""Evidence about a labelling: sizes, separation, agreement, score, quality and ranking.

A labelling is an integer column next to the prepared vector, never a second table, so nothing here joins customers.
Whatever is gathered has one row per segment, per pair of segments, or per candidate.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientele.errors import DataProblem
from clientele.functions.geometry import with_distances

SILHOUETTE_SAMPLE = 2000
SAMPLE_TASKS = 8
PREFIX_DIGITS = 3  # of a hash, counted at a time


def hash_order(id_column: str, seed: int) -> Column:
    """A fixed pseudo-random order of customers that does not depend on partitioning."""
    return F.md5(F.concat(F.col(id_column).cast("string"), F.lit(str(seed))))


def first_by_hash(frame: DataFrame, id_column: str, seed: int, size: int) -> DataFrame:
    """The first ``size`` rows in hash order, in that order.

    Sorting out the first rows of every task would send tasks x ``size`` rows to the driver. Rows are counted by the
    leading digits of their hash instead, within the range that holds the last wanted row, until little more than
    ``size`` rows lie below its end; only those are sorted. A pass brings 4,096 counts to the driver.
    """
    hashed = hash_order(id_column, seed)
    begun, left, below = "", size, None
    while True:
        digits = F.substring(hashed, 1, len(begun) + PREFIX_DIGITS)
        inside = frame.filter(hashed.startswith(begun)) if begun else frame
        counts = inside.groupBy(digits.alias("digits")).agg(F.count(F.lit(1)).alias("n")).collect()
        last = None
        for row in sorted((r for r in counts if r["digits"] is not None), key=lambda r: r["digits"]):
            last = row
            if left <= row["n"]:
                break
            left -= row["n"]
        else:
            break  # fewer rows than wanted
        below = begun = last["digits"]
        if last["n"] <= max(size, left) or len(begun) + PREFIX_DIGITS > 32:
            break
    # A missing id has no hash; such rows come first, as they do in any sort.
    kept = frame if below is None else frame.filter(hashed.isNull() | (F.substring(hashed, 1, len(below)) <= below))
    return kept.orderBy(hashed, id_column).limit(size)


# ---------------------------------------------------------------------------------------------- segment statistics


@dataclass
class SegmentStatistics:
    """Size, centre and within-segment squared deviation per label, ordered by label."""

    labels: list
    counts: np.ndarray
    centres: np.ndarray
    within: np.ndarray

    @property
    def total(self) -> int:
        return int(self.counts.sum())


def segment_statistics(frame: DataFrame, label: str, features: str = "features") -> SegmentStatistics:
    """One mergeable vector summary per segment: a single pass with map-side partial results."""
    summary = Summarizer.metrics("count", "mean", "variance").summary(F.col(features))
    rows = (
        frame.filter(F.col(label).isNotNull()).groupBy(label).agg(summary.alias("s")).collect()
    )
    if not rows:
        raise DataProblem("No labelled customers.")
    rows.sort(key=lambda row: row[label])
    counts = np.array([row["s"]["count"] for row in rows], dtype=float)
    variance = np.array([row["s"]["variance"].toArray().sum() for row in rows])
    return SegmentStatistics(
        labels=[row[label] for row in rows],
        counts=counts,
        centres=np.vstack([row["s"]["mean"].toArray() for row in rows]),
        within=np.where(counts > 1, variance * (counts - 1), 0.0),
    )


def grouped_statistics(frame: DataFrame, labels: Sequence[str], features: str = "features") -> dict[str, SegmentStatistics]:
    """``segment_statistics`` of many label columns in one pass; labels come out as text, in text order."""
    cells = [F.struct(F.lit(i).alias("place"), F.col(c).cast("string").alias("value")) for i, c in enumerate(labels)]
    summary = Summarizer.metrics("count", "mean", "variance").summary(F.col("point"))
    rows = (
        frame.select(F.col(features).alias("point"), F.inline(F.array(*cells)))
        .filter(F.col("value").isNotNull())
        .groupBy("place", "value")
        .agg(summary.alias("s"))
        .collect()
    )
    found = {}
    for place, label in enumerate(labels):
        own = sorted((r for r in rows if r["place"] == place), key=lambda r: r["value"])
        if not own:
            raise DataProblem("No labelled customers.")
        counts = np.array([r["s"]["count"] for r in own], dtype=float)
        variance = np.array([r["s"]["variance"].toArray().sum() for r in own])
        centres = np.vstack([r["s"]["mean"].toArray() for r in own])
        found[label] = SegmentStatistics([r["value"] for r in own], counts, centres, np.where(counts > 1, variance * (counts - 1), 0.0))
    return found


def grouped_spread(frame: DataFrame, found: Mapping[str, SegmentStatistics], features: str = "features") -> dict[str, np.ndarray]:
    """``mean_spread`` of many label columns in one pass."""
    labels, table, cells = list(found), frame, []
    for i, label in enumerate(labels):
        stats, value = found[label], F.col(label).cast("string")
        table = with_distances(table, stats.centres, f"away_{i}", features)
        place = F.array_position(F.array(*map(F.lit, stats.labels)), value).cast("int")
        cells.append(F.struct(F.lit(i).alias("place"), value.alias("value"), F.get(f"away_{i}", place - 1).alias("away")))
    rows = table.select(F.inline(F.array(*cells))).filter(F.col("value").isNotNull()).groupBy("place", "value").agg(F.avg("away").alias("spread")).collect()
    at = {(r["place"], r["value"]): r["spread"] for r in rows}
    return {label: np.array([at[(i, v)] for v in found[label].labels]) for i, label in enumerate(labels)}


def segment_sizes(frame: DataFrame, label: str) -> DataFrame:
    """Customers and share per label."""
    sized = frame.groupBy(label).agg(F.count(F.lit(1)).alias("customers"))
    return sized.withColumn("share", F.col("customers") / F.sum("customers").over(W.partitionBy(F.lit(0))))


def size_balance(frame: DataFrame, label: str) -> DataFrame:
    """One row: customers, segments, smallest and largest share in percent, smallest count, entropy balance."""
    share = F.col("share")
    return segment_sizes(frame, label).agg(
        F.sum("customers").alias("customers"),
        F.count(F.lit(1)).alias("segments"),
        (100 * F.min(share)).alias("smallest_segment_%"),
        F.min("customers").alias("smallest_segment_customers"),
        (100 * F.max(share)).alias("largest_segment_%"),
        (-F.sum(share * F.ln(share + 1e-12)) / F.greatest(F.ln(F.count(F.lit(1))), F.lit(1e-12))).alias("balance"),
    )


def calinski_harabasz(stats: SegmentStatistics) -> float:
    """Between over within dispersion, each per degree of freedom."""
    n, k = stats.total, len(stats.labels)
    overall = (stats.counts[:, None] * stats.centres).sum(axis=0) / n
    between = float((stats.counts * ((stats.centres - overall) ** 2).sum(axis=1)).sum())
    within = float(stats.within.sum())
    return 1.0 if within == 0.0 else (between / (k - 1)) / (within / (n - k))


def _position(label: str, stats: SegmentStatistics) -> Column:
    """Zero-based place of the row's label among the ordered labels."""
    place = F.lit(None).cast("int")
    for position, value in reversed(list(enumerate(stats.labels))):
        place = F.when(F.col(label) == F.lit(value), F.lit(position)).otherwise(place)
    return place


def mean_spread(frame: DataFrame, label: str, stats: SegmentStatistics, features: str = "features") -> np.ndarray:
    """Mean distance of a segment's rows to its own centre."""
    rows = (
        with_distances(frame.select(label, features), stats.centres, "away", features)
        .groupBy(label)
        .agg(F.avg(F.get("away", _position(label, stats))).alias("spread"))
        .collect()
    )
    at = {row[label]: row["spread"] for row in rows}
    return np.array([at[value] for value in stats.labels])


def centre_gaps(stats: SegmentStatistics) -> np.ndarray:
    return np.sqrt(((stats.centres[:, None, :] - stats.centres[None, :, :]) ** 2).sum(axis=2))


def davies_bouldin(stats: SegmentStatistics, spread: np.ndarray) -> float:
    """Mean over segments of the worst ratio of joint spread to centre distance."""
    gaps = centre_gaps(stats)
    if np.allclose(spread, 0) or np.allclose(gaps, 0):
        return 0.0
    gaps[gaps == 0] = np.inf
    ratios = (spread[:, None] + spread[None, :]) / gaps
    np.fill_diagonal(ratios, 0.0)
    return float(ratios.max(axis=1).mean())


def centroid_distances(frame: DataFrame, label: str, features: str = "features", digits: int = 3) -> DataFrame:
    """``(segment, other_segment, distance)`` between segment centres in prepared space."""
    stats = segment_statistics(frame, label, features)
    gaps = centre_gaps(stats)
    rows = [
        (str(a), str(b), round(float(gaps[i, j]), digits))
        for i, a in enumerate(stats.labels)
        for j, b in enumerate(stats.labels)
    ]
    return frame.sparkSession.createDataFrame(rows, "segment string, other_segment string, distance double")


# ------------------------------------------------------------------------------------------------------ silhouette


def silhouette_rows(
    frame: DataFrame,
    labels: Sequence[str],
    sample_size: int = SILHOUETTE_SAMPLE,
    seed: int = 42,
    id_column: str = "id",
    features: str = "features",
) -> DataFrame:
    """``(labelling, silhouette)`` per sampled customer and labelling; Euclidean, sample of at most ``sample_size``.

    The sample is the statistic's own definition. It is drawn once for all labellings by hash order (``first_by_hash``),
    and is small enough to hand to every task; tasks then share the rows.
    """
    drawn = (
        first_by_hash(frame.select(id_column, features, *labels), id_column, seed, sample_size)
        .select(vector_to_array(features).alias("point"), *labels)
        .collect()
    )
    points = np.array([row["point"] for row in drawn], dtype=float)
    codes = [np.unique([str(row[name]) for row in drawn], return_inverse=True)[1] for name in labels]
    names = list(labels)
    schema = "labelling string, silhouette double"

    def score(batches):
        for batch in batches:
            rows = batch["id"].to_numpy()
            if not len(rows):
                continue
            squares = np.zeros((len(rows), len(points)))
            for column in points.T:
                squares += (column[rows, None] - column[None, :]) ** 2
            distances = np.sqrt(squares)
            for name, code in zip(names, codes):
                sizes = np.bincount(code)
                if len(sizes) < 2:
                    continue
                sums = np.stack([distances[:, code == c].sum(axis=1) for c in range(len(sizes))], axis=1)
                own = code[rows]
                place = np.arange(len(rows))
                inner = sums[place, own] / np.maximum(sizes[own] - 1, 1)
                outer = sums / sizes
                outer[place, own] = np.inf
                other = outer.min(axis=1)
                width = np.maximum(inner, other)
                value = np.where((sizes[own] > 1) & (width > 0), (other - inner) / np.where(width > 0, width, 1), 0.0)
                yield pd.DataFrame({"labelling": name, "silhouette": value})

    tasks = min(SAMPLE_TASKS, max(1, len(points) // 100))
    return frame.sparkSession.range(0, len(points), 1, tasks).mapInPandas(score, schema)


def silhouettes(frame: DataFrame, labels: Sequence[str], **options) -> dict[str, float]:
    """Mean silhouette per labelling; a labelling with one label in the sample is absent."""
    rows = silhouette_rows(frame, labels, **options).groupBy("labelling").agg(F.avg("silhouette").alias("s")).collect()
    return {row["labelling"]: row["s"] for row in rows}


# ------------------------------------------------------------------------------------------------------- agreement


def pair_agreement(frame: DataFrame, pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """``(pair, ari)``: adjusted Rand index of two label columns, over rows where both exist.

    Each row contributes one cell per pair to a contingency table that is combined before the shuffle; the table has
    k × k cells per pair. Row sums, column sums and the total come from the same table.
    """
    whole = all(isinstance(frame.schema[c].dataType, T.IntegralType) for pair in pairs.values() for c in pair)
    kind = "int" if whole else "string"
    cells = [
        F.struct(F.lit(place).alias("place"), F.col(a).cast(kind).alias("a"), F.col(b).cast(kind).alias("b"))
        for place, (a, b) in enumerate(pairs.values())
    ]
    names = F.array(*map(F.lit, pairs))
    table = (
        frame.select(F.inline(F.array(*cells)))
        .filter(F.col("a").isNotNull() & F.col("b").isNotNull())
        .groupBy("place", "a", "b")
        .agg(F.count(F.lit(1)).cast("double").alias("n"))
    )
    pairs_of = F.col("n") * (F.col("n") - 1) / 2
    in_row = F.sum("n").over(W.partitionBy("place", "a"))
    in_column = F.sum("n").over(W.partitionBy("place", "b"))
    row_lead = F.row_number().over(W.partitionBy("place", "a").orderBy("b")) == 1
    column_lead = F.row_number().over(W.partitionBy("place", "b").orderBy("a")) == 1

    def choose_two(size: Column) -> Column:
        return size * (size - 1) / 2

    sums = (
        table.select(
            "place",
            "n",
            pairs_of.alias("joint"),
            F.when(row_lead, choose_two(in_row)).otherwise(0.0).alias("by_row"),
            F.when(column_lead, choose_two(in_column)).otherwise(0.0).alias("by_column"),
        )
        .groupBy("place")
        .agg(
            F.sum("joint").alias("s"), F.sum("by_row").alias("a"), F.sum("by_column").alias("b"),
            choose_two(F.sum("n")).alias("all"),
        )
    )
    expected = F.col("a") * F.col("b") / F.col("all")
    spread = (F.col("a") + F.col("b")) / 2 - expected
    return sums.select(F.get(names, F.col("place")).alias("pair"), F.when(spread == 0, 1.0).otherwise((F.col("s") - expected) / spread).alias("ari"))


def method_agreement(pair_scores: DataFrame) -> DataFrame:
    """Mean agreement with the other methods at the same segment count.

    Input ``(method_a, method_b, segments, ari)``, one row per unordered pair; output per method and count.
    """
    both = pair_scores.select(F.col("method_a").alias("algorithm_key"), "segments", "ari").unionByName(
        pair_scores.select(F.col("method_b").alias("algorithm_key"), "segments", "ari")
    )
    return both.groupBy("algorithm_key", "segments").agg(F.avg("ari").alias("cross_method_agreement"))


# ----------------------------------------------------------------------------------- score, quality, rank, verdict


def _unit(column: Column) -> Column:
    return F.greatest(F.least(column, F.lit(1.0)), F.lit(0.0))


def evidence_score(candidates: DataFrame) -> DataFrame:
    """Add ``recommendation_score`` (0-100) and the source of its agreement part."""
    separation = _unit((F.col("silhouette") + 0.05) / 0.55)
    stability = _unit(F.col("stability"))
    size = (
        0.45 * _unit(F.col("`smallest_segment_%`") / 8)
        + 0.25 * _unit(F.col("balance"))
        + 0.30 * _unit(F.col("smallest_segment_customers") / 30)
    )
    simplicity = _unit(1 - (F.col("segments") - 2) / 10)
    alone = 0.35 * separation + 0.30 * stability + 0.15 * size + 0.10 * simplicity
    agreement = F.col("cross_method_agreement")
    known = agreement.isNotNull() & ~F.isnan(agreement)
    return candidates.select(
        "*",
        F.when(known, 100 * (alone + 0.10 * _unit(agreement))).otherwise(100 * alone / 0.90).alias("recommendation_score"),
        F.when(known, F.lit("cross-method agreement"))
        .otherwise(F.lit("none; remaining weights rescaled"))
        .alias("agreement_component_source"),
    )


# Evidence thresholds (silhouette, stability, smallest share %, customers, smallest count).
QUALITY_THRESHOLDS = (
    ("Strong", 0.45, 0.80, 5.0, 300, 30),
    ("Promising", 0.25, 0.65, 3.0, 100, 20),
    ("Exploratory", 0.12, 0.50, 2.0, 0, 5),
)
MIN_REPEATS = 4


def quality_label(candidates: DataFrame) -> DataFrame:
    """Add ``quality``: Strong, Promising, Exploratory or Weak."""
    repeated = (F.col("stability_repeats") >= MIN_REPEATS) & (F.col("stability_successful_repeats") >= MIN_REPEATS)
    label = F.lit("Weak")
    for name, silhouette, stability, share, customers, smallest in reversed(QUALITY_THRESHOLDS):
        enough = (
            (F.col("silhouette") >= silhouette)
            & (F.col("stability") >= stability)
            & (F.col("`smallest_segment_%`") / 100 >= share / 100)
            & (F.col("customers") >= customers)
            & (F.col("smallest_segment_customers") >= smallest)
        )
        if name != "Exploratory":
            enough = enough & repeated
        label = F.when(enough, name).otherwise(label)
    return candidates.withColumn("quality", label)


def rank_candidates(candidates: DataFrame) -> DataFrame:
    """Add ``recommended`` and ``position``: best non-weak candidate first, then by score; earlier candidates win ties.

    ``candidates`` has one row per method and segment count and an ``order`` column for that tie rule.
    """
    everything = W.partitionBy(F.lit(0))
    best = F.row_number().over(
        everything.orderBy((F.col("quality") == "Weak").asc(), F.col("recommendation_score").desc(), F.col("order"))
    )
    flagged = candidates.withColumn("recommended", best == 1)
    position = F.row_number().over(
        everything.orderBy(F.col("recommended").desc(), F.col("recommendation_score").desc(), F.col("order"))
    )
    return flagged.withColumn("position", position)


def verdict(ranked: DataFrame) -> DataFrame:
    """One row: outcome, and the leading method, segment count and quality."""
    lead = F.min_by(F.struct("method", "segments", "quality"), "position")
    return (
        ranked.agg(F.bool_and(F.col("quality") == "Weak").alias("all_weak"), lead.alias("lead"))
        .select(
            F.when(F.col("all_weak"), "no reliable segmentation")
            .when(F.col("lead.quality") == "Exploratory", "exploratory")
            .otherwise("supported")
            .alias("outcome"),
            "lead.method",
            "lead.segments",
            "lead.quality",
        )
    )


def score_curve(ranked: DataFrame) -> DataFrame:
    """The comparison table by method and segment count."""
    return ranked.select(
        "method", "segments", "recommended", "quality", "recommendation_score", "silhouette", "stability",
        "stability_std", "cross_method_agreement", "smallest_segment_customers", "`smallest_segment_%`", "davies_bouldin",
    ).orderBy("segments", "method")
