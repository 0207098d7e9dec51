"""One chosen labelling: segment names by size, membership confidence and a two-axis map."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clientele.functions.geometry import with_distances
from clientele.functions.quantiles import exact_quantiles
from clientele.operators.diagnostics import SegmentStatistics, _position, segment_sizes, segment_statistics
from clientele.operators.fits import Fit

LOW_CONFIDENCE = (0.60, 0.70)


@dataclass
class SegmentSolution:
    """``assignments`` has one row per customer: id, raw_label, segment, confidence, PC1, PC2 (and the features)."""

    algorithm: str
    k: int
    assignments: DataFrame
    explained_variance: float
    detail: str = "exact"
    note: str = ""


def segment_names(frame: DataFrame, label: str) -> DataFrame:
    """``(label, customers, segment)``: Segment 1 is the largest, equal sizes go by label."""
    sized = segment_sizes(frame, label)
    # One row per segment reaches this window.
    place = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("customers").desc(), F.col(label)))
    return sized.select(label, "customers", F.concat(F.lit("Segment "), place.cast("string")).alias("segment"))


def segment_order(segment: Column) -> Column:
    """Sort key: the number at the end of a segment label."""
    return F.try_to_number(F.regexp_extract(segment, r"(\d+)$", 1), F.lit("9999999999")).cast("int")


def _name_expression(label: str, stats: SegmentStatistics) -> Column:
    ranked = sorted(zip(stats.labels, stats.counts), key=lambda item: (-item[1], item[0]))
    name = F.lit(None).cast("string")
    for place, (value, _) in reversed(list(enumerate(ranked, start=1))):
        name = F.when(F.col(label) == F.lit(value), F.lit(f"Segment {place}")).otherwise(name)
    return name


def with_confidence(
    frame: DataFrame, label: str, stats: SegmentStatistics, name: str = "confidence", features: str = "features"
) -> DataFrame:
    """Nearest other centre's distance over the sum of that and the own centre's distance, within [0, 1]."""
    scratch = "__to_centres"
    frame = with_distances(frame, stats.centres, scratch, features)
    own_place = _position(label, stats)
    away = F.col(scratch)
    own = F.get(away, own_place)
    others = [F.when(own_place != place, away[place]) for place in range(len(stats.labels))]
    nearest = F.least(*others) if len(others) > 1 else others[0]
    ratio = nearest / (own + nearest + 1e-12)
    return frame.withColumn(name, F.greatest(F.least(ratio, F.lit(1.0)), F.lit(0.0))).drop(scratch)


def principal_map(frame: DataFrame, stats: SegmentStatistics, features: str = "features") -> tuple[DataFrame, float]:
    """Add PC1 and PC2 of the centred features; returns the share of variance they keep.

    The largest loading of each axis is made positive. The built-in model does not centre when it transforms, so the
    offset of the mean is subtracted afterwards.
    """
    columns = stats.centres.shape[1]
    mean = (stats.counts[:, None] * stats.centres).sum(axis=0) / stats.total
    axes = min(2, columns)
    model = PCA(k=axes, inputCol=features, outputCol="__axes").fit(frame)
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(axes)])
    offset = mean @ loadings
    placed = model.transform(frame).withColumn("__axes", vector_to_array("__axes"))
    for axis in range(2):
        value = (
            (F.col("__axes")[axis] - F.lit(float(offset[axis]))) * F.lit(float(signs[axis])) if axis < axes else F.lit(0.0)
        )
        placed = placed.withColumn(f"PC{axis + 1}", value)
    return placed.drop("__axes"), float(sum(model.explainedVariance.toArray()))


def describe_solution(
    frame: DataFrame, label: str, fit: Fit, note: str = "", keep: Sequence[str] = ()
) -> SegmentSolution:
    """Turn a labelled prepared table (id, features, label) into the chosen solution. Fits are not repeated."""
    stats = segment_statistics(frame, label)
    table = frame.select("id", *keep, "features", F.col(label).alias("raw_label"))
    table = fit.posterior(table, "confidence") if fit.posterior else with_confidence(table, "raw_label", stats)
    table, explained = principal_map(table, stats)
    table = table.withColumn("segment", _name_expression("raw_label", stats))
    return SegmentSolution(fit.algorithm, fit.k, table, explained, fit.detail, note)


def confidence_summary(frame: DataFrame, confidence: str = "confidence") -> DataFrame:
    """One row: median confidence and the shares below 60 % and 70 %."""
    value = F.col(confidence)
    median = exact_quantiles(frame, {confidence: value}, [0.5])[(None, confidence)][0]
    low, lower = LOW_CONFIDENCE
    return frame.agg(
        F.lit(median).alias("median_confidence"),
        F.avg((value < low).cast("double")).alias("share_below_60"),
        F.avg((value < lower).cast("double")).alias("share_below_70"),
    )
