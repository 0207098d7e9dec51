"""Distances from prepared rows to a few centres."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Up to this many subtractions the distances are plain arithmetic inside generated code; more would outgrow a JVM
# method, so they go through one Arrow batch function instead.
INLINE_TERMS = 400


def with_distances(frame: DataFrame, centres: np.ndarray, name: str, features: str = "features") -> DataFrame:
    """Add an array column with the Euclidean distance of each row to every centre (``centres`` is k × p)."""
    point = f"__point_{name}"
    frame = frame.withColumn(point, vector_to_array(features))
    k, p = centres.shape
    if k * p <= INLINE_TERMS:
        # One parsed expression: building it node by node would cost a driver round trip per term.
        distances = F.expr("array(" + ", ".join(_distance_text(point, centre) for centre in centres) + ")")
    else:
        distances = _batch_distances(centres)(F.col(point))
    return frame.withColumn(name, distances).drop(point)


def _distance_text(point: str, centre: np.ndarray) -> str:
    gaps = [f"({point}[{i}] - ({float(c)!r}D))" for i, c in enumerate(centre)]
    return "sqrt(" + " + ".join(f"{gap} * {gap}" for gap in gaps) + ")"


def _batch_distances(centres: np.ndarray):
    @F.pandas_udf("array<double>")
    def to_centres(points: pd.Series) -> pd.Series:
        if not len(points):
            return pd.Series([], dtype=object)
        rows = np.vstack(points.to_numpy())
        found = np.stack([np.sqrt(((rows - centre) ** 2).sum(axis=1)) for centre in centres], axis=1)
        return pd.Series(list(found))

    return to_centres
