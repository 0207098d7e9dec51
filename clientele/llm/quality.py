"""Quality by regularised quadratic discriminant analysis of transformed document statistics."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.llm.columns import with_text_value
from clientele.llm.words import slices

STATISTICS = (
    "log_bytes", "upper", "digit", "mark", "symbol", "pipe", "space", "word_length", "distinct_words", "line_words",
    "distinct_lines", "end_marks", "non_ascii", "squeezed", "repeated_pairs", "long_words",
)
_UPPER = bytes(range(65, 91)) + bytes()
_DIGIT = b"0123456789"
_MARK = b".,;:!?'\"()-"
_SYMBOL = b"#$%&*+/<=>@[\\]^_`{}~"
_SPACE = b" \t\n\r\x0b\x0c"
_BEYOND = bytes(range(128, 256))


def _share_left(body: bytes, drop: bytes) -> float:
    return (len(body) - len(body.translate(None, drop))) / len(body)


def _logit(share: float) -> float:
    """Shares spread out at both ends; the clip keeps 0 and 1 finite."""
    share = min(max(share, 1e-3), 1 - 1e-3)
    return math.log(share / (1 - share))


def document_statistics(text: str) -> list[float]:
    """Transformed statistics of a whole text: logs of lengths and logits of shares."""
    body = text.encode()
    words, lines = body.split(), [x for x in body.split(b"\n") if x.strip()]
    if not words:
        return [math.log1p(len(body))] + [0.0] * (len(STATISTICS) - 1)
    n = len(words)
    pairs = len(set(zip(words, words[1:]))) if n > 1 else 1
    upper = sum(c.isupper() for c in text) if not text.isascii() else len(body) - len(body.translate(None, _UPPER))
    return [
        math.log1p(len(body)), _logit(upper / len(text)), _logit(_share_left(body, _DIGIT)), _logit(_share_left(body, _MARK)),
        _logit(_share_left(body, _SYMBOL)), _logit(body.count(b"|") / n), _logit(_share_left(body, _SPACE)),
        math.log(len(body) / n), math.log(len(set(words)) / n), math.log(n / len(lines)),
        math.log(len(set(lines)) / len(lines)), _logit((body.count(b".") + body.count(b"!") + body.count(b"?")) / n),
        _logit(_share_left(body, _BEYOND)), math.log(len(zlib.compress(body, 1)) / len(body)),
        math.log(pairs / max(n - 1, 1)), _logit(sum(len(w) > 20 for w in words) / n),
    ]


def _statistic_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, _, _ in slices(batches):
        values = [document_statistics(t or "") for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.list_(pa.float64()))], ["id", "x"])


@dataclass(frozen=True)
class ShrunkGaussian:
    """Mean, cached Cholesky factor of the shrunk covariance, and log prior minus half its log determinant."""

    mean: np.ndarray
    factor_inverse: np.ndarray
    offset: float

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) @ self.factor_inverse.T
        return self.offset - 0.5 * np.einsum("ij,ij->i", z, z)


@dataclass(frozen=True)
class QuadraticDiscriminant:
    """Score of class 1 from two Gaussians over standardised statistics."""

    center: np.ndarray
    spread: np.ndarray
    classes: tuple[ShrunkGaussian, ShrunkGaussian] | None
    constant: float = 0.5
    temperature: float = 4.0

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.classes is None:
            return np.full(len(x), self.constant)
        z = np.clip((x - self.center) / self.spread, -12, 12)
        gap = (self.classes[1].log_density(z) - self.classes[0].log_density(z)) / self.temperature
        return 1 / (1 + np.exp(-np.clip(gap, -40, 40)))


def fit_discriminant(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], pooled: float = 0.1, diagonal: float = 0.05) -> QuadraticDiscriminant:
    """Fit from (rows, sums, cross products) per class.

    Each covariance is shrunk towards the pooled one (share ``pooled``) and then towards its own diagonal (share
    ``diagonal``), with a floor on variances. A class with fewer than three rows gives a constant score: the share
    of class 1, or a half without any labels.
    """
    width = len(STATISTICS)
    total = sum(n for n, _, _ in moments.values())
    if any(moments.get(c, (0,))[0] < 3 for c in (0, 1)):
        share = moments.get(1, (0,))[0] / total if total else 0.5
        return QuadraticDiscriminant(np.zeros(width), np.ones(width), None, share)
    center = sum(s for _, s, _ in moments.values()) / total
    spread = np.sqrt(np.maximum(np.diag(sum(c for _, _, c in moments.values())) / total - center**2, 1e-8))
    means, covariances = {}, {}
    for c, (n, sums, cross) in moments.items():
        mean = sums / n
        covariances[c] = (cross / n - np.outer(mean, mean)) / np.outer(spread, spread)
        means[c] = (mean - center) / spread
    common = sum(moments[c][0] * covariances[c] for c in (0, 1)) / total
    classes = []
    for c in (0, 1):
        shrunk = (1 - pooled) * covariances[c] + pooled * common
        shrunk = (1 - diagonal) * shrunk + diagonal * np.diag(np.diag(shrunk)) + 1e-3 * np.eye(width)
        factor = np.linalg.cholesky(shrunk)
        prior = math.log(moments[c][0] / total)
        classes.append(ShrunkGaussian(means[c], np.linalg.inv(factor), prior - float(np.log(np.diag(factor)).sum())))
    return QuadraticDiscriminant(center, spread, (classes[0], classes[1]))


def class_moments(examples: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Sums of rows, statistics and cross products per ``label`` of (x, label); two rows reach the driver."""
    width = len(STATISTICS)
    x = [F.col("x")[i] for i in range(width)]
    sums = [F.sum(x[i]).alias(f"s{i}") for i in range(width)]
    cross = [F.sum(x[i] * x[j]).alias(f"c{i}_{j}") for i in range(width) for j in range(i + 1)]
    found = {}
    for r in examples.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *sums, *cross).collect():
        square = np.zeros((width, width))
        for i in range(width):
            for j in range(i + 1):
                square[i, j] = square[j, i] = r[f"c{i}_{j}"]
        found[int(r["label"])] = (float(r["n"]), np.array([r[f"s{i}"] for i in range(width)]), square)
    return found


def statistics_table(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, x) for every row; a null text is an empty one."""
    kind = dict(docs.dtypes)[doc_id]
    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(_statistic_rows, f"id {kind}, x array<double>")


def train_quality(table: DataFrame, labels: DataFrame, usable: Column, label_id: str = "doc_id", label: str = "quality") -> QuadraticDiscriminant:
    """Fit on the labelled rows of a stored statistics table for which ``usable`` (over ``id``) holds."""
    marked = labels.filter(F.col(label).isin(0, 1)).select(F.col(label_id).alias("id"), F.col(label).cast("int").alias("label"))
    return fit_discriminant(class_moments(table.filter(usable).join(marked.filter(usable), "id")))


def scored_quality(table: DataFrame, model: QuadraticDiscriminant) -> DataFrame:
    """(id, score) for every row of a statistics table."""
    held = table.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), dtype=float).reshape(batch.num_rows, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held.value.score(x))], ["id", "score"])

    return table.mapInArrow(score, f"id {dict(table.dtypes)['id']}, score double")


def with_quality(docs: DataFrame, model: QuadraticDiscriminant, text: str, name: str) -> DataFrame:
    """``docs`` with the score of every row, for filtering rows in place."""

    def score(texts: list) -> np.ndarray:
        return model.score(np.array([document_statistics(t or "") for t in texts]).reshape(len(texts), len(STATISTICS)))

    return with_text_value(docs, text, name, "double", score)
