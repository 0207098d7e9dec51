"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams, skip-grams and word heads."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.llm.words import U64, WordTable, mixed, slices

GATE_BITS = 20


@dataclass(frozen=True)
class FtrlSettings:
    """``max_labelled`` rows at most (by hash of their id) are learned from, in parallel parts of ``part_rows`` rows
    whose weights are averaged; each part makes ``epochs`` passes with per-coordinate rates and an L1 term that zeroes most weights."""

    max_labelled: int = 24_000
    part_rows: int = 3_000
    epochs: int = 4
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 0.5
    min_docs: int = 2


def grams(table: WordTable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, feature hash) of words, pairs, pairs with one word between, and heads of four and five bytes."""
    yield table.row, table.hash
    for gap in (1, 2):
        n = max(len(table.hash) - gap, 0)
        same = table.row[:n] == table.row[gap:]
        both = mixed(table.hash[:n] * U64(31) + table.hash[gap:] + U64(gap))
        yield table.row[:n][same], both[same]
    for size in (4, 5):
        heads = table.head_hash(size)
        keep = heads != 0
        yield table.row[keep], heads[keep]


def _features(texts: pd.Series) -> list[np.ndarray]:
    """Distinct feature hashes of each text."""
    column = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    found = []
    for _, data, offsets in slices(iter([column])):
        table = WordTable(data, offsets)
        parts = [np.unique(np.concatenate([h[np.searchsorted(r, i) : np.searchsorted(r, i, "right")] for r, h in per])) for per in [list(grams(table))] for i in range(table.rows)]
        found.extend(parts)
    return found


def ftrl_weights(documents: list[np.ndarray], labels: np.ndarray, settings: FtrlSettings, seed: int = 11) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, bias): non-zero weights after ``epochs`` passes over the documents in seeded order."""
    names, inverse, counts = np.unique(np.concatenate(documents), return_inverse=True, return_counts=True)
    ends = np.cumsum([len(d) for d in documents])
    rows = [r[counts[r] >= settings.min_docs] for r in np.split(inverse, ends[:-1])]
    z, n = np.zeros(len(names)), np.zeros(len(names))
    bias_z = bias_n = 0.0
    order = np.random.default_rng(seed)

    def weight(z, n):
        w = -(z - np.sign(z) * settings.l1) / ((settings.beta + np.sqrt(n)) / settings.alpha + settings.l2)
        return np.where(np.abs(z) <= settings.l1, 0.0, w)

    for _ in range(settings.epochs):
        for i in order.permutation(len(rows)):
            at = rows[i]
            zi, ni = z[at], n[at]
            w = weight(zi, ni)
            bias = -bias_z / ((settings.beta + bias_n**0.5) / settings.alpha)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -30, 30)))
            g = p - labels[i]
            step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / settings.alpha
            z[at] = zi + g - step * w
            n[at] = ni + g * g
            step = ((bias_n + g * g) ** 0.5 - bias_n**0.5) / settings.alpha
            bias_z += g - step * bias
            bias_n += g * g
    w = weight(z, n)
    kept = w != 0
    return names[kept], w[kept], -bias_z / ((settings.beta + bias_n**0.5) / settings.alpha)


@dataclass(frozen=True)
class ToxicityModel:
    """Sorted feature hashes with their weights, a gate bitmap over hash bits, and the bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def gate(self) -> np.ndarray:
        bits = np.zeros(1 << GATE_BITS, dtype=bool)
        bits[(self.features >> U64(64 - GATE_BITS)).astype(np.int64)] = True
        return bits

    def margins(self, table: WordTable, gate: np.ndarray) -> np.ndarray:
        total = np.full(table.rows, self.bias)
        rows, hashes = [np.empty(0, np.int64)], [np.empty(0, U64)]
        for row, found in grams(table):
            near = gate[(found >> U64(64 - GATE_BITS)).astype(np.int64)]
            rows.append(row[near])
            hashes.append(found[near])
        row, found = np.concatenate(rows), np.concatenate(hashes)
        if not len(self.features) or not len(found):
            return total
        at = np.minimum(np.searchsorted(self.features, found), len(self.features) - 1)
        hit = self.features[at] == found
        pairs = np.unique(row[hit] * len(self.features) + at[hit])
        np.add.at(total, pairs // len(self.features), self.weights[pairs % len(self.features)])
        return total


def train_toxicity(
    docs: DataFrame, labels: DataFrame, usable: Column, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id",
    label: str = "toxic", settings: FtrlSettings = FtrlSettings(),
) -> ToxicityModel:
    """Learn from labelled rows for which ``usable`` (over ``id``) holds; without both classes the model is a constant.

    At most about ``max_labelled`` label rows are used, so they can be sent to all executors: texts are not shuffled to
    find them. Weights reach the driver: the L1 term leaves a few thousand, and the sample bounds them.
    """
    marked = labels.filter(F.col(label).isin(0, 1)).select(F.col(label_id).alias("id"), F.col(label).cast("int").alias("label")).filter(usable)
    share = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(share.values())
    if len(share) < 2:
        return ToxicityModel(np.empty(0, U64), np.empty(0), 30.0 if share.get(1) else -30.0)
    if total > settings.max_labelled:
        marked = marked.filter(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1_000_000)) < int(1_000_000 * settings.max_labelled / total))
    parts = max(1, math.ceil(min(total, settings.max_labelled) / settings.part_rows))
    bodies = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(marked), "id")
    parted = bodies.select("id", F.coalesce("text", F.lit("")).alias("text"), "label", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        names, weights, bias = ftrl_weights(_features(frame["text"]), frame["label"].to_numpy(float), settings)
        return pd.DataFrame({"feature": np.append(names.view(np.int64), 0), "weight": np.append(weights, bias), "is_bias": np.append(np.zeros(len(names), bool), True)})

    found = parted.groupBy("part").applyInPandas(fit, "feature long, weight double, is_bias boolean")
    # Every part counts in the mean, also where its weight is zero.
    summed = found.groupBy("is_bias", "feature").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n")).toPandas()
    own, bias = summed[~summed["is_bias"]], summed[summed["is_bias"]]
    parts = int(bias["n"].iloc[0])
    features = own["feature"].to_numpy(np.int64).view(U64)
    order = np.argsort(features)
    return ToxicityModel(features[order], own["weight"].to_numpy()[order] / parts, float(bias["weight"].iloc[0]) / parts)


def scored_toxicity(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(``doc_id``, score) for every row; null and empty texts score what the bias says."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        gate = held.value.gate()
        for batch, data, offsets in slices(batches):
            margin = held.value.margins(WordTable(data, offsets), gate)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(margin, -40, 40))))], ["id", "score"])

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(score, f"id {dict(docs.dtypes)[doc_id]}, score double").withColumnRenamed("id", doc_id)
