"""Secret scan: fixed patterns, and character Markov models of random strings against ordinary identifiers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.llm.columns import with_text_value
from clientele.llm.shared import fresh_name, stored
from clientele.llm.words import slices

# Fixed patterns; letters of the assignment keys stand in either case, ASCII only.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of 24 or more always starts where its maximal run starts
KINDS = ("assign", "access", "hex", "random")
KEY_PARTS = ("passw", "secret", "token", "api")
# Candidates of the Markov models: long runs of characters that keys are made of.
LEAST = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WIDTH = len(SYMBOLS) + 1  # 0 stands for a token's edge
SYMBOL_OF = np.zeros(256, dtype=np.int64)
SYMBOL_OF[[ord(c) for c in SYMBOLS]] = np.arange(1, WIDTH)

Span = tuple[int, str, int]


def _pairs(token: str) -> np.ndarray:
    """Transition cells of a token, from its edge on."""
    codes = SYMBOL_OF[np.frombuffer(token.encode("ascii", "replace"), dtype=np.uint8)]
    cells = np.concatenate([[0], codes[:-1]]) * WIDTH + codes
    return cells[codes > 0]


def base_spans(text: str) -> list[tuple[int, str, int, str]]:
    """(start, kind, end, secret part) of the fixed patterns, by start and then in the order of kinds."""
    found = []
    lowered = text.lower()
    if any(k in lowered for k in KEY_PARTS):
        found += [(m.start(), "assign", m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end(), m[0][4:]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if CANDIDATE.search(text):
        found += [(m.start(), "hex", m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


def candidates(text: str, base: list[tuple[int, str, int, str]]) -> list[tuple[int, int, str]]:
    """Long key-like runs with a letter in them, without what base spans cover: every piece that is left and still long
    enough."""
    found = []
    for m in CANDIDATE.finditer(text):
        at, pieces = m.start(), []
        for start, _, end, _ in base:
            if start < m.end() and end > at:
                pieces.append((at, start))
                at = max(at, end)
        pieces.append((at, m.end()))
        found += [(s, e, text[s:e]) for s, e in pieces if e - s >= LEAST and any(c.isalpha() for c in text[s:e])]
    return found


@dataclass(frozen=True)
class MarkovSettings:
    """A candidate is reported if the random model beats the identifier model by ``per_character`` nats per character
    and ``in_all`` nats; ``uniform`` is the share of the flat distribution mixed into the model of random strings."""

    per_character: float = 1.0
    in_all: float = 20.0
    uniform: float = 0.5
    smoothing: float = 0.5


@dataclass(frozen=True)
class MarkovModels:
    """Log-likelihood ratio of every transition: random string over identifier."""

    ratio: np.ndarray
    settings: MarkovSettings

    def is_random(self, token: str) -> bool:
        total = float(self.ratio[_pairs(token)].sum())
        return total >= self.settings.in_all and total >= self.settings.per_character * len(token)


def fit_markov(random: np.ndarray, ordinary: np.ndarray, settings: MarkovSettings = MarkovSettings()) -> MarkovModels:
    """Both models from transition counts (flat, WIDTH x WIDTH), smoothed towards each symbol's overall share."""

    def model(counts: np.ndarray) -> np.ndarray:
        square = np.maximum(counts.astype(float).reshape(WIDTH, WIDTH), 0.0)
        overall = square.sum(axis=0) + settings.smoothing
        overall[0] = 0.0
        overall /= overall.sum()
        rows = square + WIDTH * settings.smoothing * overall
        return rows / rows.sum(axis=1, keepdims=True)

    flat = np.full((WIDTH, WIDTH), 1 / (WIDTH - 1))
    mixed = (1 - settings.uniform) * model(random) + settings.uniform * flat
    plain = 0.999 * model(ordinary) + 0.001 * flat
    with np.errstate(divide="ignore"):
        ratio = np.log(mixed) - np.log(plain)
    ratio[:, 0] = 0.0
    return MarkovModels(ratio.ravel(), settings)


FOUND = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))
LOOSE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("token", pa.string())]))
CELLS = pa.list_(pa.struct([("cell", pa.int64()), ("n", pa.int64())]))


def _cells(counts: np.ndarray, offset: int) -> list[dict]:
    at = np.flatnonzero(counts)
    return [{"cell": c + offset, "n": n} for c, n in zip(at.tolist(), counts[at].tolist())]


def _scan_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document its base spans and candidates; per slice one more row with the transition counts of both kinds."""
    for batch, data, offsets in slices(batches):
        codes = SYMBOL_OF[data]
        before = np.concatenate([[0], codes[:-1]]) if len(codes) else codes
        edges = offsets[:-1][offsets[:-1] < len(codes)]
        before[edges] = 0
        inside = codes > 0
        all_counts = np.bincount(before[inside] * WIDTH + codes[inside], minlength=WIDTH * WIDTH)
        random = np.zeros(WIDTH * WIDTH, dtype=np.int64)
        spans, loose = [], []
        for text in batch.column(1).to_pylist():
            text = text or ""
            base = base_spans(text)
            for start, _, end, part in base:
                np.add.at(random, _pairs(part), 1)
                np.subtract.at(all_counts, _pairs(text[start:end]), 1)
            spans.append([{"start": s, "kind": k, "end": e} for s, k, e, _ in base])
            loose.append([{"start": s, "end": e, "token": t} for s, e, t in candidates(text, base)])
        nothing = [[]] * len(spans)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([True] * len(spans)), pa.array(spans, FOUND), pa.array(loose, LOOSE), pa.array(nothing, CELLS)],
            ["id", "is_row", "base", "loose", "cells"],
        )
        cells = _cells(random, 0) + _cells(np.maximum(all_counts, 0), WIDTH * WIDTH)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, batch.column(0).type), pa.array([False]), pa.array([[]], FOUND), pa.array([[]], LOOSE), pa.array([cells], CELLS)],
            ["id", "is_row", "base", "loose", "cells"],
        )


def scan_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored result of one pass over the texts: base spans, candidates and the counts that train the models."""
    kind = dict(docs.dtypes)[doc_id]
    schema = (
        f"id {kind}, is_row boolean, base array<struct<start:long,kind:string,end:long>>, "
        "loose array<struct<start:long,end:long,token:string>>, cells array<struct<cell:long,n:long>>"
    )
    return stored(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(_scan_rows, schema))


def train_markov(table: DataFrame, settings: MarkovSettings = MarkovSettings()) -> MarkovModels:
    """Models from the labelled samples of a scan: secrets that the patterns found, and all other tokens of all texts.

    The alphabet bounds what reaches the driver: at most 2 x WIDTH^2 counts.
    """
    cells = table.filter(~F.col("is_row")).select(F.explode("cells").alias("c")).groupBy("c.cell").agg(F.sum("c.n").alias("n"))
    counts = np.zeros(2 * WIDTH * WIDTH)
    for r in cells.collect():
        counts[r["cell"]] = r["n"]
    return fit_markov(counts[: WIDTH * WIDTH], counts[WIDTH * WIDTH :], settings)


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: MarkovSettings = MarkovSettings()) -> DataFrame:
    """``doc_id``, base and spans (arrays of start, kind, end; code points, end exclusive) for every row.

    ``spans`` holds the base spans and those that only the models find (kind ``random``), by start and kind. A null
    text is an empty one. Without any pattern match the random model is flat; without any text nothing is reported.
    """
    table = scan_table(docs, doc_id, text)
    held = docs.sparkSession.sparkContext.broadcast(train_markov(table, settings))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for base, loose in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                found = base + [{"start": x["start"], "kind": "random", "end": x["end"]} for x in loose if held.value.is_random(x["token"])]
                spans.append(sorted(found, key=lambda s: (s["start"], KINDS.index(s["kind"]))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, FOUND)], ["id", "base", "spans"])

    kind = "array<struct<start:long,kind:string,end:long>>"
    rows = table.filter("is_row").select("id", "base", "loose")
    return rows.mapInArrow(judge, f"id {dict(docs.dtypes)[doc_id]}, base {kind}, spans {kind}").withColumnRenamed("id", doc_id)


def spans_as_text(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(F.col(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: str | None, models: MarkovModels, mark: str) -> str | None:
    """The text with every (merged) secret span replaced by a mark; texts without secrets stay as they are."""
    if not text:
        return text
    base = base_spans(text)
    spans = sorted([(s, e) for s, _, e, _ in base] + [(s, e) for s, e, t in candidates(text, base) if models.is_random(t)])
    out, at = [], 0
    for start, end in spans:
        if start > at or not out:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:] if spans else text


def without_secrets(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", mark: str = "[SECRET]", settings: MarkovSettings = MarkovSettings()
) -> DataFrame:
    """``docs`` with secrets in the text replaced by a mark; the models are trained on ``docs`` first."""
    held = docs.sparkSession.sparkContext.broadcast(train_markov(scan_table(docs, doc_id, text), settings))
    name = fresh_name(docs, "clean")
    cleaned = with_text_value(docs, text, name, "string", lambda texts: [redact(t, held.value, mark) for t in texts])
    return cleaned.withColumn(text, F.col(name)).drop(name)
