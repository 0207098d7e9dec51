"""Exact order statistics that never gather a whole column in one task.

The built-in ``percentile`` keeps every distinct value of a group in one buffer. That is used only below
``ONE_TASK_VALUES`` values. Above it, each pass narrows a bracket around the wanted rank: one shuffle-free aggregate
counts the values below and inside the bracket and sketches a thinned share of the inside with
``percentile_approx``; the sketch proposes the next bracket and the next pass's exact counts confirm it or reopen it.
So thinning affects speed, never the result. A pass shrinks a bracket about sixty times, so a trillion values need five
or six cheap passes. Values that repeat billions of times sit on a bracket edge, where they are counted, never gathered.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ONE_TASK_VALUES = 100_000
SKETCHED_VALUES = 250_000
SKETCH_ACCURACY = 2_000
SKETCH_STEPS = 500
DRAW = "__draw"
SKETCH_SLACK = 0.007  # five standard errors of a thinned rank plus the sketch's own error

Group = object
Key = tuple[Group, str]


@dataclass
class _Bracket:
    """The wanted value lies in [low, high]; column values are finite, so infinity means unbounded."""

    rank: int
    expected: float  # values thought to lie inside
    low: float = -math.inf
    high: float = math.inf
    value: float | None = None
    strict: int | None = None  # values strictly inside, known once few enough remain
    strict_rank: int | None = None


def quantile_ranks(count: int, probability: float) -> tuple[int, int, float]:
    """Zero-based neighbours and the weight of the upper one, linear interpolation between closest ranks."""
    position = (count - 1) * probability
    lower = math.floor(position)
    upper = math.ceil(position)
    return lower, upper, position - lower


def value_counts(
    frame: DataFrame, columns: Mapping[str, Column], by: str | None = None
) -> dict[Key, int]:
    """Non-missing values per group and column."""
    counts = [F.count(column).alias(f"n{i}") for i, column in enumerate(columns.values())]
    grouped = frame.groupBy(by) if by else frame.groupBy()
    return {
        (row[by] if by else None, name): row[f"n{i}"]
        for row in grouped.agg(*counts).collect()
        for i, name in enumerate(columns)
    }


def exact_quantiles(
    frame: DataFrame,
    columns: Mapping[str, Column],
    probabilities: Sequence[float],
    by: str | None = None,
    counts: Mapping[Key, int] | None = None,
    one_task_values: int = ONE_TASK_VALUES,
) -> dict[Key, list[float | None]]:
    """Interpolated quantiles per ``(group, column)``; ``by`` must be a column with few values."""
    if counts is None:
        counts = value_counts(frame, columns, by)
    wanted = {
        key: sorted({r for q in probabilities for r in quantile_ranks(n, q)[:2]}) for key, n in counts.items() if n
    }
    found = order_statistics(frame, columns, wanted, counts, by, one_task_values)
    result: dict[Key, list[float | None]] = {}
    for key, n in counts.items():
        if not n:
            result[key] = [None] * len(probabilities)
            continue
        values = []
        for q in probabilities:
            lower, upper, weight = quantile_ranks(n, q)
            a, b = found[key][lower], found[key][upper]
            values.append(a + (b - a) * weight)
        result[key] = values
    return result


def order_statistics(
    frame: DataFrame,
    columns: Mapping[str, Column],
    ranks: Mapping[Key, Sequence[int]],
    counts: Mapping[Key, int],
    by: str | None = None,
    one_task_values: int = ONE_TASK_VALUES,
) -> dict[Key, dict[int, float]]:
    """Values at the given zero-based ranks of each ``(group, column)``."""
    small = {key: list(ranks[key]) for key in ranks if counts[key] <= one_task_values}
    result = _in_one_task(frame, columns, small, counts, by) if small else {}
    large = {key: [_Bracket(rank, counts[key]) for rank in ranks[key]] for key in ranks if counts[key] > one_task_values}
    if large:
        _narrow(frame, columns, large, by, one_task_values)
        result.update({key: {b.rank: b.value for b in brackets} for key, brackets in large.items()})
    return result


def _in_one_task(
    frame: DataFrame, columns: Mapping[str, Column], ranks: dict[Key, list[int]], counts: Mapping[Key, int], by: str | None
) -> dict[Key, dict[int, float]]:
    names = [name for name in columns if any(key[1] == name for key in ranks)]
    groups = sorted({key[0] for key in ranks}, key=repr)
    probabilities = {
        key: [r / (counts[key] - 1) if counts[key] > 1 else 0.0 for r in wanted] for key, wanted in ranks.items()
    }
    result: dict[Key, dict[int, float]] = {}

    def read(row, group):
        for i, name in enumerate(names):
            if (group, name) in ranks:
                result[(group, name)] = dict(zip(ranks[(group, name)], row[f"q{i}"]))

    if by is None:
        row = frame.agg(
            *[
                F.percentile(columns[name], F.array(*map(F.lit, probabilities[(None, name)]))).alias(f"q{i}")
                for i, name in enumerate(names)
            ]
        ).first()
        read(row, None)
        return result
    # Probabilities differ by group, so every group asks for the union and keeps its own.
    asked = {
        name: sorted({p for group in groups for p in probabilities.get((group, name), ())}) for name in names
    }
    rows = (
        frame.filter(F.col(by).isin(groups))
        .groupBy(by)
        .agg(*[F.percentile(columns[n], F.array(*map(F.lit, asked[n]))).alias(f"q{i}") for i, n in enumerate(names)])
        .collect()
    )
    for row in rows:
        group = row[by]
        for i, name in enumerate(names):
            if (group, name) in ranks:
                at = dict(zip(asked[name], row[f"q{i}"]))
                result[(group, name)] = {
                    r: at[p] for r, p in zip(ranks[(group, name)], probabilities[(group, name)])
                }
    return result


def _narrow(
    frame: DataFrame,
    columns: Mapping[str, Column],
    brackets: dict[Key, list[_Bracket]],
    by: str | None,
    one_task_values: int,
) -> None:
    # Parsed once: five hundred single literals would cost a driver round trip each.
    grid = F.expr("array(" + ", ".join(f"{i / SKETCH_STEPS!r}D" for i in range(SKETCH_STEPS + 1)) + ")")
    while True:
        slots = _slots(brackets, lambda bracket: bracket.value is None and bracket.strict is None)
        if not slots:
            break
        aggregates = []
        for i, ((name, _), spans) in enumerate(slots.items()):
            value, low, high = columns[name], *_edges(spans, by)
            strict = F.when((value > low) & (value < high), value)
            rate = _by_group(spans, by, lambda bracket: min(1.0, SKETCHED_VALUES / max(bracket.expected, 1.0)))
            thinned = F.when(F.col(DRAW) < rate, strict)
            aggregates.append(
                F.struct(
                    F.count_if(value < low).alias("below"),
                    F.count_if(value == low).alias("at_low"),
                    F.count(strict).alias("strict"),
                    F.percentile_approx(thinned, grid, F.lit(SKETCH_ACCURACY)).alias("sketch"),
                ).alias(f"s{i}")
            )
        drawn = frame.withColumn(DRAW, F.rand(1))
        for row in (drawn.groupBy(by) if by else drawn.groupBy()).agg(*aggregates).collect():
            group = row[by] if by else None
            for i, spans in enumerate(slots.values()):
                for bracket in spans.get(group, ()):
                    _settle(row[f"s{i}"], bracket, one_task_values)

    # What is left lies strictly inside a bracket that holds few values.
    slots = _slots(brackets, lambda bracket: bracket.value is None)
    if not slots:
        return
    inside, ranks, sizes = {}, {}, {}
    for (name, slot), spans in slots.items():
        label = f"{slot}:{name}"
        low, high = _edges(spans, by)
        inside[label] = F.when((columns[name] > low) & (columns[name] < high), columns[name])
        for group, members in spans.items():
            ranks[(group, label)] = [bracket.strict_rank for bracket in members]
            sizes[(group, label)] = members[0].strict
    picked = _in_one_task(frame, inside, ranks, sizes, by)
    for (name, slot), spans in slots.items():
        for group, members in spans.items():
            for bracket in members:
                bracket.value = picked[(group, f"{slot}:{name}")][bracket.strict_rank]


def _slots(
    brackets: dict[Key, list[_Bracket]], unfinished: Callable[[_Bracket], bool]
) -> dict[tuple[str, int], dict[Group, list[_Bracket]]]:
    """Unfinished brackets by (column, slot) and group; ranks that share a bracket share its slot."""
    slots: dict[tuple[str, int], dict[Group, list[_Bracket]]] = {}
    for (group, name), members in brackets.items():
        spans: dict[tuple[float, float], list[_Bracket]] = {}
        for bracket in filter(unfinished, members):
            spans.setdefault((bracket.low, bracket.high), []).append(bracket)
        for slot, shared in enumerate(spans.values()):
            slots.setdefault((name, slot), {})[group] = shared
    return slots


def _by_group(spans: dict[Group, list[_Bracket]], by: str | None, pick: Callable[[_Bracket], float]) -> Column:
    """A number of each group's bracket as a literal, or as a choice by group (null for groups that are done)."""
    if by is None:
        (members,) = spans.values()
        return F.lit(pick(members[0]))
    choice = None
    for group, members in spans.items():
        here, number = F.col(by) == F.lit(group), pick(members[0])
        choice = F.when(here, number) if choice is None else choice.when(here, number)
    return choice


def _edges(spans: dict[Group, list[_Bracket]], by: str | None) -> tuple[Column, Column]:
    return _by_group(spans, by, lambda bracket: bracket.low), _by_group(spans, by, lambda bracket: bracket.high)


def _settle(found, bracket: _Bracket, one_task_values: int) -> None:
    below, at_low, strict, sketch = found["below"], found["at_low"], found["strict"], found["sketch"]
    inner = bracket.rank - below - at_low
    if bracket.rank < below:
        # The sketch promised too high a lower edge.
        bracket.low, bracket.high, bracket.expected = -math.inf, bracket.low, below
    elif inner < 0:
        bracket.value = bracket.low
    elif inner >= strict:
        # The upper edge itself, or a value beyond it after a poor sketch.
        bracket.low, bracket.high = bracket.high, math.inf
    elif strict <= one_task_values:
        bracket.strict, bracket.strict_rank = strict, inner
    else:
        bracket.expected = strict
        if not sketch:
            return  # nothing was drawn: the count just made sets the next share
        share = inner / (strict - 1)
        first = math.floor((share - SKETCH_SLACK) * SKETCH_STEPS)
        last = math.ceil((share + SKETCH_SLACK) * SKETCH_STEPS)
        if first >= 0:
            bracket.low = sketch[first]
        if last <= SKETCH_STEPS:
            bracket.high = sketch[last]
        bracket.expected = strict * (min(last, SKETCH_STEPS) - max(first, 0)) / SKETCH_STEPS
