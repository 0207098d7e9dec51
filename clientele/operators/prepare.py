"""Preparation of segmentation bases: fit a handful of aggregates once, then apply one projection.

Fitting costs a few aggregates over the needed columns, whatever their number:

1. counts, missing and unreadable values;
2. the exact order statistics behind the median and the 1 % / 99 % bounds: one job for small tables, a few
   shuffle-free passes for large ones;
3. moments of the clipped values, raw and on the log scale, so that no further pass is needed once skew is known;
4. level counts of categorical bases, the only step with a shuffle.

The fitted ``PrepModel`` is a few numbers per column. Applying it is a projection without shuffle or UDF.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.errors import DataProblem
from clientele.functions import rules
from clientele.functions.coerce import NUMBER_TEXT, dtype_of, is_number, is_text, missing, quoted, to_label, to_number
from clientele.functions.quantiles import ONE_TASK_VALUES, order_statistics, quantile_ranks

CONSTANT_SPREAD = 1e-12
LOWER_SHARE, UPPER_SHARE = 0.01, 0.99
RARE_SHARE = 0.01
STRONG_SKEW = 1.0


@dataclass(frozen=True)
class PreprocessConfig:
    """Choices applied before clustering."""

    numeric_columns: tuple[str, ...]
    categorical_columns: tuple[str, ...] = ()
    clip_outliers: bool = True
    log_skewed: bool = True
    standardize: bool = True
    categorical_weight: float = 1.0
    max_categories: int = 20


@dataclass(frozen=True)
class NumericStep:
    """Everything needed to turn one raw numeric column into one model column."""

    column: str
    median: float
    lower: float | None = None
    upper: float | None = None
    log: bool = False
    mean: float = 0.0
    scale: float = 1.0

    def expression(self, raw: Column) -> Column:
        value = F.coalesce(raw, F.lit(self.median))
        if self.lower is not None:
            value = F.greatest(F.least(value, F.lit(self.upper)), F.lit(self.lower))
        if self.log:
            value = F.log1p(value)
        if self.mean != 0.0 or self.scale != 1.0:
            value = (value - F.lit(self.mean)) / F.lit(self.scale)
        return value


@dataclass(frozen=True)
class LevelStep:
    """Kept levels of one categorical column; ``rest`` says whether an indicator for all other levels exists."""

    column: str
    kept: tuple[str, ...]
    rest: bool
    names: tuple[str, ...] = ()
    minimum_count: int = 2
    levels: int = 0


@dataclass
class PrepModel:
    """Fitted preparation: steps, model column names, warnings and audit trail."""

    config: PreprocessConfig
    numeric: list[NumericStep]
    categorical: list[LevelStep]
    feature_names: list[str]
    warnings: list[str] = field(default_factory=list)
    audit: dict[str, object] = field(default_factory=dict)

    def feature_columns(self, frame: DataFrame, within: str | None = None) -> list[Column]:
        """Model columns in order, named ``f_0`` … ``f_{p-1}``; ``within`` names a struct that holds the raw columns."""

        def raw(name: str) -> Column:
            return F.col(within).getField(name) if within else quoted(name)

        columns: list[Column] = []
        for step in self.numeric:
            columns.append(step.expression(to_number(raw(step.column), dtype_of(frame, step.column))))
        weight = self.config.categorical_weight
        for step in self.categorical:
            label = to_label(raw(step.column), dtype_of(frame, step.column))
            columns += [F.when(label == F.lit(level), weight).otherwise(0.0) for level in step.kept]
            if step.rest:
                columns.append(F.when(label.isin(*step.kept), 0.0).otherwise(weight))
        return [column.cast("double").alias(f"f_{i}") for i, column in enumerate(columns)]

    def transform(self, frame: DataFrame, id_column: str, keep: Sequence[str] = ()) -> DataFrame:
        """Wide prepared table: the id, any kept columns, and one DOUBLE column per feature."""
        return frame.select(
            quoted(id_column).alias("id"), *[quoted(name) for name in keep], *self.feature_columns(frame)
        )

    def matrix(self, frame: DataFrame, id_column: str) -> DataFrame:
        """Prepared table for fits: ``(id, features)`` with one vector column."""
        return frame.select(
            quoted(id_column).alias("id"),
            array_to_vector(F.array(*self.feature_columns(frame))).alias("features"),
        )

    def attach(self, frame: DataFrame, source: str) -> DataFrame:
        """Add ``features`` to a table that carries the raw columns inside the struct column ``source``."""
        raw = frame.select(f"{source}.*")
        columns = self.feature_columns(raw, within=source)
        return frame.withColumn("features", array_to_vector(F.array(*columns)))

    def audit_table(self, frame: DataFrame) -> DataFrame:
        """The audit trail as rows ``(field, value)``."""
        rows = [(key, json.dumps(value, sort_keys=True, default=str)) for key, value in self.audit.items()]
        return frame.sparkSession.createDataFrame(rows, "field string, value string")


def infer_feature_types(frame: DataFrame, columns: Sequence[str]) -> tuple[list[str], list[str]]:
    """Split columns into numeric and categorical; text counts as numeric when 90 % of its values parse."""
    text = [name for name in columns if is_text(dtype_of(frame, name))]
    parsed = set()
    if text:
        row = frame.agg(
            *[
                F.struct(
                    F.count(quoted(name)).alias("present"),
                    F.count_if(quoted(name).rlike(NUMBER_TEXT)).alias("read"),
                ).alias(f"t{i}")
                for i, name in enumerate(text)
            ]
        ).first()
        for i, name in enumerate(text):
            present, read = row[f"t{i}"]
            if present and read / present >= rules.NUMERIC_SHARE:
                parsed.add(name)
    numeric = [name for name in columns if is_number(dtype_of(frame, name)) or name in parsed]
    return numeric, [name for name in columns if name not in numeric]


def prepare_features(
    frame: DataFrame,
    config: PreprocessConfig,
    one_task_values: int = ONE_TASK_VALUES,
) -> PrepModel:
    """Fit the preparation. Apply it with ``PrepModel.transform`` or ``PrepModel.matrix``."""
    selected = list(config.numeric_columns) + list(config.categorical_columns)
    if not selected:
        raise DataProblem("No basis variable was chosen.")
    absent = [name for name in selected if name not in frame.columns]
    if absent:
        raise DataProblem("Columns not found: " + ", ".join(absent))

    facts = _count_pass(frame, config)
    rows = facts["rows"]
    if rows < 3:
        raise DataProblem("Segmentation needs three rows or more.")
    warnings: list[str] = []
    audit: dict[str, object] = {"rows": rows, "source_features": len(selected)}

    numeric = _fit_numeric(frame, config, facts, warnings, audit, one_task_values) if config.numeric_columns else []
    levels = _fit_levels(frame, config, rows, warnings, audit) if config.categorical_columns else []

    names = [step.column for step in numeric] + [name for step in levels for name in step.names]
    if not names:
        raise DataProblem("The chosen bases hold no usable variation.")
    if len(names) > rules.MAX_MODEL_COLUMNS:
        raise DataProblem(f"Preparation would create {len(names)} model columns; the limit is {rules.MAX_MODEL_COLUMNS}.")
    if len(names) > max(50, rows // 3):
        warnings.append("The model has many columns for this number of customers.")

    unreadable = audit.get("numeric_parse_failures", {})
    audit["model_features"] = len(names)
    audit["missing_values_imputed"] = sum(facts["missing"].values()) + sum(unreadable.values())
    for key in ("numeric_columns", "categorical_columns"):
        audit[key] = list(getattr(config, key))
    for key in ("clip_outliers", "log_skewed", "standardize", "categorical_weight", "max_categories"):
        audit[key] = getattr(config, key)
    audit["feature_names"] = names
    audit["warnings"] = warnings
    return PrepModel(config, numeric, levels, names, warnings, audit)


def _count_pass(frame: DataFrame, config: PreprocessConfig) -> dict:
    """Rows, raw missing values of every basis, and readable values with their moments of numeric bases."""
    aggregates = [F.count(F.lit(1)).alias("rows")]
    selected = list(config.numeric_columns) + list(config.categorical_columns)
    for i, name in enumerate(selected):
        aggregates.append(F.count_if(missing(quoted(name), dtype_of(frame, name))).alias(f"m{i}"))
    for i, name in enumerate(config.numeric_columns):
        value = to_number(quoted(name), dtype_of(frame, name))
        aggregates.append(
            F.struct(
                F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("variance")
            ).alias(f"v{i}")
        )
    row = frame.agg(*aggregates).first()
    return {
        "rows": row["rows"],
        "missing": {name: row[f"m{i}"] for i, name in enumerate(selected)},
        "read": {name: row[f"v{i}"] for i, name in enumerate(config.numeric_columns)},
    }


def missing_audit(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per numeric basis: rows, raw missing, unreadable, share missing after coercion, and the heavy flag."""
    cells = []
    for name in columns:
        raw, dtype = quoted(name), dtype_of(frame, name)
        gap = missing(raw, dtype)
        unread = ~gap & to_number(raw, dtype).isNull()
        cells.append(F.struct(F.lit(name).alias("column"), F.count(F.lit(1)).alias("rows"),
                              F.count_if(gap).alias("missing"), F.count_if(unread).alias("unreadable")))
    share = (F.col("missing") + F.col("unreadable")) / F.col("rows")
    return frame.agg(F.array(*cells).alias("cells")).select(F.inline("cells")).select(
        "*", share.alias("missing_share"), (share > rules.HEAVY_MISSING).alias("heavy")
    )


def _imputed_value(at: dict[int, float], rank: int, present: int, gaps: int, median: float) -> float:
    """Value at a rank of the column after ``gaps`` copies of the median joined its ``present`` sorted values."""
    split = (present - 1) // 2
    if rank <= split:
        return at[rank]
    return median if rank <= split + gaps else at[rank - gaps]


def _needed_ranks(present: int, gaps: int) -> set[int]:
    wanted = set(quantile_ranks(present, 0.5)[:2])
    split = (present - 1) // 2
    for share in (LOWER_SHARE, UPPER_SHARE):
        for rank in quantile_ranks(present + gaps, share)[:2]:
            if rank <= split:
                wanted.add(rank)
            elif rank > split + gaps:
                wanted.add(rank - gaps)
    return wanted


def _fit_numeric(
    frame: DataFrame,
    config: PreprocessConfig,
    facts: dict,
    warnings: list[str],
    audit: dict[str, object],
    one_task_values: int,
) -> list[NumericStep]:
    rows, names = facts["rows"], list(config.numeric_columns)
    present = {name: facts["read"][name]["n"] for name in names}
    unreadable = {name: rows - facts["missing"][name] - present[name] for name in names}
    unreadable = {name: count for name, count in unreadable.items() if count}
    if unreadable:
        audit["numeric_parse_failures"] = unreadable
        warnings.append(
            "Values that are not numbers were treated as missing: "
            + ", ".join(f"{name} ({count})" for name, count in unreadable.items())
        )
    audit["preexisting_missing_values"] = sum(facts["missing"][name] for name in names)
    heavy = [name for name in names if (rows - present[name]) / rows > rules.HEAVY_MISSING]
    if heavy:
        warnings.append("More than 40% missing values: " + ", ".join(heavy))

    raw = {name: to_number(quoted(name), dtype_of(frame, name)) for name in names}
    ranks = {(None, n): sorted(_needed_ranks(present[n], rows - present[n])) for n in names if present[n]}
    counts = {(None, n): present[n] for n in names}
    at = order_statistics(frame, raw, ranks, counts, one_task_values=one_task_values) if ranks else {}

    medians, bounds, dropped = {}, {}, []
    for name in names:
        if not present[name]:
            medians[name] = 0.0
            dropped.append(name)
            continue
        found, gaps = at[(None, name)], rows - present[name]
        low, high, weight = quantile_ranks(present[name], 0.5)
        median = medians[name] = found[low] + (found[high] - found[low]) * weight
        if _imputed_spread(facts["read"][name], gaps, median) < CONSTANT_SPREAD:
            dropped.append(name)
        edges = []
        for share in (LOWER_SHARE, UPPER_SHARE):
            low, high, weight = quantile_ranks(rows, share)
            a, b = (_imputed_value(found, rank, present[name], gaps, median) for rank in (low, high))
            edges.append(a + (b - a) * weight)
        bounds[name] = edges
    audit["numeric_imputation"] = {name: medians[name] for name in names}
    if dropped:
        audit["dropped_constant_numeric"] = dropped
        warnings.append("Constant numeric columns were left out: " + ", ".join(dropped))
    kept = [name for name in names if name not in dropped]
    if not kept:
        return []
    if config.clip_outliers:
        audit["outlier_clipping"] = "1st and 99th percentiles"
        audit["clipping_bounds"] = {name: {"lower": bounds[name][0], "upper": bounds[name][1]} for name in kept}

    clipped = {
        name: NumericStep(name, medians[name], *(bounds[name] if config.clip_outliers else (None, None)))
        for name in kept
    }
    moments = _moment_pass(frame, raw, clipped)
    steps, logged = [], []
    for name in kept:
        found = moments[name]
        log = bool(config.log_skewed and found["low"] >= 0 and _corrected_skew(found["skew"], rows) > STRONG_SKEW)
        if log:
            logged.append(name)
        mean, scale = 0.0, 1.0
        if config.standardize:
            mean, scale = (found["log_mean"], found["log_std"]) if log else (found["mean"], found["std"])
            if found["low"] == found["high"]:
                scale = 1.0  # clipping made the column constant: it becomes zero
            if not (math.isfinite(mean) and math.isfinite(scale)):
                raise DataProblem(f"{name} holds values too large to standardize.")
        base = clipped[name]
        steps.append(NumericStep(name, base.median, base.lower, base.upper, log, mean, scale))
    if logged:
        audit["log1p_columns"] = logged
    audit["scaler"] = (
        {step.column: {"mean": step.mean, "scale": step.scale} for step in steps}
        if config.standardize
        else "disabled: numeric bases keep their own shared scale"
    )
    return steps


def _imputed_spread(read, gaps: int, median: float) -> float:
    """Population standard deviation after imputation, combined from the moments of the present values."""
    n = read["n"]
    total = n + gaps
    mean = (n * read["mean"] + gaps * median) / total
    squares = n * (read["variance"] + (read["mean"] - mean) ** 2) + gaps * (median - mean) ** 2
    return math.sqrt(max(squares, 0.0) / total)


def _corrected_skew(population_skew: float | None, n: int) -> float:
    if population_skew is None or math.isnan(population_skew) or n < 3:
        return 0.0
    return population_skew * math.sqrt(n * (n - 1)) / (n - 2)


def _moment_pass(frame: DataFrame, raw: dict[str, Column], clipped: dict[str, NumericStep]) -> dict:
    aggregates = []
    for i, (name, step) in enumerate(clipped.items()):
        value = step.expression(raw[name])
        logged = F.when(value > -1, F.log1p(value))
        aggregates.append(
            F.struct(
                F.min(value).alias("low"),
                F.max(value).alias("high"),
                F.when(F.min(value) < F.max(value), F.skewness(value)).alias("skew"),
                F.avg(value).alias("mean"),
                F.stddev_pop(value).alias("std"),
                F.avg(logged).alias("log_mean"),
                F.stddev_pop(logged).alias("log_std"),
            ).alias(f"c{i}")
        )
    row = frame.agg(*aggregates).first()
    return {name: row[f"c{i}"] for i, name in enumerate(clipped)}


def level_counts(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(feature, level, n)`` for categorical columns, missing values included as their own level."""
    cells = [
        F.struct(F.lit(name).alias("feature"), to_label(quoted(name), dtype_of(frame, name)).alias("level"))
        for name in columns
    ]
    return frame.select(F.inline(F.array(*cells))).groupBy("feature", "level").agg(F.count(F.lit(1)).alias("n"))


def minimum_level_count(rows: int) -> int:
    return max(2, round(rows * RARE_SHARE))


def _fit_levels(
    frame: DataFrame, config: PreprocessConfig, rows: int, warnings: list[str], audit: dict[str, object]
) -> list[LevelStep]:
    least = minimum_level_count(rows)
    # Levels at or above the minimum count number at most rows / minimum, so the gathered list stays short.
    frequent = F.when(F.col("n") >= least, F.struct("level", "n"))
    found = {
        row["feature"]: row
        for row in level_counts(frame, config.categorical_columns)
        .groupBy("feature")
        .agg(F.count(F.lit(1)).alias("levels"), F.collect_list(frequent).alias("frequent"))
        .collect()
    }
    steps, dropped, taken = [], [], set(config.numeric_columns)
    for name in config.categorical_columns:
        row = found[name]
        if row["levels"] > 2 * config.max_categories:
            warnings.append(f"{name} has many categories; the infrequent ones were grouped.")
        kept = sorted((entry["n"], entry["level"]) for entry in row["frequent"])
        if config.max_categories < len(kept) + 1:
            # Ascending by (count, level): the tail holds the largest, later levels first among equals.
            kept = kept[len(kept) - (config.max_categories - 1) :]
        levels = tuple(sorted(level for _, level in kept))
        rest = row["levels"] > len(kept)
        if row["levels"] == 1 or not kept:
            dropped.append(name)  # one level, or one bucket, that every row shares
            continue
        labels = []
        for ending in levels + (("infrequent",) if rest else ()):
            label, copy = f"{name}_{ending}", 1
            while label in taken:
                copy += 1
                label = f"{name}_{ending}__{copy}"
            taken.add(label)
            labels.append(label)
        steps.append(LevelStep(name, levels, rest, tuple(labels), least, row["levels"]))
    if dropped:
        audit["dropped_constant_categorical"] = dropped
        warnings.append("Categorical columns without usable variation were left out: " + ", ".join(dropped))
    audit["categorical_encoding"] = {
        step.column: {
            "levels": step.levels,
            "kept_levels": list(step.kept),
            "model_columns": list(step.names),
            "minimum_frequency": step.minimum_count,
        }
        for step in steps
    }
    return steps
