"""Column audit, privacy notes, role suggestions and the one-row-per-customer contract.

Every column-level question is answered from one *column profile*: a DataFrame with one row per column. The profile
needs a single shuffle. Each row is unpivoted into ``(column ordinal, value key)`` and counted; equal values combine
before they are shuffled, so a value that fills a third of a column travels once per task. Long texts travel as
digests. Whether a value parses as a number or looks like an e-mail address is decided on the way, so the counts
per value also carry the shares.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientele.errors import DataProblem
from clientele.functions import rules
from clientele.functions.coerce import (
    NUMBER_TEXT,
    dtype_of,
    half_even,
    is_blank,
    is_number,
    is_text,
    missing,
    quoted,
    to_number,
)

LONGEST_PLAIN_KEY = 64


def _any_case(column: Column, pattern: str) -> Column:
    return column.rlike("(?i)" + pattern)


def _profile_cell(frame: DataFrame, ordinal: int, field: T.StructField) -> Column:
    value, dtype = quoted(field.name), field.dataType
    absent = missing(value, dtype)
    plain = is_text(dtype) or isinstance(dtype, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))
    text = value.cast("string") if plain else F.to_json(F.struct(value))
    key = F.when(F.length(text) > LONGEST_PLAIN_KEY, F.concat(F.lit("md5:"), F.md5(text))).otherwise(text)
    if is_number(dtype):
        numeric = F.lit(True)
    elif is_text(dtype):
        numeric = F.coalesce(value.rlike(NUMBER_TEXT), F.lit(False))
    else:
        numeric = F.lit(isinstance(dtype, T.BooleanType))
    mail = F.coalesce(value.rlike(rules.EMAIL_VALUE_PATTERN), F.lit(False)) if is_text(dtype) else F.lit(False)
    return F.struct(
        F.lit(ordinal).alias("ordinal"),
        F.when(~absent, key).alias("key"),
        (numeric & ~absent).alias("numeric"),
        (mail & ~absent).alias("mail"),
    )


def _column_list(frame: DataFrame) -> Column:
    """Schema facts as an array literal: they are known before any row is read."""
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("ordinal"),
                F.lit(field.name).alias("column"),
                F.lit(field.dataType.simpleString()).alias("type"),
                F.lit(is_number(field.dataType)).alias("is_number"),
                F.lit(isinstance(field.dataType, T.BooleanType)).alias("is_boolean"),
                F.lit(is_text(field.dataType)).alias("is_text"),
            )
            for i, field in enumerate(frame.schema.fields)
        ]
    )


def column_profile(frame: DataFrame, approximate: bool = False) -> DataFrame:
    """One row per column: type, rows, missing, distinct values, numeric share, e-mail share and name flags.

    ``approximate=True`` replaces the exact distinct count by a sketch and needs no shuffle of values at all.
    """
    cells = frame.select(
        F.inline(F.array(*[_profile_cell(frame, i, field) for i, field in enumerate(frame.schema.fields)]))
    )
    present = F.col("key").isNotNull()
    if approximate:
        counted = cells.groupBy("ordinal").agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(~present).alias("missing"),
            F.approx_count_distinct("key", 0.02).alias("unique"),
            F.count_if("numeric").alias("numeric"),
            F.count_if("mail").alias("mail"),
        )
    else:
        values = cells.groupBy("ordinal", "key", "numeric", "mail").agg(F.count(F.lit(1)).alias("n"))
        counted = values.groupBy("ordinal").agg(
            F.sum("n").alias("rows"),
            F.coalesce(F.sum(F.when(~present, F.col("n"))), F.lit(0)).alias("missing"),
            F.count("key").alias("unique"),
            F.coalesce(F.sum(F.when(F.col("numeric"), F.col("n"))), F.lit(0)).alias("numeric"),
            F.coalesce(F.sum(F.when(F.col("mail"), F.col("n"))), F.lit(0)).alias("mail"),
        )
    described = counted.select(
        F.element_at(_column_list(frame), F.col("ordinal") + 1).alias("about"),
        "rows",
        "missing",
        "unique",
        F.try_divide(F.col("numeric").cast("double"), F.col("rows") - F.col("missing")).alias("numeric_share"),
        F.try_divide(F.col("mail").cast("double"), F.col("rows") - F.col("missing")).alias("email_share"),
    ).select("about.*", "rows", "missing", "unique", "numeric_share", "email_share")
    name = F.col("column")
    by_name = F.coalesce(
        *[F.when(_any_case(name, pattern), F.lit(kind)) for kind, pattern in rules.DIRECT_IDENTIFIER_PATTERNS],
        F.when(F.col("email_share") > rules.EMAIL_SHARE, F.lit("email")),
    )
    unique_text = F.col("is_text") & (F.col("unique") == F.col("rows")) & _any_case(name, rules.ID_HINT_PATTERN)
    return described.select(
        "*",
        by_name.alias("pii"),
        _any_case(name, rules.SENSITIVE_PATTERN).alias("sensitive"),
        (_any_case(name, rules.ID_PATTERN) | unique_text).alias("likely_id"),
        _any_case(name, rules.DEMOGRAPHIC_PATTERN).alias("demographic"),
        _any_case(name, rules.RAW_DATE_PATTERN).alias("raw_date"),
        _any_case(name, rules.BEHAVIOUR_PATTERN).alias("behaviour"),
        _any_case(name, rules.PROFILE_PATTERN).alias("profile"),
    )


def table_overview(frame: DataFrame) -> DataFrame:
    """Rows, columns, missing cells and rows that repeat an earlier row."""
    fields = frame.schema.fields
    gaps = sum((missing(quoted(f.name), f.dataType).cast("int") for f in fields), F.lit(0))
    digest = F.md5(F.to_json(F.struct(*[quoted(f.name).alias(f"c{i}") for i, f in enumerate(fields)]), {"ignoreNullFields": "false"}))
    return (
        frame.select(digest.alias("digest"), gaps.alias("gaps"))
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("gaps").alias("gaps"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
            F.coalesce(F.sum("gaps"), F.lit(0)).alias("missing_cells"),
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
        )
        .select("rows", F.lit(len(fields)).alias("columns"), "missing_cells", "duplicate_rows")
    )


def data_quality_report(frame: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """Column-level audit in table order (``ordinal``)."""
    profile = column_profile(frame) if profile is None else profile
    return profile.select(
        "ordinal",
        "column",
        "type",
        half_even(100 * F.try_divide(F.col("missing").cast("double"), F.col("rows")), 1).alias("missing_%"),
        "unique",
        (F.col("unique") <= 1).alias("constant"),
        F.coalesce("pii", F.when(F.col("sensitive"), F.lit("sensitive")), F.lit("")).alias("privacy_note"),
        "likely_id",
    )


def likely_pii_columns(profile: DataFrame) -> DataFrame:
    return profile.filter(F.col("pii").isNotNull()).select("ordinal", "column", F.col("pii").alias("kind"))


def likely_sensitive_columns(profile: DataFrame) -> DataFrame:
    return profile.filter("sensitive").select("ordinal", "column")


def likely_id_columns(profile: DataFrame) -> DataFrame:
    return profile.filter("likely_id").select("ordinal", "column")


def _blocked(id_column: str | None) -> Column:
    blocked = F.col("pii").isNotNull() | F.col("sensitive") | F.col("likely_id") | (F.col("column") == rules.ALWAYS_BLOCKED)
    return blocked | (F.col("column") == id_column) if id_column else blocked


def _first(frame: DataFrame, limit: int) -> DataFrame:
    """First columns in table order; ``frame`` has at most one row per column of the audited table."""
    return frame.orderBy("ordinal").limit(limit)


def default_basis_columns(profile: DataFrame, id_column: str | None = None) -> DataFrame:
    """Numeric and boolean columns that vary and are neither personal, sensitive, identifying nor demographic."""
    keep = (F.col("is_number") | F.col("is_boolean")) & (F.col("unique") > 1)
    keep = keep & ~_blocked(id_column) & ~F.col("demographic")
    return _first(profile.filter(keep).select("ordinal", "column"), rules.FIRST_BASES)


def usable_basis_columns(profile: DataFrame, id_column: str | None = None) -> DataFrame:
    """Columns a clustering may use: varying, not blocked, not raw dates, and numeric-like or with few levels."""
    shape = (
        F.col("is_number")
        | F.col("is_boolean")
        | (F.coalesce("numeric_share", F.lit(0.0)) >= rules.NUMERIC_SHARE)
        | (F.col("unique") <= rules.FEW_LEVELS)
    )
    keep = (F.col("unique") > 1) & ~_blocked(id_column) & ~F.col("raw_date") & shape
    return profile.filter(keep)


def suggest_basis_columns(profile: DataFrame, id_column: str | None = None, recipe: str = "auto") -> DataFrame:
    """First twelve usable columns of a recipe: ``auto``, ``behavior``, ``profile`` or ``manual`` (none)."""
    usable = usable_basis_columns(profile, id_column)
    if recipe == "behavior":
        chosen = usable.filter("behaviour")
    elif recipe == "profile":
        chosen = usable.filter("profile")
    elif recipe == "manual":
        chosen = usable.filter(F.lit(False))
    else:
        # The usable columns are at most one row per column of the table, so one window task holds them all.
        enough = F.count_if("behaviour").over(W.partitionBy(F.lit(0))) >= 2
        chosen = usable.withColumn("enough", enough).filter(F.col("behaviour") | ~F.col("enough"))
    return _first(chosen.select("ordinal", "column"), rules.FIRST_BASES)


def starting_bases(profile: DataFrame, id_column: str, recipe: str = "auto") -> list[str]:
    """Names to start from; familiar behaviour columns win under ``auto`` when at least two are usable."""
    if recipe == "auto":
        usable = {row["column"] for row in usable_basis_columns(profile, id_column).select("column").collect()}
        familiar = [name for name in rules.FAMILIAR_BASES if name in usable]
        if len(familiar) >= 2:
            return familiar
    return [row["column"] for row in suggest_basis_columns(profile, id_column, recipe).orderBy("ordinal").collect()]


def descriptor_columns(profile: DataFrame, id_column: str, bases: Sequence[str]) -> DataFrame:
    """Columns that may describe the segments, with the first eight profile-like ones marked as suggested."""
    options = profile.filter(
        F.col("pii").isNull() & ~F.col("column").isin(*bases, id_column, rules.ALWAYS_BLOCKED)
    ).select("ordinal", "column")
    suggested = suggest_basis_columns(profile, id_column, "profile").select("column")
    hits = _first(options.join(F.broadcast(suggested), "column", "left_semi"), rules.FIRST_DESCRIPTORS)
    return options.join(F.broadcast(hits.select("column", F.lit(True).alias("suggested"))), "column", "left").select(
        "ordinal", "column", F.coalesce("suggested", F.lit(False)).alias("suggested")
    )


def transaction_roles(profile: DataFrame) -> DataFrame:
    """One row: likely customer, date, amount and order columns of a transaction log."""
    name = F.lower("column")
    ordinal = F.col("ordinal")

    def first_where(condition: Column) -> Column:
        return F.min_by("column", F.when(condition, ordinal))

    first_column = F.min_by("column", ordinal)
    return profile.agg(
        F.coalesce(first_where(F.col("likely_id")), first_column).alias("customer"),
        F.coalesce(first_where(name.contains("date") | name.contains("time")), first_column).alias("purchase_date"),
        F.coalesce(first_where(F.col("is_number")), first_column).alias("amount"),
        first_where(name.contains("order") & name.contains("id")).alias("order_id"),
    )


def customer_contract(frame: DataFrame, id_column: str, bases: Sequence[str]) -> DataFrame:
    """Counts behind the contract: rows, blank ids, rows whose id repeats, and bases that vary.

    Ids are counted per value before anything is gathered; a basis varies when its smallest and largest value (or
    value hash) differ, which needs only two fixed-size buffers per basis.
    """
    ends = []
    for i, name in enumerate(bases):
        value, dtype = quoted(name), dtype_of(frame, name)
        value = F.when(~missing(value, dtype), value if is_number(dtype) else F.xxhash64(value))
        ends += [F.min(value).alias(f"lo{i}"), F.max(value).alias(f"hi{i}")]
    per_id = frame.groupBy(quoted(id_column).alias("__id")).agg(F.count(F.lit(1)).alias("__n"), *ends)
    varying = sum(
        (F.coalesce(F.min(f"lo{i}") < F.max(f"hi{i}"), F.lit(False)).cast("int") for i in range(len(bases))), F.lit(0)
    )
    n = F.col("__n")
    return per_id.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(is_blank(F.col("__id")), n)), F.lit(0)).alias("blank_ids"),
        F.coalesce(F.sum(F.when(n > 1, n)), F.lit(0)).alias("repeated_id_rows"),
        varying.alias("varying_bases"),
    )


def validate_customer_table(
    frame: DataFrame, id_column: str, basis_columns: Sequence[str], max_customers: int | None = None
) -> None:
    """Raise ``DataProblem`` unless the table has one row per customer and at least one usable basis."""
    if id_column not in frame.columns:
        raise DataProblem("The customer ID column does not exist in this table.")
    present = [name for name in basis_columns if name in frame.columns]
    found = customer_contract(frame, id_column, present).first()
    if found["blank_ids"]:
        raise DataProblem("Some customer IDs are blank: fill or remove those rows first.")
    if found["repeated_id_rows"]:
        raise DataProblem(
            f"The customer ID repeats on {found['repeated_id_rows']} rows; a transaction log must be rolled up first."
        )
    if found["rows"] < rules.MIN_CUSTOMERS:
        raise DataProblem(f"Segmentation needs {rules.MIN_CUSTOMERS} customers or more.")
    if max_customers is not None and found["rows"] > max_customers:
        raise DataProblem(f"The table holds more than {max_customers} customers.")
    if not basis_columns:
        raise DataProblem("No segmentation basis was chosen.")
    if len(present) < len(basis_columns):
        raise DataProblem("Bases not found: " + ", ".join(b for b in basis_columns if b not in frame.columns))
    if len(basis_columns) > rules.MAX_BASES:
        raise DataProblem(f"More than {rules.MAX_BASES} bases were chosen: drop the weak or repetitive ones.")
    if not found["varying_bases"]:
        raise DataProblem("None of the chosen bases varies between customers.")


def correlated_pairs(frame: DataFrame, columns: Sequence[str], threshold: float = rules.HIGH_CORRELATION) -> DataFrame:
    """Pairs of numeric columns with an absolute Pearson correlation at or above the threshold.

    Each pair uses the rows where both values exist. Thirty columns make 435 pairs, too many for one generated
    aggregate, so tasks turn their rows into pair sums with matrix products and Spark adds those up. Values are taken
    about the column means of a first pass, which keeps the sums free of cancellation.
    """
    numeric = [name for name in columns if is_number(dtype_of(frame, name))]
    if len(numeric) < 2:
        return frame.sparkSession.createDataFrame([], "left string, right string, correlation double")
    values = [to_number(quoted(name), dtype_of(frame, name)) for name in numeric]
    middle = frame.agg(*[F.avg(value).alias(f"m{i}") for i, value in enumerate(values)]).first()
    gaps = [(value - F.lit(middle[i] or 0.0)).alias(f"x{i}") for i, value in enumerate(values)]
    left, right = np.triu_indices(len(numeric), 1)

    def sums(batches):
        total = np.zeros((6, len(left)))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            there = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            square = x * x
            both = (there.T @ there, x.T @ there, there.T @ x, square.T @ there, there.T @ square, x.T @ x)
            total += np.stack([product[left, right] for product in both])
        yield pa.RecordBatch.from_pydict(
            {"pair": np.arange(len(left), dtype="int32"), **{f"s{i}": total[i] for i in range(6)}}
        )

    added = (
        frame.select(*gaps)
        .mapInArrow(sums, "pair int, " + ", ".join(f"s{i} double" for i in range(6)))
        .groupBy("pair")
        .agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(6)])
    )
    n, x, y, xx, yy, xy = (F.col(f"s{i}") for i in range(6))
    spread = (n * xx - x * x) * (n * yy - y * y)
    flat = 1e-20 * n * xx * n * yy  # a side that does not vary where the other exists
    strength = F.when(spread > flat, F.abs(n * xy - x * y) / F.sqrt(spread))
    names = F.array(*map(F.lit, numeric))
    places = F.array(*[F.struct(F.lit(int(a)).alias("a"), F.lit(int(b)).alias("b")) for a, b in zip(left, right)])
    at = F.get(places, F.col("pair"))
    return added.select(
        F.get(names, at.getField("a")).alias("left"),
        F.get(names, at.getField("b")).alias("right"),
        strength.alias("correlation"),
    ).filter(F.col("correlation") >= threshold)


def at_most_two_values(frame: DataFrame, columns: Sequence[str]) -> list[str]:
    """Numeric columns whose values are all equal to their smallest or largest: two shuffle-free aggregates."""
    values = {name: to_number(quoted(name), dtype_of(frame, name)) for name in columns}
    if not values:
        return []
    ends = frame.agg(*[F.struct(F.min(v), F.max(v)).alias(f"e{i}") for i, v in enumerate(values.values())]).first()
    between = [
        F.count_if((v > F.lit(ends[f"e{i}"][0])) & (v < F.lit(ends[f"e{i}"][1]))).alias(f"n{i}")
        for i, v in enumerate(values.values())
    ]
    inside = frame.agg(*between).first()
    return [name for i, name in enumerate(values) if not inside[f"n{i}"]]


def binary_numeric_columns(profile: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numeric bases with at most two distinct values; a full Gaussian mixture does not suit them."""
    return profile.filter(F.col("column").isin(*columns) & (F.col("unique") <= 2)).select("ordinal", "column")
