"""Column expressions that turn raw values into numbers, timestamps and labels.

Spark knows null, NaN and infinity; the analysis knows only "missing". Everything here maps to null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Plain decimal or scientific notation; keeps Java-only spellings such as '1d' or '0x1p3' out.
NUMBER_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

MISSING_LABEL = "Missing"


def quoted(name: str) -> Column:
    """Column by exact name, even if the name holds dots, spaces or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def dtype_of(frame: DataFrame, name: str) -> T.DataType:
    return frame.schema[name].dataType


def is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def finite(column: Column) -> Column:
    """NaN and both infinities become null."""
    return F.when(~F.isnan(column) & (F.abs(column) != F.lit(float("inf"))), column)


def missing(column: Column, dtype: T.DataType) -> Column:
    """True for null and, in floating columns, for NaN."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def to_number(column: Column, dtype: T.DataType) -> Column:
    """Double value, or null when the value is missing, not a number, or infinite."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return finite(column.cast("double"))
    if is_number(dtype) or isinstance(dtype, T.BooleanType):
        return column.cast("double")
    if is_text(dtype):
        return F.when(column.rlike(NUMBER_TEXT), finite(F.trim(column).try_cast("double")))
    return F.lit(None).cast("double")


def to_timestamp(column: Column, dtype: T.DataType, formats: Sequence[str] = ()) -> Column:
    """UTC timestamp, or null when the value cannot be read; ``formats`` are tried after the ISO forms."""
    if is_text(dtype):
        tries = [column.try_cast("timestamp")]
        tries += [F.try_to_timestamp(column, F.lit(pattern)) for pattern in formats]
        return F.coalesce(*tries)
    if is_number(dtype):
        return F.timestamp_micros((column.cast("double") / 1000).cast("long"))
    return column.cast("timestamp")


def is_blank(column: Column) -> Column:
    """Null, or nothing but white space."""
    return column.isNull() | (F.trim(column.cast("string")) == "")


def to_label(column: Column, dtype: T.DataType) -> Column:
    """Text of a categorical value, with missing values spelled out."""
    if isinstance(dtype, T.BooleanType):
        text = F.when(column, F.lit("True")).when(~column, F.lit("False"))
    else:
        text = F.when(~missing(column, dtype), column.cast("string"))
    return F.coalesce(text, F.lit(MISSING_LABEL))


def half_even(column: Column, digits: int) -> Column:
    """Banker's rounding, without negative zero."""
    return F.bround(column, digits) + F.lit(0.0)
