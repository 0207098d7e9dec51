"""Result tables for spreadsheets and audits, written by Spark's own writers."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientele.functions.coerce import dtype_of, is_text, missing, quoted
from clientele.functions.names import unique_headers, unique_table_names

# Control characters that workbooks refuse, and first characters that start a formula.
CONTROL_CHARACTERS = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
FORMULA_START = r"^[ \t\r\n]*[=+\-@]"
NULL_MARK = "␀"
FIELD_MARK = "\u0001"


def neutral_text(value: Column) -> Column:
    """Text without control characters; a leading quote stops spreadsheets from running it as a formula."""
    cleaned = F.regexp_replace(value, CONTROL_CHARACTERS, "")
    return F.when(cleaned.rlike(FORMULA_START), F.concat(F.lit("'"), cleaned)).otherwise(cleaned)


def _neutral_header(name: str) -> str:
    cleaned = "".join(c for c in name if c >= " " or c in "\t\n\r")
    return "'" + cleaned if cleaned.lstrip(" \t\r\n")[:1] in tuple("=+-@") else cleaned


def safe_for_spreadsheet(frame: DataFrame) -> DataFrame:
    """Neutral strings and headers; other types pass through untouched."""
    headers = unique_headers(_neutral_header(name) for name in frame.columns)
    return frame.select(
        *[
            (neutral_text(quoted(f.name)) if is_text(f.dataType) else quoted(f.name)).alias(header)
            for f, header in zip(frame.schema.fields, headers)
        ]
    )


def write_csv(frame: DataFrame, folder: str) -> None:
    """Neutralised table as delimited files with a header."""
    safe_for_spreadsheet(frame).write.mode("overwrite").csv(folder, header=True, escape='"')


def write_results(tables: Mapping[str, DataFrame], folder: str, file_format: str = "csv") -> dict[str, str]:
    """One sub-folder per table with a cleaned, unique name; returns table name → path."""
    written = {}
    for (name, frame), clean in zip(tables.items(), unique_table_names(tables)):
        path = f"{folder.rstrip('/')}/{clean}"
        if file_format == "csv":
            write_csv(frame, path)
        else:
            safe_for_spreadsheet(frame).write.mode("overwrite").format(file_format).save(path)
        written[name] = path
    return written


def write_json(tables: Mapping[str, DataFrame], folder: str, metadata: Mapping | None = None) -> None:
    """Records per table as JSON lines: ISO dates, NaN and infinities as null, nulls kept; plus the metadata."""
    spark = None
    for (_, frame), clean in zip(tables.items(), unique_table_names(tables)):
        spark = frame.sparkSession
        columns = []
        for field in frame.schema.fields:
            value = quoted(field.name)
            if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
                value = F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)
            columns.append(value.alias(field.name))
        frame.select(*columns).write.mode("overwrite").json(
            f"{folder.rstrip('/')}/{clean}", ignoreNullFields=False, timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSXXX"
        )
    if metadata and spark is not None:
        text = json.dumps(dict(metadata), default=str, sort_keys=True)
        one = spark.createDataFrame([(text,)], "value string")
        one.write.mode("overwrite").text(f"{folder.rstrip('/')}/analysis_metadata")


def settings_signature(spark: SparkSession, settings: Mapping) -> str:
    """SHA-256 of the settings as sorted JSON."""
    text = json.dumps(dict(settings), sort_keys=True, default=str)
    return spark.range(1).select(F.sha2(F.lit(text), 256).alias("signature")).first()["signature"]


def analysis_manifest(spark: SparkSession, facts: Mapping[str, object]) -> DataFrame:
    """``(field, value)`` rows; nested values as sorted JSON."""
    rows = [
        (name, json.dumps(value, sort_keys=True, default=str) if isinstance(value, (dict, list, tuple)) else str(value))
        for name, value in facts.items()
    ]
    return spark.createDataFrame(rows, "field string, value string")


def dataset_fingerprint(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row ``(customers, fingerprint)``: a SHA-256 that does not depend on row order or partitioning.

    Every row becomes a digest; count, two 32-bit sums, the smallest and the largest digest are order-free and combine
    in tasks, so nothing is shuffled but one partial row per task.
    """
    cells = []
    for name in columns:
        value = quoted(name)
        text = F.when(~missing(value, dtype_of(frame, name)), value.cast("string"))
        cells.append(F.coalesce(text, F.lit(NULL_MARK)))
    digest = F.md5(F.concat_ws(FIELD_MARK, *cells))

    def part(start: int) -> Column:
        return F.conv(F.substring("digest", start, 8), 16, 10).cast("decimal(20,0)")

    summary = frame.select(digest.alias("digest")).agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum(part(1)).alias("a"),
        F.sum(part(9)).alias("b"),
        F.min(F.struct("digest")).getField("digest").alias("low"),
        F.max(F.struct("digest")).getField("digest").alias("high"),
    )
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("customers", "a", "b", "low", "high")])
    return summary.select("customers", F.sha2(text, 256).alias("fingerprint"))
