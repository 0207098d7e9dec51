"""Tables from CSV, JSON and Parquet files, or from a folder of such files."""

from __future__ import annotations

import csv
import json
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientele.errors import DataProblem
from clientele.functions.coerce import NUMBER_TEXT, quoted
from clientele.functions.names import unique_headers
from clientele.session import RUNTIME_SETTINGS, scratch_folder
from clientele.sources.records import file_records
from clientele.sources.structure import list_records, object_keys

SUFFIXES = (".csv", ".json", ".jsonl", ".parquet")
ONLY_TABLE = "customers"
DELIMITERS = (",", ";", "\t", "|")
SNIFFED_LINES = 20
LINE_PREFIX = 1 << 20  # characters of a line that detection looks at
WIDE_ROW = "A row has more cells than the header."

# Texts that mean "missing" in a delimited file.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)


@dataclass(frozen=True)
class LoadedData:
    """Named tables of one source; nothing is read beyond headers and types until a table is used."""

    tables: dict[str, DataFrame]
    source_name: str


def load_data(spark: SparkSession, source: str, schema: T.StructType | str | None = None) -> LoadedData:
    """Load a file, or a folder whose files each become a table named after the file.

    A path that ends in a known suffix is one source, also when it is a folder of part files as Spark writes them. A
    ``schema`` skips type detection, which otherwise costs one pass over a delimited or JSON source.
    """
    spark.conf.set("spark.sql.caseSensitive", RUNTIME_SETTINGS["spark.sql.caseSensitive"])
    path = PurePosixPath(source)
    suffix = path.suffix.lower()
    if suffix in SUFFIXES:
        tables = _read(spark, source, suffix, schema)
    elif not suffix:
        tables = {}
        for name, child in _children(spark, source):
            for inner, table in _read(spark, child, PurePosixPath(child).suffix.lower(), schema).items():
                tables[name if inner == ONLY_TABLE else f"{name} {inner}"] = table
    else:
        raise DataProblem("Supported files: " + ", ".join(SUFFIXES))
    tables = {name: table for name, table in tables.items() if table.columns}
    if not tables:
        raise DataProblem("The source holds no usable table.")
    return LoadedData(tables, path.name)


def _children(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(hadoop):
        raise DataProblem(f"Nothing found at {folder}.")
    found = [PurePosixPath(status.getPath().toString()) for status in files.listStatus(hadoop)]
    return sorted(
        (entry.stem, f"{folder.rstrip('/')}/{entry.name}") for entry in found if entry.suffix.lower() in SUFFIXES
    )


def _read(spark: SparkSession, source: str, suffix: str, schema) -> dict[str, DataFrame]:
    if suffix == ".parquet":
        table = spark.read.parquet(source)
        return {ONLY_TABLE: table.toDF(*unique_headers(table.columns))}
    if suffix == ".csv":
        return {ONLY_TABLE: read_csv(spark, source, schema=schema)}
    return read_json(spark, source, schema)


# ----------------------------------------------------------------------------------------------------------------- csv


def read_csv(
    spark: SparkSession, source: str, delimiter: str | None = None, schema: T.StructType | str | None = None,
    multi_line: bool | None = None,
) -> DataFrame:
    """Delimited file with a header row; the delimiter is detected from the first lines.

    Types are decided from all values in one aggregate: whole number, decimal, boolean (only without gaps), text; a
    ``schema`` replaces that decision, not the missing tokens. ``multi_line`` allows line breaks inside quotes; by default
    it is on exactly when some line leaves a quote open. Either way a file is read by many tasks (``records.py``). Short
    rows are filled up with missing values; a row with more cells than the header is an error.
    """
    lines = [row["value"] for row in spark.read.text(source).select(F.left("value", F.lit(LINE_PREFIX)).alias("value")).limit(SNIFFED_LINES).collect()]
    if not any(line.strip() for line in lines):
        raise DataProblem("The file is empty.")
    if multi_line is None:
        multi_line = _leaves_quotes_open(spark, source)
    delimiter = delimiter or detect_delimiter(lines)
    options = {"sep": delimiter, "quote": '"', "escape": '"'}
    records = file_records(spark, source, delimiter, _line_end(spark, source)).select(_trimmed_end("record"), "first") if multi_line else None
    if records is None:
        header = spark.read.csv(source, header=False, **options).first()
    else:
        header = _header_cells(records, options)
    names = unique_headers(
        "" if cell is None else cell.removeprefix("\ufeff") for cell in header
    )
    # One column more than the header: what it catches would otherwise be dropped without a word.
    surplus = unique_headers([*names, "surplus"])[-1]
    text = T.StructType([T.StructField(name, T.StringType()) for name in [*names, surplus]])
    if records is None:
        raw = spark.read.csv(source, header=True, schema=text, **options)
    else:
        cells = F.from_csv("record", text.toDDL(), {**options, **WHOLE_RECORD})
        raw = records.filter(~F.col("first")).select(cells.alias("cells")).select("cells.*")
    table = raw.select(
        *[F.when(~quoted(name).isin(*MISSING_TOKENS), quoted(name)).alias(name) for name in names], quoted(surplus)
    )
    if schema is not None:
        fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
        if len(fields) != len(names):
            raise DataProblem(f"The schema has {len(fields)} columns, the file {len(names)}.")
        wide = F.raise_error(F.lit(WIDE_ROW)).cast("string")
        first = F.when(quoted(surplus).isNotNull(), wide).otherwise(quoted(names[0]))
        cells = [first, *[quoted(name) for name in names[1:]]]
        return table.select(*[F.trim(c).try_cast(f.dataType).alias(n) if not isinstance(f.dataType, T.StringType) else c.alias(n) for c, f, n in zip(cells, fields, names)])
    return _with_types(table, surplus)


WHOLE_RECORD = {"multiLine": "true", "maxCharsPerColumn": "-1"}


def _line_end(spark: SparkSession, source: str) -> str:
    """A carriage return, if lines end with nothing else; it is taken from the lines' ends otherwise."""
    start = spark.read.option("lineSep", "\n").text(source).select(F.left("value", F.lit(LINE_PREFIX)).alias("value")).limit(2).collect()
    return "\r" if len(start) == 1 and "\r" in start[0]["value"].rstrip("\r") else "\n"


def _trimmed_end(name: str) -> Column:
    return F.regexp_replace(name, r"\r\z", "").alias(name)


def _header_cells(records: DataFrame, options: dict[str, str]) -> list[str | None]:
    """Cells of a file's first record, however many it has."""
    first = records.filter("first").first()["record"]
    size = first.count(options["sep"]) + 1  # cells at most
    schema = ", ".join(f"c{i} string" for i in range(size))
    row = records.sparkSession.createDataFrame([(first,)], "record string").select(F.from_csv("record", schema, {**options, **WHOLE_RECORD}).alias("c")).first()["c"]
    cells = list(row)
    while len(cells) > 1 and cells[-1] is None and not first.rstrip("\r\n").endswith(options["sep"]):
        cells.pop()  # delimiters inside of quotes
    return cells


def _leaves_quotes_open(spark: SparkSession, source: str) -> bool:
    """Whether any line holds an odd number of quotes, so that a quoted cell goes on in the next line."""
    odd = F.pmod(F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))), F.lit(2)) == 1
    return bool(spark.read.text(source).filter(odd).limit(1).collect())


def detect_delimiter(lines: list[str]) -> str:
    """The delimiter that splits the header and most following lines into the same number of cells, the more the better."""
    kept = [line for line in lines if line.strip()]

    def evidence(delimiter: str) -> tuple[float, int]:
        widths = [len(row) for row in csv.reader(kept, delimiter=delimiter)]
        same = sum(width == widths[0] for width in widths) / len(widths)
        return (same if widths[0] > 1 else 0.0, widths[0])

    return max(DELIMITERS, key=evidence)


def _with_types(table: DataFrame, surplus: str) -> DataFrame:
    extra = F.count(quoted(surplus)).alias("extra")
    wide, table = table, table.drop(surplus)
    infinite = r"(?i)^\s*[+-]?inf(inity)?\s*$"
    tests = []
    for i, name in enumerate(table.columns):
        value = quoted(name)
        tests.append(
            F.struct(
                F.count(F.lit(1)).alias("rows"),
                F.count(value).alias("present"),
                F.count_if(value.rlike(r"^\s*[+-]?\d+\s*$") & F.trim(value).try_cast("bigint").isNotNull()).alias("whole"),
                F.count_if(value.rlike(NUMBER_TEXT) | value.rlike(infinite)).alias("number"),
                F.count_if(value.isin("True", "TRUE", "true", "False", "FALSE", "false")).alias("truth"),
            ).alias(f"t{i}")
        )
    found = wide.agg(*tests, extra).first()
    if found["extra"]:
        raise DataProblem(WIDE_ROW)
    columns: list[Column] = []
    for i, name in enumerate(table.columns):
        value, facts = quoted(name), found[f"t{i}"]
        if facts["present"] and facts["whole"] == facts["present"]:
            value = F.trim(value).try_cast("bigint")
        elif facts["number"] == facts["present"]:
            value = F.trim(value).try_cast("double")
        elif facts["truth"] == facts["rows"]:
            value = value.try_cast("boolean")
        columns.append(value.alias(name))
    return table.select(*columns)


# ---------------------------------------------------------------------------------------------------------------- json


def read_json(spark: SparkSession, source: str, schema: T.StructType | str | None = None) -> dict[str, DataFrame]:
    """JSON in one of these shapes: list of records, object of named record lists, column-oriented object, JSON lines.

    A list is cut into its records by many tasks (``structure.py``), which are written once as JSON lines below the
    shared checkpoint folder and read from there. An object is parsed by one task.
    """
    text = spark.read.text(source).filter(F.trim("value") != "")
    lines = _prefix(text, SNIFFED_LINES)
    if not lines:
        raise DataProblem("The file is empty.")
    start = "\n".join(lines).lstrip("\ufeff \t\r\n")
    if start.startswith("["):
        return {ONLY_TABLE: _read_list(spark, source, schema)}
    if len(lines) > 1 and all(_is_object(line.lstrip("\ufeff")) for line in lines[:2]):
        return {ONLY_TABLE: _ordered(_parse(spark, source, False, schema), _first_keys(text))}
    document = _parse(spark, source, True, None)
    keys = object_keys(spark, source) or document.columns
    document = _ordered(document, keys, rename=False)
    if not any(isinstance(f.dataType, (T.ArrayType, T.StructType)) for f in document.schema.fields):
        return {ONLY_TABLE: _ordered(_parse(spark, source, True, schema), keys)}  # a single record
    lists = {f.name: f.dataType for f in document.schema.fields if isinstance(f.dataType, T.ArrayType)}
    if len(lists) == len(document.columns):
        sizes = document.select(*[F.size(quoted(name)).alias(name) for name in lists]).first()
        if all(isinstance(lists[n].elementType, T.StructType) or not sizes[n] for n in lists):
            return {
                unique: _ordered(document.select(F.inline(quoted(name))), [])
                for unique, name in zip(unique_headers(lists), lists)
                if sizes[name]
            }
    return {ONLY_TABLE: _columns_to_rows(spark, source, document)}


def _read_list(spark: SparkSession, source: str, schema) -> DataFrame:
    folder = scratch_folder(spark)
    list_records(spark, source).write.parquet(f"{folder}-records")
    records = spark.read.parquet(f"{folder}-records")
    first = records.orderBy("path", "start", "ordinal").select("record").first()
    if first is None:
        return _parse(spark, source, True, schema)
    records.select(F.col("record").alias("value")).write.text(folder)
    try:
        keys = list(json.loads(first["record"]))
    except ValueError as problem:
        raise DataProblem("The file is not valid JSON.") from problem
    return _ordered(_parse(spark, folder, False, schema), keys)


def _parse(spark: SparkSession, source: str, whole: bool, schema) -> DataFrame:
    reader = spark.read.option("multiLine", whole).option("mode", "FAILFAST").option("dropFieldIfAllNull", "false")
    if schema is not None:
        reader = reader.schema(schema)
    try:
        return reader.json(source)
    except Exception as problem:
        raise DataProblem("The file is not valid JSON.") from problem


def _is_object(text: str) -> bool:
    try:
        return isinstance(json.loads(text), dict)
    except ValueError:
        return False


def _prefix(text: DataFrame, count: int) -> list[str]:
    return [row["value"] for row in text.select(F.left("value", F.lit(LINE_PREFIX)).alias("value")).limit(count).collect()]


def _first_keys(text: DataFrame) -> list[str]:
    """Key order of the first of JSON lines; Spark itself sorts keys by name."""
    first = text.select("value").first()
    try:
        return list(json.loads(first["value"].lstrip("\ufeff")))
    except ValueError:
        return []


def _ordered(table: DataFrame, keys: list[str], rename: bool = True) -> DataFrame:
    order = [key for key in keys if key in table.columns]
    order += [name for name in table.columns if name not in order]
    table = table.select(*[quoted(name) for name in order])
    return table.toDF(*unique_headers(order)) if rename else table


def _columns_to_rows(spark: SparkSession, source: str, document: DataFrame) -> DataFrame:
    fields = document.schema.fields
    keyed = [f for f in fields if isinstance(f.dataType, T.StructType)]
    listed = [f for f in fields if isinstance(f.dataType, T.ArrayType)]
    plain = [f for f in fields if f not in keyed and f not in listed]
    names = unique_headers(f.name for f in fields)
    shown = {f.name: name for f, name in zip(fields, names)}
    if keyed and not listed:
        # {"column": {"row key": value}}: read the inner objects as maps, then line the keys up.
        types = ", ".join(f"`{f.name.replace('`', '``')}` map<string,{_common(f.dataType)}>" for f in keyed)
        maps = spark.read.option("multiLine", True).schema(types).json(source)
        keys = F.array_distinct(F.flatten(F.array(*[F.map_keys(quoted(f.name)) for f in keyed])))
        rows = maps.select(*[quoted(f.name) for f in keyed], F.explode(keys).alias("__key"))
        return rows.select(*[F.element_at(quoted(f.name), F.col("__key")).alias(shown[f.name]) for f in keyed])
    if keyed or not listed:
        raise DataProblem("The JSON object is neither named record lists nor equally long columns.")
    sizes = set(document.select(*[F.size(quoted(f.name)).alias(f"s{i}") for i, f in enumerate(listed)]).first())
    if len(sizes) > 1:
        raise DataProblem("The JSON columns differ in length.")
    zipped = F.arrays_zip(*[quoted(f.name).alias(f"c{i}") for i, f in enumerate(listed)])
    rows = document.select(*[quoted(f.name) for f in plain], F.inline(zipped))
    rows = rows.toDF(*[f.name for f in plain], *[f.name for f in listed])
    return rows.select(*[quoted(f.name).alias(shown[f.name]) for f in fields])


def _common(struct: T.StructType) -> str:
    kinds = {type(f.dataType) for f in struct.fields}
    if kinds <= {T.LongType}:
        return "bigint"
    if kinds <= {T.LongType, T.DoubleType}:
        return "double"
    return "boolean" if kinds == {T.BooleanType} else "string"
