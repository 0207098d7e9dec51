"""Records of delimited files whose quoted cells hold line breaks, put together by many tasks per file.

Whether a line begins inside a quoted cell depends on all lines before it. A task that starts in the middle of a file
cannot know, but it can say what its stretch of lines does to either case: keep it, flip it, or end in a certain state.
These answers, one row per stretch, are composed in file order by a window; with the state at its beginning each task cuts
its stretch into records. What a stretch begins or ends with in the middle of a record are fragments, at most two per
stretch, which are joined across stretches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Stretches of which the states are broadcast; a row is some hundred bytes. Beyond that the lines are joined by a shuffle.
BROADCAST_STRETCHES = 100_000
PATH, START, LINE = "__path", "__start", "__line"


class Quotes:
    """Follows quoted cells through lines of one dialect: a cell is quoted if a quote is the first thing in it."""

    def __init__(self, delimiter: str) -> None:
        far = re.escape(delimiter)
        # To the end of a quoted cell, doubled quotes inside; then whatever stands before the next delimiter.
        self._rest = re.compile(rf'[^"]*(?:""[^"]*)*"(?!")[^{far}]*')
        self._plain = re.compile(rf"[^{far}]*")
        self._blank = re.compile(r"[ ]*")

    def open_after(self, line: str, inside: bool) -> bool:
        """Whether a quoted cell is open at the end of a line that begins inside or outside of one."""
        if '"' not in line:
            return inside
        at, size = 0, len(line)
        while True:
            if not inside:
                blank = self._blank.match(line, at).end()
                if line[blank : blank + 1] != '"':
                    at = self._plain.match(line, at).end()
                    if at >= size:
                        return False
                    at += 1
                    continue
                at = blank + 1
            found = self._rest.match(line, at)
            if not found:
                return True
            inside, at = False, found.end()
            if at >= size:
                return False
            at += 1


def numbered_lines(spark: SparkSession, source: str, line_end: str) -> DataFrame:
    """All lines with their file, the place where their stretch of the file begins, and their order in it."""
    lines = spark.read.option("lineSep", line_end).text(source)
    return lines.select(
        F.col("_metadata.file_path").alias(PATH), F.col("_metadata.file_block_start").alias(START), F.monotonically_increasing_id().alias(LINE), "value"
    )


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[str], bool]]:
    """(file, start, lines, first) of rows that come stretch by stretch, a batch at a time."""
    last = None
    for batch in batches:
        paths, starts, values = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()
        begin = 0
        while begin < len(values):
            key, end = (paths[begin], starts[begin]), begin + 1
            while end < len(values) and starts[end] == key[1] and paths[end] == key[0]:
                end += 1
            yield *key, values[begin:end], key != last
            last, begin = key, end


def _effects(batches: Iterator[pa.RecordBatch], quotes: Quotes) -> Iterator[pa.RecordBatch]:
    now: list = []

    def row() -> pa.RecordBatch:
        path, start, outside, inside = now
        return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([start]), pa.array([outside]), pa.array([inside])], ["path", "start", "outside", "inside"])

    for path, start, lines, first in _stretches(batches):
        if first:
            if now:
                yield row()
            now = [path, start, False, True]
        for line in lines:
            if '"' in line:
                now[2:] = [quotes.open_after(line, state) for state in now[2:]]
    if now:
        yield row()


def opening_states(lines: DataFrame, quotes: Quotes) -> DataFrame:
    """(file, start, open): whether a quoted cell is open where a stretch begins."""
    own = lines.mapInArrow(lambda b: _effects(b, quotes), "path string, start long, outside boolean, inside boolean")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    flips = F.sum((F.col("outside") & ~F.col("inside")).cast("long"))
    known = F.max(F.when(F.col("outside") == F.col("inside"), F.struct("start", "outside", "flips")))
    counted = own.withColumn("flips", F.coalesce(flips.over(before), F.lit(0).cast("long"))).withColumn("known", known.over(before))
    state = F.coalesce(F.col("known.outside"), F.lit(False))
    odd = F.pmod(F.col("flips") - F.coalesce(F.col("known.flips"), F.lit(0).cast("long")), F.lit(2)) == 1
    return counted.select(F.col("path").alias(PATH), F.col("start").alias(START), (state != odd).alias("open"))


def with_facts(lines: DataFrame, facts: DataFrame, most: int = BROADCAST_STRETCHES) -> DataFrame:
    """Lines (or pieces) in file order, with what is known of their stretch. Facts of up to ``most`` stretches are
    worked out once and broadcast; more of them are joined by a shuffle, after which the lines are put in order again."""
    known = facts.limit(most + 1).collect()
    if len(known) > most:
        return lines.join(facts.hint("shuffle_hash"), [PATH, START]).sortWithinPartitions(PATH, START, LINE)
    small = lines.sparkSession.createDataFrame([tuple(r) for r in known], facts.schema)
    return lines.join(F.broadcast(small), [PATH, START])


RECORDS = "kind int, path string, start long, place int, ordinal long, record string"
WHOLE, FRAGMENT = 0, 1


def _record_rows(batches: Iterator[pa.RecordBatch], quotes: Quotes, line_end: str) -> Iterator[pa.RecordBatch]:
    """Whole records that are not blank; and fragments by place: 1 begins what a later stretch ends, 0 ends what an
    earlier one began, 2 is the whole of a stretch in the middle of a record. ``ordinal`` counts a stretch's records."""
    held: list[str] = []
    state, head, key, count = False, False, None, 0

    def rows(kind: int, place: int, records: list[str]) -> pa.RecordBatch:
        n = len(records)
        columns = [pa.array([kind] * n, pa.int32()), pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.int64())]
        columns += [pa.array([place] * n, pa.int32()), pa.array(range(count, count + n), pa.int64()), pa.array(records, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["kind", "path", "start", "place", "ordinal", "record"])

    last = None
    for batch in batches:
        states, at = batch.column(4).to_pylist(), 0
        for path, start, lines, _ in _stretches(iter([batch])):
            if (path, start) != last:
                if held:
                    yield rows(FRAGMENT, 2 if head else 1, [line_end.join(held)])
                held, key, count = [], (path, start), 0
                state = head = bool(states[at])
                last = (path, start)
            at += len(lines)
            out = []
            for line in lines:
                state = quotes.open_after(line, state)
                held.append(line)
                if state:
                    continue
                text = line_end.join(held)
                held = []
                if head:
                    yield rows(FRAGMENT, 0, [text])
                    head = False
                elif text.strip():
                    out.append(text)
            if out:
                yield rows(WHOLE, 0, out)
                count += len(out)
    if held:
        yield rows(FRAGMENT, 2 if head else 1, [line_end.join(held)])


def file_records(spark: SparkSession, source: str, delimiter: str, line_end: str = "\n", most_broadcast: int = BROADCAST_STRETCHES) -> DataFrame:
    """(record, first) of all records of delimited files that are not blank; ``first`` marks the first of each file.

    Records keep the line breaks of their quoted cells. A record that no quote closes ends with its file.
    """
    quotes = Quotes(delimiter)
    lines = numbered_lines(spark, source, line_end)
    cut = with_facts(lines, opening_states(lines, quotes), most_broadcast)
    rows = cut.select(PATH, START, LINE, "value", "open").mapInArrow(lambda b: _record_rows(b, quotes, line_end), RECORDS)
    first = (F.col("start") == 0) & (F.col("ordinal") == 0)
    whole = rows.filter(F.col("kind") == WHOLE).select("record", first.alias("first"))
    # Fragments in file order: one that begins a record (place 1) opens a chain, the next ones continue it.
    order = Window.partitionBy("path").orderBy("start", "place").rowsBetween(Window.unboundedPreceding, 0)
    parts = rows.filter(F.col("kind") == FRAGMENT).withColumn("chain", F.sum((F.col("place") == 1).cast("long")).over(order))
    own = F.struct("start", "place", "ordinal", "record")
    joined = parts.groupBy("path", "chain").agg(F.sort_array(F.collect_list(own)).alias("parts")).select(
        F.array_join(F.transform("parts", lambda p: p["record"]), line_end).alias("record"), F.col("parts")[0]["start"].alias("start"), F.col("parts")[0]["ordinal"].alias("ordinal")
    )
    return whole.unionByName(joined.select("record", first.alias("first")))
