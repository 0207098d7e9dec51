"""Where the records of a single JSON document begin and end, found by many tasks.

The document is read in pieces that end at a bracket or a comma, so that a file of one line is dealt to as many tasks as
any other. Whether a piece begins inside a string is the parity of the quotes before it; how deep it is nested is the sum
of the brackets before it. Tasks count both for their stretch of the file, one row per stretch, a window adds the rows up
in file order, and with the sums at hand each task cuts its stretch. What crosses stretches is joined from fragments.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clientele.sources.records import LINE, PATH, START, numbered_lines, with_facts

RECORD_END, MEMBER_END = "}", ","
WHOLE, FRAGMENT, ODD = 0, 1, 2
ESCAPED = re.compile(r"\\.", re.S)
TO_QUOTE = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*"', re.S)
STRING = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"', re.S)
OPEN_STRING = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*\Z', re.S)
KEY = re.compile(r'\s*("[^"\\]*(?:\\.[^"\\]*)*")\s*:', re.S)


def quotes_in(piece: str) -> int:
    return ESCAPED.sub("", piece).count('"') if "\\" in piece else piece.count('"')


def outside_strings(piece: str, inside: bool) -> str:
    """What of a piece is not text of a string."""
    if inside:
        found = TO_QUOTE.match(piece)
        if not found:
            return ""
        piece = piece[found.end() :]
    return OPEN_STRING.sub("", STRING.sub("", piece)) if '"' in piece else piece


def nesting(plain: str) -> int:
    return plain.count("{") + plain.count("[") - plain.count("}") - plain.count("]")


def _runs(batches: Iterator[pa.RecordBatch], extra: int = 0) -> Iterator[tuple]:
    """(key, first, pieces, facts): consecutive pieces of one stretch, and the stretch's own facts."""
    last = None
    for batch in batches:
        paths, starts, values = (batch.column(i).to_pylist() for i in (0, 1, 3))
        facts = [batch.column(4 + i).to_pylist() for i in range(extra)]
        begin = 0
        while begin < len(values):
            key, end = (paths[begin], starts[begin]), begin + 1
            while end < len(values) and (paths[end], starts[end]) == key:
                end += 1
            yield key, key != last, values[begin:end], tuple(f[begin] for f in facts)
            last, begin = key, end


def _summed(batches: Iterator[pa.RecordBatch], count, extra: int = 0) -> Iterator[pa.RecordBatch]:
    """(path, start, total): what ``count`` makes of the pieces of each stretch, given its facts."""
    now, total = None, 0
    for key, first, pieces, facts in _runs(batches, extra):
        if first:
            if now is not None:
                yield pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]]), pa.array([total])], ["path", "start", "total"])
            now, total, state = key, 0, facts
        step, state = count(pieces, state)
        total += step
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]]), pa.array([total])], ["path", "start", "total"])


def _before(sums: DataFrame, name: str) -> DataFrame:
    """Sum of all earlier stretches of the file, per stretch; a row per stretch."""
    order = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(F.col("path").alias(PATH), F.col("start").alias(START), F.coalesce(F.sum("total").over(order), F.lit(0).cast("long")).alias(name))


def structured_pieces(spark: SparkSession, source: str, end: str) -> DataFrame:
    """(path, start, line, value, quotes, depth): pieces with the quotes and the nesting before their stretch."""
    pieces = numbered_lines(spark, source, end)
    sums = "path string, start long, total long"
    quotes = _before(pieces.mapInArrow(lambda b: _summed(b, lambda own, state: (sum(map(quotes_in, own)), state)), sums), "quotes")

    def depth(own: list[str], state: tuple) -> tuple[int, tuple]:
        total, seen = 0, state[0]
        for piece in own:
            total += nesting(outside_strings(piece, seen % 2 == 1))
            seen += quotes_in(piece)
            total -= seen % 2 == 0 and end == RECORD_END
        return total, (seen,)

    known = with_facts(pieces, quotes).select(PATH, START, LINE, "value", "quotes")
    depths = _before(known.mapInArrow(lambda b: _summed(b, depth, 1), sums), "depth")
    return with_facts(known, depths).select(PATH, START, LINE, "value", "quotes", "depth")


RECORDS = "kind int, path string, start long, place int, ordinal long, record string"


def _list_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of a list: whole ones; fragments (place 1 begins a record, 0 ends one, 2 is amid one); and odd contents."""
    held: list[str] = []
    now, seen, depth, head, count = None, 0, 0, False, 0

    def row(kind: int, place: int, text: str) -> tuple:
        return kind, *now, place, count, text

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["kind", "path", "start", "place", "ordinal", "record"])

    def rest() -> list[tuple]:
        text = "".join(held)
        if depth < 2 and not head:  # between records, or behind the list
            return [row(ODD, 0, text)] if text.strip(" ,[]}\n\r\t\ufeff") else []
        return [row(FRAGMENT, 2 if head else 1, text)] if text else []

    for key, first, pieces, facts in _runs(batches, 2):
        out: list[tuple] = []
        if first:
            out += rest() if now is not None else []
            held, now, count = [], key, 0
            seen, depth = facts
            head = depth > 1 or seen % 2 == 1
        for piece in pieces:
            if depth == 1 and not head and not held or depth == 0:
                at = piece.find("{")
                lead = piece if at < 0 else piece[:at]
                if lead.strip(" ,[]}\n\r\t\ufeff") or (at >= 0 and depth == 0 and "[" not in lead):
                    out.append(row(ODD, 0, lead))
                own = "" if at < 0 else piece[at:]
            else:
                own = piece
            depth += nesting(outside_strings(piece, seen % 2 == 1))
            seen += quotes_in(piece)
            if own or held or head:
                held.append(own + RECORD_END)
            if seen % 2 == 1:
                continue
            depth -= 1
            if depth == 1 and held:
                out.append(row(FRAGMENT, 0, "".join(held)) if head else row(WHOLE, 0, "".join(held)))
                count += not head
                held, head = [], False
        if out:
            yield batch_of(out)
    if now is not None and (last := rest()):
        yield batch_of(last)


def list_records(spark: SparkSession, source: str) -> DataFrame:
    """(path, start, ordinal, record) of all elements of documents that are lists of records, each on one line.

    ``path``, ``start`` and ``ordinal`` give their order. What is not a record comes as text that no parser takes.
    """
    rows = structured_pieces(spark, source, RECORD_END).mapInArrow(_list_rows, RECORDS)
    order = Window.partitionBy("path").orderBy("start", "place").rowsBetween(Window.unboundedPreceding, 0)
    parts = rows.filter(F.col("kind") == FRAGMENT).withColumn("chain", F.sum((F.col("place") == 1).cast("long")).over(order))
    own = F.sort_array(F.collect_list(F.struct("start", "place", "ordinal", "record")))
    joined = parts.groupBy("path", "chain").agg(own.alias("parts")).select(
        "path", F.col("parts")[0]["start"].alias("start"), F.col("parts")[0]["ordinal"].alias("ordinal"),
        F.array_join(F.transform("parts", lambda p: p["record"]), "").alias("record"),
    )
    odd = F.when(F.col("kind") == ODD, F.lit("{")).otherwise(F.col("record")).alias("record")
    whole = rows.filter(F.col("kind") != FRAGMENT).select("path", "start", "ordinal", odd)
    # Raw line breaks stand between the parts of a record only: inside of strings they are escaped.
    return whole.unionByName(joined).withColumn("record", F.translate("record", "\n\r", "  "))


MEMBERS = ["path", "start", "number", "part", "text"]


def object_keys(spark: SparkSession, source: str) -> list[str]:
    """Keys of the outermost object in the order they are written; as many as the object has columns or tables."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Members' beginnings as far as their key goes; ``part`` 1 goes on in the next stretch, 2 is what goes on."""
        now, seen, depth, number, head, lead = None, 0, 0, 0, None, None

        def rest() -> list[tuple]:
            return [(*now, number, part, text) for part, text in ((2, lead), (1, head)) if text is not None]

        for key, first, pieces, facts in _runs(batches, 2):
            found = []
            if first:
                found += rest() if now is not None else []
                now, number, head = key, 0, None
                seen, depth = facts
                lead = "" if seen % 2 == 1 and depth <= 1 else None
            for piece in pieces:
                number += 1
                if lead is not None:
                    lead += piece + MEMBER_END
                elif head is not None:
                    head += piece + MEMBER_END
                elif seen % 2 == 0 and depth <= 1:
                    head = (piece if depth else piece[piece.find("{") + 1 :] if "{" in piece else "") + MEMBER_END
                depth += nesting(outside_strings(piece, seen % 2 == 1))
                seen += quotes_in(piece)
                if lead is not None and seen % 2 == 0:
                    found.append((*now, number, 2, lead))
                    lead = None
                elif head is not None and (match := KEY.match(head)):
                    found.append((*now, number, 0, match.group()))
                    head = None
                elif seen % 2 == 0:
                    head = None
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], MEMBERS)
        if now is not None and (last := rest()):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*last)], MEMBERS)

    pieces = structured_pieces(spark, source, MEMBER_END)
    found = pieces.mapInArrow(rows, "path string, start long, number long, part long, text string").collect()
    first = min((r["path"] for r in found), default=None)
    keys, begun = [], ""
    for r in sorted((r for r in found if r["path"] == first), key=lambda r: (r["start"], r["number"], -r["part"])):
        begun = r["text"] if r["part"] == 1 else begun + r["text"] if r["part"] == 2 and begun else ""
        match = KEY.match(r["text"] if r["part"] == 0 else begun)
        if match:
            keys.append(json.loads(match.group(1)))
            begun = ""
    return list(dict.fromkeys(keys))
