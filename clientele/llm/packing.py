"""Best-fit packing under conflicts: bins ordered by residual room carry bitmaps of sources and duplicate clusters."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.llm.shared import text_or_empty


@dataclass(frozen=True)
class PackSettings:
    """``capacity`` units per bin; at most ``per_source`` pieces of one source and one piece of a duplicate cluster in a
    bin; ``group_rows`` documents are packed together."""

    capacity: int = 2048
    per_source: int = 4
    group_rows: int = 2048


class Bins:
    """Open bins of one group in order of residual room."""

    def __init__(self, settings: PackSettings) -> None:
        self.settings = settings
        self.open: list[tuple[int, int]] = []  # (residual, bin), ascending
        self.clusters: list[int] = []  # per bin: bitmap of duplicate clusters
        self.sources: list[list[int]] = []  # per bin: one bitmap for each count of a source, from one up

    def place(self, size: int, source: int, cluster: int) -> int:
        """Tightest bin with room and without conflict; a new bin if there is none.

        The search starts at the smallest sufficient residual and goes on to its successors, so a conflict never hides
        a compatible bin further up. ``cluster`` is -1 for a document without duplicates in the group.
        """
        mark, kin = 1 << source, (1 << cluster) if cluster >= 0 else 0
        full = self.settings.per_source - 1
        for at in range(bisect_left(self.open, (size, -1)), len(self.open)):
            room, found = self.open[at]
            if not (self.clusters[found] & kin or self.sources[found][full] & mark):
                del self.open[at]
                break
        else:
            room, found = self.settings.capacity, len(self.clusters)
            self.clusters.append(0)
            self.sources.append([0] * self.settings.per_source)
        self.clusters[found] |= kin
        planes = self.sources[found]
        planes[next(i for i, plane in enumerate(planes) if not plane & mark)] |= mark
        if room > size:
            insort(self.open, (room - size, found))
        return found


def pack_group(frame: pd.DataFrame, settings: PackSettings) -> pd.DataFrame:
    """Pack one group's pieces, largest first; ties by key, text checksum and piece, so that the result is repeatable."""
    frame = frame.sort_values(["units", "key", "cluster", "row", "piece"], ascending=[False, True, True, True, True], na_position="first")
    source = pd.factorize(frame["source"], use_na_sentinel=False)[0]
    counts = frame.groupby("cluster")["row"].transform("nunique")
    codes = pd.factorize(frame["cluster"].where(counts > 1))[0]  # -1 for clusters of one
    bins = Bins(settings)
    frame["bin"] = [bins.place(u, s, c) for u, s, c in zip(frame["units"].tolist(), source.tolist(), codes.tolist())]
    return frame[["key", "piece", "first_unit", "units", "group", "bin"]]


def word_units(text: str | Column) -> Column:
    """Whitespace-separated words of a text; null has none."""
    return F.regexp_count(text_or_empty(text), F.lit(r"[^ \t\n\r\x0b\x0c]+"))


def pack_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", units: Column | None = None,
    cluster: Column | None = None, settings: PackSettings = PackSettings(),
) -> DataFrame:
    """``key``, piece, first_unit, units, pack for every piece of every row.

    ``units`` (default: words) is a row's length. A row longer than the capacity is cut into full pieces and a rest;
    the pieces cover it whole and go to bins of their own. A row without units takes no room and still gets a bin.
    ``cluster`` (default: equal texts) names duplicates that must not share a bin; pieces of one row may not meet
    either way, since full pieces fill their bins. A null source is a source like any other; rows repeated as a whole
    are duplicates of each other. Groups are drawn by hash of key and text with a salt for repeated rows, so one
    source, cluster or key spreads evenly over all groups and no group outgrows a task.
    """
    length = (word_units(text) if units is None else units).cast("long")
    kin = F.xxhash64(text_or_empty(text)) if cluster is None else F.xxhash64(cluster)
    rows = docs.select(
        F.col(key).cast("string").alias("key"), F.coalesce(length, F.lit(0).cast("long")).alias("length"),
        F.col(source).cast("string").alias("source"), kin.alias("cluster"), F.monotonically_increasing_id().alias("row"),
    )
    total = docs.count()
    groups = max(1, math.ceil(total / settings.group_rows))
    capacity = settings.capacity
    last = F.greatest((F.col("length") - 1), F.lit(0)).cast("long")
    pieces = rows.select(
        "key", "source", "cluster", "row", "length",
        F.pmod(F.xxhash64("key", "cluster", "row"), F.lit(groups)).alias("group"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / capacity).cast("long"))).alias("piece"),
    ).withColumn("first_unit", F.col("piece") * capacity).withColumn(
        "units", F.least(F.col("length") - F.col("first_unit"), F.lit(capacity).cast("long"))
    ).drop("length")
    kind = dict(docs.dtypes)[key]
    packed = pieces.groupBy("group").applyInPandas(
        lambda frame: pack_group(frame, settings),
        "key string, piece long, first_unit long, units long, group long, bin long",
    )
    return packed.select(
        F.col("key").cast(kind).alias(key), "piece", "first_unit", "units", (F.col("group") * F.lit(1 << 24) + F.col("bin")).alias("pack")
    )
