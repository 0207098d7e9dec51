"""Tables, stored intermediate results and id ranges that several operators need."""

from __future__ import annotations

import gc
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clientele.session import scratch_folder


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


class Scratch:
    """A scope of stored tables: when it ends they are deleted, but for those kept, which pass to the scope around it.

    What has been computed from a table must be stored, or returned with the table kept, before its scope ends. Outside
    of any scope tables stay. Shuffle files of finished steps go when the driver collects its garbage; the end of a scope
    makes it do so, as they would otherwise stay for as long as the driver has memory to spare.
    """

    _open: list["Scratch"] = []

    def __init__(self, spark: SparkSession) -> None:
        self._spark, self._folders, self._kept = spark, [], set()

    def __enter__(self) -> "Scratch":
        Scratch._open.append(self)
        return self

    def keep(self, frame: DataFrame) -> DataFrame:
        self._kept.add(frame.scratch)
        return frame

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables of this scope that nothing needs any more."""
        for frame in frames:
            self._folders.remove(frame.scratch)
            _delete(self._spark, frame.scratch)

    def __exit__(self, *problem) -> None:
        Scratch._open.remove(self)
        around = Scratch._open[-1] if Scratch._open else None
        for folder in self._folders:
            if folder not in self._kept:
                _delete(self._spark, folder)
            elif around is not None:
                around._folders.append(folder)
        gc.collect()
        self._spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(frame: DataFrame, codec: str | None = None) -> DataFrame:
    """Write a frame once below the shared checkpoint folder and read it back: lineage ends here, and a lost executor
    costs a re-read instead of a re-run. In a ``Scratch`` scope the table goes with the scope."""
    folder = scratch_folder(frame.sparkSession)
    (frame.write.option("compression", codec) if codec else frame.write).parquet(folder)
    table = frame.sparkSession.read.schema(frame.schema).parquet(folder)
    table.scratch = folder
    if Scratch._open:
        Scratch._open[-1]._folders.append(folder)
    return table


def fresh_name(frame: DataFrame, base: str) -> str:
    """A column name that the frame does not have yet."""
    taken = {c.lower() for c in frame.columns}
    name, n = base, 0
    while name.lower() in taken:
        n += 1
        name = f"{base}_{n}"
    return name


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def partitions_for(spark: SparkSession, amount: int, each: int) -> int:
    """Shuffle partitions so that each holds about ``each`` of ``amount``; never fewer than the session's setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(amount / each))


def range_bounds(frame: DataFrame, key: str, ranges: int) -> list:
    """At most ``ranges - 1`` ascending cut points of a column, from its approximate quantiles.

    Only the cut points reach the driver. They decide how work is spread, never what comes out.
    """
    if ranges < 2:
        return []
    shares = [i / ranges for i in range(1, ranges)]
    found = frame.agg(F.percentile_approx(key, shares, 20_000).alias("cuts")).first()["cuts"]
    return sorted(set(found or []))


def range_of(key: str | Column, bounds: list) -> Column:
    """Number of cut points at or below the key (nulls: 0, like the smallest keys)."""
    key = F.col(key) if isinstance(key, str) else key
    if not bounds:
        return F.lit(0)
    # array_position-like search on a literal array: halving steps keep it short for many bounds.
    cuts = F.lit(bounds)
    low, high = F.lit(0), F.lit(len(bounds))
    start = F.struct(low.alias("low"), high.alias("high"))

    def step(state, _):
        middle = ((state["low"] + state["high"]) / 2).cast("int")
        right = F.element_at(cuts, middle + 1) <= key
        return F.when(state["low"] >= state["high"], state).when(
            right, F.struct((middle + 1).alias("low"), state["high"].alias("high"))
        ).otherwise(F.struct(state["low"].alias("low"), middle.alias("high")))

    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))
    return F.coalesce(F.aggregate(steps, start, step, lambda s: s["low"]), F.lit(0))
