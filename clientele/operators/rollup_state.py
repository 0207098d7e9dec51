"""A roll-up that grows with the log: state per (customer, order) in the shared folder, merged with each new slice.

A slice of the log is summed per (customer, order) and added to the state; lines that were summed before are not read
again. The state lies in buckets of customers. A slice is written as a version of its own: first the new rows of the
buckets that it touches, then a manifest that names the version of every bucket. A version without its manifest is none,
so a run that fails, or a task that is repeated, leaves the state as it was.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientele.errors import DataProblem
from clientele.functions.coerce import is_blank
from clientele.operators.rfm import BLANK_ORDER, MICROS_PER_DAY, NO_ROWS, _days, _literal_instant, usable_transactions


class RollupState:
    """The roll-up kept below ``folder``; ``buckets`` is fixed by its first slice."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64) -> None:
        self._spark, self._folder, self._buckets = spark, folder.rstrip("/"), buckets

    def _exists(self, path: str) -> bool:
        found = self._spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration()).exists(found)

    def _current(self) -> tuple[int, dict[int, int]]:
        """The last version with a manifest, and the version of each of its buckets: a row per bucket."""
        last = 0
        while self._exists(f"{self._folder}/manifest-{last + 1}/_SUCCESS"):
            last += 1
        if not last:
            return 0, {}
        rows = self._spark.read.parquet(f"{self._folder}/manifest-{last}").collect()
        return last, {r["bucket"]: r["version"] for r in rows}

    def rows(self) -> DataFrame | None:
        """The state: customer_id, order_id, order_value, opened, closed, lines, bucket; None before the first slice."""
        _, versions = self._current()
        found = None
        for version in sorted(set(versions.values())):
            own = [b for b, v in versions.items() if v == version]
            part = self._spark.read.parquet(f"{self._folder}/rows-{version}").filter(F.col("bucket").isin(own))
            found = part if found is None else found.unionByName(part)
        return found

    def add(
        self, log: DataFrame, customer_column: str, date_column: str, amount_column: str, order_column: str,
        date_formats: Sequence[str] = (),
    ) -> int:
        """Add a slice of the log and return its version. Rows without customer, date or amount are left out, as in
        ``build_rfm``; a blank order id is an error, and so is a slice without usable rows."""
        last, versions = self._current()
        usable = usable_transactions(log, customer_column, date_column, amount_column, order_column, date_formats)
        order = F.when(~is_blank(F.col("order_id")), F.col("order_id").cast("string"))
        stop = F.raise_error(F.lit(BLANK_ORDER)).cast("string")
        slice_ = usable.select(
            "customer_id", F.coalesce(order, stop).alias("order_id"), F.col("amount").cast("double").alias("order_value"),
            F.col("purchased").alias("opened"), F.col("purchased").alias("closed"), F.lit(1).cast("long").alias("lines"),
        )
        bucket = F.pmod(F.xxhash64(F.col("customer_id").cast("string")), F.lit(self._buckets)).cast("int").alias("bucket")
        # Summed per (customer, order) before anything moves; the same sums merge the slice with what is there.
        new = summed(slice_)
        version = last + 1
        touched = [r["bucket"] for r in new.select(bucket).distinct().collect()]  # a row per bucket
        if not touched:
            raise DataProblem(NO_ROWS)
        known = self.rows()
        if known is not None:
            new = summed(new.unionByName(known.filter(F.col("bucket").isin(touched)).drop("bucket")))
        # What a failed run left behind under this name has no manifest and is replaced.
        new.select("*", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{self._folder}/rows-{version}")
        versions.update({b: version for b in touched})
        manifest = self._spark.createDataFrame(sorted(versions.items()), "bucket int, version int")
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{self._folder}/manifest-{version}")
        return version

    def rfm(self, reference_date: str | date | datetime | None = None) -> DataFrame:
        """The columns of ``build_rfm`` for all slices so far."""
        state = self.rows()
        if state is None:
            raise DataProblem(NO_ROWS)
        if reference_date is None:
            newest = state.agg(F.unix_micros(F.max("closed"))).first()[0]
            reference = F.lit(newest + MICROS_PER_DAY)
        else:
            reference = F.lit(int(_literal_instant(reference_date).timestamp() * 1_000_000))
        customers = state.groupBy("customer_id").agg(
            F.count(F.lit(1)).alias("frequency"), F.sum("order_value").alias("monetary_value"), F.avg("order_value").alias("average_order_value"),
            F.min("opened").alias("first"), F.max("closed").alias("last"),
        )
        last = F.unix_micros("last")
        return customers.select(
            "customer_id", _days(reference - last).alias("recency_days"), "frequency", "monetary_value", "average_order_value",
            _days(last - F.unix_micros("first")).alias("customer_tenure_days"),
        )


def summed(orders: DataFrame) -> DataFrame:
    """Lines or partial orders as one row per (customer, order)."""
    return orders.groupBy("customer_id", "order_id").agg(
        F.sum("order_value").alias("order_value"), F.min("opened").alias("opened"), F.max("closed").alias("closed"), F.sum("lines").alias("lines")
    )
