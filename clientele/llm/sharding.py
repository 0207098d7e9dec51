"""Shards by jump consistent hashing, without a ring table: DataFrame functions only."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clientele.llm.shared import fresh_name, partitions_for, range_bounds, range_of, stored, text_or_empty

# Fixed values of the published algorithm (Lamping and Veach, 2014).
MULTIPLIER = 2862933555777941757
FIRST_STEPS = 48
ROWS_PER_RANGE = 250_000


def jump_shard(key: str | Column, shards: int) -> Column:
    """Shard of a 64-bit key: 0 to ``shards`` - 1; null keys count as 0.

    Adding a shard moves a key only into the new one. The generator's 64-bit product runs in DECIMAL(38, 0), which
    holds it exactly. A key needs about ln(shards) jumps; ``FIRST_STEPS`` are always offered, and the rare key that is
    still jumping gets as many as there are shards, which no key exceeds.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    key = F.coalesce((F.col(key) if isinstance(key, str) else key).cast("long"), F.lit(0).cast("long"))
    wrap = F.lit(Decimal(2**64)).cast("decimal(20,0)")
    start = F.struct(
        F.pmod(key.cast("decimal(38,0)"), wrap).cast("decimal(20,0)").alias("state"),
        F.lit(-1).cast("long").alias("shard"),
        F.lit(0).cast("long").alias("next"),
    )

    def jump(at, _):
        product = at["state"].cast("decimal(20,0)") * F.lit(MULTIPLIER).cast("decimal(19,0)")
        state = F.pmod(product.cast("decimal(38,0)") + F.lit(1).cast("decimal(1,0)"), wrap).cast("decimal(20,0)")
        draw = F.floor(state / F.lit(2**33).cast("decimal(10,0)")).cast("double") + 1
        landed = F.floor((at["next"] + 1).cast("double") * (F.lit(float(2**31)) / draw)).cast("long")
        return F.when(at["next"] >= shards, at).otherwise(
            F.struct(state.alias("state"), at["next"].alias("shard"), landed.alias("next"))
        )

    some = F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, FIRST_STEPS))), start, jump)
    if shards <= FIRST_STEPS:
        return some["shard"].cast("int")
    rest = F.aggregate(F.sequence(F.lit(1), F.lit(shards)), some, jump)
    return F.when(some["next"] >= shards, some["shard"]).otherwise(rest["shard"]).cast("int")


def assign_shards(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``key``, size, text_crc32, shard, slot, grown_shard for every row.

    Slots number the rows of a shard without gaps in key order (nulls first; rows with one key by checksum and size).
    Numbering runs in key ranges of about ``rows_per_range`` rows: counts per (shard, range) become offsets, so a shard
    is never gathered in one task. The window that numbers a range streams and spills.
    Null texts are empty texts; columns beyond the two named are ignored.
    """
    spark = docs.sparkSession
    body = text_or_empty(F.col(text))
    rows = docs.select(
        F.col(key).alias("key"),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("crc"),
    )
    ids = docs.select(F.col(key).alias("key"))
    ranges = partitions_for(spark, ids.count(), rows_per_range)
    bounds = range_bounds(ids, "key", ranges)
    placed = stored(rows.select(
        "*", jump_shard("key", shards).alias("shard"), jump_shard("key", shards + 1).alias("grown"),
        range_of("key", bounds).alias("part"),
    ))
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "part").orderBy(F.col("key").asc_nulls_first(), "crc", "size")
    numbered = placed.withColumn("place", F.row_number().over(within) - 1)
    # shards x ranges rows, both parameters.
    joined = numbered.join(F.broadcast(offsets), ["shard", "part"])
    return joined.select(
        F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), "shard",
        (F.col("offset") + F.col("place")).cast("long").alias("slot"), F.col("grown").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int, key: str = "doc_id", rows_per_file: int = 1_000_000) -> None:
    """Write all columns as Parquet in one folder per shard; a large shard becomes several files."""
    name = fresh_name(docs, "shard")
    salt = F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(partitions_for(docs.sparkSession, 1, 1)))
    docs.withColumn(name, jump_shard(key, shards)).repartition(F.col(name), salt).write.option(
        "maxRecordsPerFile", rows_per_file
    ).partitionBy(name).parquet(path)
