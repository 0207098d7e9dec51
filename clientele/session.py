"""Session settings and durable intermediate results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from clientele.errors import DataProblem

# Settings every analysis relies on; all of them can be changed on a running session.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.caseSensitive": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}
# Only read when a session starts: recording the Python call site of every expression doubles the time it takes to
# build wide projections.
START_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def new_session(app_name: str = "clientele", master: str | None = None, **settings: str) -> SparkSession:
    """Start (or reuse) a session with the runtime settings; extra settings use ``_`` for ``.``."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **START_SETTINGS}.items():
        builder = builder.config(key, value)
    for key, value in settings.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> None:
    """Naive timestamps are read as UTC everywhere in this package."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="clientele-checkpoint-"))
    else:
        raise DataProblem("Set spark.checkpoint.dir to a folder that every executor can reach.")


def scratch_folder(spark: SparkSession) -> str:
    """A new folder name below the shared checkpoint folder."""
    _ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/scratch-{uuid.uuid4().hex}"


def written(frame: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back."""
    folder = scratch_folder(frame.sparkSession)
    frame.write.parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)


def durable(frame: DataFrame) -> DataFrame:
    """Write a frame to the shared checkpoint folder once, then keep its blocks cached.

    Fits read the result dozens of times. The checkpoint cuts the lineage, so a lost executor costs a re-read of
    its blocks from shared storage rather than a re-run of everything upstream; the cache only saves those reads.
    """
    _ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True).persist(StorageLevel.MEMORY_AND_DISK)
