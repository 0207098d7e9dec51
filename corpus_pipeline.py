"""The training-data pipeline: quality, near copies, benchmark passages, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and all but the last return the
columns of ``docs``. ``run`` writes every stage's result as Parquet in the shared folder and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientele.llm.decontaminate import find_contamination, is_contaminated, suspected
from clientele.llm.near_copies import without_near_copies
from clientele.llm.packing import pack_documents
from clientele.llm.quality import statistics_table, train_quality, with_quality
from clientele.llm.secret_scan import without_secrets
from clientele.llm.shared import Scratch, fresh_name, read_table, stored

# Rows below this score go.
QUALITY_BAR = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quadratic discriminant does not reject. It learns from all labelled rows of ``docs``.

    Null and empty texts are scored like any other; without labels of both kinds nothing is rejected.
    """
    table = stored(statistics_table(docs, "doc_id", "text"))
    model = train_quality(table, read_table(spark, sf_dir, "labels"), F.lit(True))
    if model.classes is None:
        return docs
    score = fresh_name(docs, "score")
    return with_quality(docs, model, "text", score).filter(F.col(score) >= QUALITY_BAR).drop(score)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the smallest id (nulls first), ties by the other columns.

    Rows are near copies if their SimHash fingerprints (three-word shingles) are at most two bits apart, or if their
    five-word shingles have a similarity of 0.8 or more; groups are what such links of all rows connect. Equal texts are
    one row before texts are compared. Texts without words are one group.
    """
    return without_near_copies(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not contaminated with benchmark windows; whether a row is depends on its text alone."""
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    probe = docs.select(digest.alias("digest"), "text")
    found = find_contamination(probe, read_table(spark, sf_dir, "benchmark"), doc_id="digest")
    dirty = stored(found.filter(is_contaminated()).select("digest").distinct())
    # Texts that a filter of fixed size turns away are clean and stay where they are; the join decides on the others.
    suspect = suspected(spark, dirty.select(F.xxhash64("digest").alias("token")))
    held = fresh_name(docs, "held")
    marked = docs.withColumn(held, suspect(F.xxhash64(digest)))
    rest = marked.filter(F.col(held)).join(dirty, digest == dirty["digest"], "left_anti")
    return marked.filter(~F.col(held)).unionByName(rest).drop(held)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; secrets in the text are replaced by a mark, and n_chars follows where there is such a column."""
    clean = without_secrets(docs)
    if "n_chars" not in docs.columns:
        return clean
    changed = F.coalesce(F.length("text"), F.lit(0)).cast(dict(docs.dtypes)["n_chars"])
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(changed))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A bin for every piece of every row: doc_id, piece, first_unit, units, pack."""
    return pack_documents(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near copies", near_copy_stage),
    ("benchmark decontamination", benchmark_stage),
    ("secret scan", secret_stage),
    ("best-fit packing", packing_stage),
]
# Models, fingerprints and packing are beyond SQL: tests/llm compares each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:
        for i, (_, stage) in enumerate(STAGES[:-1]):
            with Scratch(spark) as own:
                kept = own.keep(stored(stage(spark, docs, sf_dir)))
            if i:
                scratch.drop(docs)
            docs = kept
        scratch.keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
