"""One row of each group of near copies: SimHash links and links of shingle similarity, connected together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.llm.components import connected
from clientele.llm.near_text import similar_links
from clientele.llm.shared import Scratch, fresh_name, stored
from clientele.llm.simhash import mark_components, with_fingerprint


def _group_of_mark(distinct: DataFrame, mark: str, text: str) -> DataFrame:
    """Stored (mark, root): the group of every fingerprint."""
    spark = distinct.sparkSession
    with Scratch(spark) as scratch:
        # Texts of one SimHash component are one label; similar texts link labels.
        with Scratch(spark) as inner:
            marks = stored(distinct.select(F.col(f"`{mark}`").alias("mark")).distinct())
            roots = inner.keep(stored(mark_components(marks)))
        texts = distinct.select(F.col(f"`{mark}`").alias("node"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
        links = similar_links(texts, roots.select(F.col("mark").alias("node"), F.col("root").alias("label")))
        groups = stored(connected(links))
        joined = roots.withColumnRenamed("root", "label").join(groups.withColumnRenamed("node", "label"), "label", "left")
        return scratch.keep(stored(joined.select("mark", F.coalesce("root", "label").alias("root"))))


def without_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near copies: the one with the smallest id (nulls first), ties by the other columns.

    Rows are near copies if their SimHash fingerprints (three-word shingles) are at most two bits apart, or if their
    five-word shingles have a similarity of 0.8 or more; groups are what such links of all rows connect. Equal texts are
    one row before texts are compared. Texts without words are one group. Columns must be of types that have an order.
    """
    spark = docs.sparkSession
    mark, node, root = fresh_name(docs, "mark"), fresh_name(docs, "node"), fresh_name(docs, "root")
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    row = F.struct(F.col(doc_id), *[F.col(f"`{c}`") for c in docs.columns if c != doc_id])
    with Scratch(spark) as scratch:
        least = docs.groupBy(digest.alias("digest")).agg(F.min(row).alias("row"))
        distinct = with_fingerprint(least.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]), text, mark)
        # The one table of texts; all that follows reads them from here.
        distinct = scratch.keep(stored(distinct.withColumn(node, F.monotonically_increasing_id()), "zstd"))
        final = _group_of_mark(distinct, mark, text).select(F.col("mark").alias(mark), F.col("root").alias(root))

        # The smallest id decides; the other columns only where rows of one group have the same id.
        known = stored(distinct.select(F.col(node).alias("node"), F.col(mark), F.col(doc_id).alias("id")).join(final, mark).drop(mark))
        first = stored(known.groupBy(root).agg(F.min(F.struct("id")).alias("first")))
        tied = stored(known.join(first, root).filter(F.col("id").eqNullSafe(F.col("first.id"))).select("node", root))
        several = stored(tied.groupBy(root).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(root))
        drawn = stored(tied.join(several, root, "left_semi").select(F.col("node").alias(node), F.col(root)))
        least = distinct.join(drawn, node).groupBy(root).agg(F.min(F.struct(row.alias("row"), F.col(node).alias("node"))).alias("first"))
        stays = stored(tied.join(several, root, "left_anti").select("node").unionByName(least.select("first.node")))
        goes = scratch.keep(stored(known.join(stays, "node", "left_anti").select(F.col("node").alias(node))))
    return distinct.join(goes, node, "left_anti").select(*columns)
