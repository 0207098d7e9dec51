"""Registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from clientele.llm.collocations import collocations
from clientele.llm.cross_polytope import nearest
from clientele.llm.decontaminate import find_contamination, is_contaminated
from clientele.llm.lz_print import fingerprint_documents
from clientele.llm.packing import pack_documents
from clientele.llm.quality import scored_quality, statistics_table, train_quality
from clientele.llm.repeats import remove_repeats
from clientele.llm.secret_scan import find_secrets, spans_as_text
from clientele.llm.shared import read_table, stored
from clientele.llm.sharding import assign_shards
from clientele.llm.simhash import near_copies
from clientele.llm.term_tree import ranked_documents
from clientele.llm.toxicity import scored_toxicity, train_toxicity
from clientele.llm.urls import Rule, judge_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SHARDS = 16
URL_RULES = [
    Rule("com/", "allow"), Rule("example.com/en/", "block"), Rule("www.example.com/en/", "allow"),
    Rule("net/es/", "block"), Rule("net/fr/", "block"),
]


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op4_jump_shards(spark, sf_dir):
    """Every document in one of 16 shards, and where it goes when a seventeenth is appended."""
    return assign_shards(read_table(spark, sf_dir, "documents"), SHARDS).withColumn("law", F.lit("key"))


@query
def op5_best_fit_packs(spark, sf_dir):
    """Every document (or its pieces, if longer than a bin) in a bin of 2,048 words."""
    return pack_documents(read_table(spark, sf_dir, "documents"))


@query
def op8_url_trees(spark, sf_dir):
    """Host, path, rule and verdict of every page."""
    return judge_urls(read_table(spark, sf_dir, "pages"), URL_RULES)


def _remainder(column: str, modulus: int):
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


@query
def op1_decontaminate(spark, sf_dir):
    """Documents against all benchmark items: windows of 13 words."""
    found = find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), is_contaminated().alias("contaminated"),
    )


@query
def op2_quality(spark, sf_dir):
    """Quality score of every document."""
    table = stored(statistics_table(read_table(spark, sf_dir, "documents"), "doc_id", "text"))
    model = train_quality(table, read_table(spark, sf_dir, "labels"), _remainder("id", 3) != 1)
    return scored_quality(table, model).select(
        F.col("id").alias("doc_id"), (_remainder("id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query
def op10_toxicity(spark, sf_dir):
    """Toxicity score of every document."""
    docs = read_table(spark, sf_dir, "documents")
    model = train_toxicity(docs, read_table(spark, sf_dir, "labels"), _remainder("id", 4) != 2)
    return scored_toxicity(docs, model).select(
        "doc_id", (_remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@query
def op3_golay_simhash(spark, sf_dir):
    """Fingerprint and near-copy component of every document."""
    found = near_copies(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("mark")), 16, "0").alias("fingerprint"), "component_id")


@query
def op6_secrets(spark, sf_dir):
    """Secrets of every document: fixed patterns and random-looking strings."""
    found = find_secrets(read_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(spans_as_text("base").cast("binary"), 256).alias("base_sha256"), spans_as_text("spans").alias("spans"),
    )


@query
def op7_lz_prints(spark, sf_dir):
    """Phrase fingerprints of every document, its edited text and the next document."""
    return fingerprint_documents(read_table(spark, sf_dir, "documents"))


@query
def op9_suffix_repeats(spark, sf_dir):
    """Strings of 50 bytes that an earlier document holds too, cut from every document."""
    found = remove_repeats(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


@query
def op11_collocations(spark, sf_dir):
    """The 2,000 phrases of each language that hold together best."""
    return collocations(read_table(spark, sf_dir, "documents"))


ORACLES["op11_collocations"] = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
    FROM documents
), totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
grams AS (
    SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
    FROM pieces, (VALUES (1), (2), (3), (4)) sizes(k) WHERE len(w) >= k
), counts AS (SELECT lang, k AS size, phrase, string_split(phrase, ' ') AS w, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
cuts AS (
    SELECT c.lang, c.phrase, c.f AS a, k, array_to_string(c.w[1:k], ' ') AS head, array_to_string(c.w[k + 1:], ' ') AS tail
    FROM counts c, (VALUES (1), (2), (3)) sizes(k) WHERE k < c.size
), scored AS (
    SELECT c.lang, c.phrase, a, x.f AS l, y.f AS r, k, CAST(2000000::HUGEINT * a // (x.f + y.f) AS BIGINT) AS score
    FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = head JOIN counts y ON y.lang = c.lang AND y.phrase = tail
), least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (
    SELECT lang, f, unnest(list_transform(range(1, size - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
    FROM counts, (VALUES (2), (3)) sizes(m) WHERE m < size
), over_parts AS (SELECT lang, phrase, max(f) AS most FROM inner_parts GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM least LEFT JOIN over_parts USING (lang, phrase) JOIN totals USING (lang)
WHERE most IS NULL OR 100 * most < 80 * a
QUALIFY rank <= 2000"""


@query
def op12_term_tree(spark, sf_dir):
    """The 50 best documents of every benchmark item."""
    return ranked_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


ORACLES["op12_term_tree"] = r"""
WITH words AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
queries AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), counts AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM queries) GROUP BY ALL),
weights AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
    FROM counts, totals GROUP BY term
), scored AS (
    SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)))) AS BIGINT) AS score
    FROM queries JOIN counts USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), totals GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY rank <= 50"""


@query
def op13_cross_polytope(spark, sf_dir):
    """The 20 nearest vectors found for every twentieth vector."""
    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def pipeline(spark, sf_dir):
    """All stages of the corpus pipeline over the documents."""
    return corpus_pipeline.run(spark, sf_dir)


if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
