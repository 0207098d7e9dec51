"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest. DataFrame functions
and Spark ML only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.llm.shared import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = (
    "length", "host_length", "path_length", "depth", "labels", "digit_ratio", "mark_ratio", "entropy", "host_entropy",
    "parameters", "has_fragment", "secure", "longest_label", "suffix_block_share", "suffix_seen", "first_block_share",
)
# Prior strength of the suffix statistics: this many rows at the overall share.
PRIOR_ROWS = 20.0


@dataclass(frozen=True)
class Rule:
    """``host/path`` prefix with its verdict; it fits the host and all its subdomains."""

    prefix: str
    verdict: str

    @property
    def host(self) -> str:
        return self.prefix.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.prefix.split("/", 1)[1]


@dataclass(frozen=True)
class UrlSettings:
    """``max_labelled`` rows at most (by hash of the URL) train the trees; statistics of suffixes use all labelled rows."""

    max_labelled: int = 20_000
    trees: int = 12
    depth: int = 4
    seed: int = 17


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null URL or one without ``://``."""
    cut = F.instr(url, "://")
    rest = F.when(cut > 0, F.substr(url, cut + F.lit(3))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def matched_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest fitting rule's prefix, or null. Rules are a configured list, tried from the longest on."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.prefix), r.prefix)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        found = F.when(fits, F.lit(rule.prefix)).otherwise(found)
    return found


def _entropy(text: Column) -> Column:
    """Bits per character, from the sorted characters' run lengths: sum of -p log2 p over distinct characters."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.greatest(F.size(letters), F.lit(1)).cast("double")

    def bits(c):
        share = (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n
        return -share * F.log2(F.greatest(share, F.lit(1e-12)))

    return F.aggregate(F.transform(F.array_distinct(letters), bits), F.lit(0.0), lambda a, b: a + b)


def _ratio(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text), F.lit(1))


def lexical_columns(url: Column, host: Column, path: Column) -> dict[str, Column]:
    labels = F.split(host, r"\.")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    values = {
        "length": F.length(url), "host_length": F.length(host), "path_length": F.length(path),
        "depth": F.regexp_count(path, F.lit("[^/]+")), "labels": F.size(labels),
        "digit_ratio": _ratio(url, "[0-9]"), "mark_ratio": _ratio(url, "[^0-9A-Za-z/.:]"),
        "entropy": _entropy(url), "host_entropy": _entropy(host),
        "parameters": F.regexp_count(query, F.lit("[^&]+")), "has_fragment": F.instr(url, "#") > 0,
        "secure": F.startswith(url, F.lit("https:")),
        "longest_label": F.array_max(F.transform(labels, lambda x: F.length(x))),
    }
    return {k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in values.items()}


def judge_urls(
    pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url", settings: UrlSettings = UrlSettings()
) -> DataFrame:
    """``key``, host, path, rule, verdict, block_score for every row.

    Rows that a rule decides are the labelled URLs. The trees learn their verdict from lexical features and suffix
    statistics (share of blocked URLs among those with the same host ending and first path segment) and decide
    the rest. If the labelled rows hold one verdict only, that verdict is the answer; without any, ``allow``.
    A null URL has an empty host and path and is scored like an empty one. Repeated rows are judged alike.
    """
    address = F.coalesce(F.col(url), F.lit(""))
    host, path = url_parts(F.col(url))
    base = pages.select(F.col(key).alias("key"), address.alias("address"), host.alias("host"), path.alias("path"))
    verdicts = F.create_map(*[F.lit(x) for r in rules for x in (r.prefix, r.verdict)]) if rules else None
    rule = matched_rule(F.col("host"), F.col("path"), rules)
    base = base.withColumn("rule", rule)
    decided = verdicts[F.col("rule")] if rules else F.lit(None).cast("string")
    base = base.withColumn("decided", F.when(F.col("rule").isNotNull(), decided))
    features = lexical_columns(F.col("address"), F.col("host"), F.col("path"))
    base = base.select(
        "*", F.substring_index("host", ".", -2).alias("suffix"), F.regexp_extract("path", "^/([^/]*)", 1).alias("first"),
        *[c.alias(n) for n, c in features.items()],
    )
    base = stored(base)
    blocked = (F.col("decided") == "block").cast("double")
    labelled = base.filter(F.col("decided").isNotNull())
    seen = labelled.agg(F.count(F.lit(1)).alias("n"), F.avg(blocked).alias("share")).first()
    result = lambda frame, verdict, score: frame.select(
        F.col("key").alias(key), "host", "path", "rule", F.coalesce("decided", verdict).alias("verdict"), score.alias("block_score")
    )
    if not seen["n"] or seen["share"] in (0.0, 1.0):
        answer = 1.0 if seen["n"] and seen["share"] == 1.0 else 0.0
        return result(base, F.lit("block" if answer else "allow"), F.lit(answer))
    share = seen["share"]

    def statistics(name: str, count: str, mean: str) -> DataFrame:
        n = F.count(F.lit(1))
        return labelled.groupBy(name).agg(
            F.log1p(n.cast("double")).alias(count), ((F.sum(blocked) + PRIOR_ROWS * share) / (n + PRIOR_ROWS)).alias(mean)
        )

    suffixes = stored(statistics("suffix", "suffix_seen", "suffix_block_share"))
    firsts = stored(statistics("first", "first_seen", "first_block_share"))
    full = base.join(suffixes, "suffix", "left").join(firsts, "first", "left").fillna(
        {"suffix_seen": 0.0, "suffix_block_share": share, "first_block_share": share}
    )
    full = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(full)
    model = fit_trees(full.filter(F.col("decided").isNotNull()).withColumn("label", blocked), seen["n"], settings)
    scored = model.transform(full.drop("rawPrediction", "probability", "prediction"))
    score = vector_to_array("probability")[1]
    return result(scored, F.when(score >= 0.5, F.lit("block")).otherwise(F.lit("allow")), score)


def fit_trees(labelled: DataFrame, rows: int, settings: UrlSettings) -> GBTClassificationModel:
    """Fit on about ``max_labelled`` rows, chosen by hash of the address."""
    sample = labelled
    if rows > settings.max_labelled:
        threshold = int(settings.max_labelled / rows * 1_000_000)
        sample = labelled.filter(F.pmod(F.xxhash64("address"), F.lit(1_000_000)) < threshold)
    sample = sample.select("features", "label")
    trees = GBTClassifier(
        featuresCol="features", labelCol="label", maxIter=settings.trees, maxDepth=settings.depth, stepSize=0.3,
        seed=settings.seed, maxBins=32, checkpointInterval=-1,
    )
    return trees.fit(stored(sample).coalesce(8))
