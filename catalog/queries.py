"""Registered queries: name → function of (spark, folder) that returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.inputs import (
    MATRIX_CATEGORICAL,
    MATRIX_NUMERIC,
    RFM_BASES,
    audit_table,
    customer_base,
    matrix_config,
    nation_prepared,
    order_rfm,
    r6,
    rfm_prepared,
    table,
)
from clientele.functions.coerce import dtype_of, is_blank, quoted, to_label, to_number, to_timestamp
from clientele.operators import audit as A
from clientele.operators import diagnostics as D
from clientele.operators import prepare as P
from clientele.operators import profile as T
from clientele.operators import solution as S
from clientele.operators.fits import FitSettings, with_subsamples
from clientele.operators.rfm import build_rfm
from clientele.operators.rollup_state import RollupState
from clientele.operators.ward import WardHierarchy
from clientele.plans.compare import compare_solutions, fit_candidate, fit_solution, ready
from clientele.functions.names import unique_headers
from clientele.session import scratch_folder, use_utc, written
from clientele.sinks.exports import (
    analysis_manifest,
    dataset_fingerprint,
    neutral_text,
    settings_signature,
    write_csv,
    write_json,
    write_results,
)
from clientele.sources.files import load_data, read_json

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        use_utc(spark)
        return function(spark, sf_dir)

    QUERIES[function.__name__] = run
    return function


# ---------------------------------------------------------------------------------------------------------- roll-up


def rounded_rfm(frame: DataFrame) -> DataFrame:
    return frame.select(
        "customer_id",
        r6("recency_days").alias("recency_days"),
        "frequency",
        r6("monetary_value").alias("monetary_value"),
        r6("average_order_value").alias("average_order_value"),
        r6("customer_tenure_days").alias("customer_tenure_days"),
    )


@query
def rfm_count_rows(spark, sf_dir):
    return rounded_rfm(order_rfm(spark, sf_dir))


@query
def rfm_order_rollup(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_extendedprice")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    log = lines.join(orders, "l_orderkey")
    return rounded_rfm(build_rfm(log, "o_custkey", "l_shipdate", "l_extendedprice", "l_orderkey", check=False))


@query
def rfm_merged_slices(spark, sf_dir):
    """Order lines that arrive in three slices, by month of shipping: the state after the last equals one roll-up."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_extendedprice")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    log = lines.join(orders, "l_orderkey")
    state = RollupState(spark, scratch_folder(spark))
    for i in range(3):
        state.add(log.filter(F.pmod(F.month("l_shipdate"), F.lit(3)) == i), "o_custkey", "l_shipdate", "l_extendedprice", "l_orderkey")
    return rounded_rfm(state.rfm())


@query
def rfm_event_purchases(spark, sf_dir):
    log = table(spark, sf_dir, "events").filter("event_type = 'purchase'")
    return rounded_rfm(build_rfm(log, "user_id", "ts", "value", "event_id", check=False))


@query
def rfm_fixed_reference(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return rounded_rfm(build_rfm(orders, "o_custkey", "o_orderdate", "o_totalprice", reference_date="2002-01-01"))


# ------------------------------------------------------------------------------------------------ coercion of values


@query
def numeric_coercion(spark, sf_dir):
    balance = F.col("c_acctbal").cast("string")
    text = (
        F.when(F.col("c_mktsegment") == "MACHINERY", F.concat(F.lit("  "), balance, F.lit(" ")))
        .when(F.col("c_mktsegment") == "BUILDING", F.concat(balance, F.lit("d")))
        .when(F.col("c_mktsegment") == "FURNITURE", F.concat(balance, F.lit("e2")))
        .when(F.col("c_mktsegment") == "HOUSEHOLD", F.lit(""))
        .otherwise(F.lit("inf"))
    )
    frame = table(spark, sf_dir, "customer").select("c_custkey", text.alias("raw"))
    return frame.select("c_custkey", "raw", r6(to_number(F.col("raw"), dtype_of(frame, "raw"))).alias("value"))


@query
def date_coercion(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = (
        F.when(F.col("o_orderpriority") == "1-URGENT", day)
        .when(F.col("o_orderpriority") == "2-HIGH", F.date_format("o_orderdate", "MM/dd/yyyy"))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.concat(day, F.lit("T06:30:00")))
        .when(F.col("o_orderpriority") == "5-LOW", F.lit("soon"))
    )
    frame = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("raw"))
    read = to_timestamp(F.col("raw"), dtype_of(frame, "raw"), ["MM/dd/yyyy"])
    return frame.select("o_orderkey", F.unix_micros(read).alias("micros"))


@query
def blank_and_missing(spark, sf_dir):
    base = customer_base(spark, sf_dir)
    padded = F.when(F.col("market") == "BUILDING", "   ").otherwise(F.col("urgent_status"))
    label = to_label(F.col("urgent_status"), dtype_of(base, "urgent_status"))
    return (
        base.select(
            label.alias("label"), is_blank(padded).alias("blank"), to_label(F.col("active"), dtype_of(base, "active")).alias("active")
        )
        .groupBy("label", "blank", "active")
        .agg(F.count(F.lit(1)).alias("customers"))
    )


@query
def complete_rows(spark, sf_dir):
    base = customer_base(spark, sf_dir)
    amount = to_number(F.col("balance_text"), dtype_of(base, "balance_text"))
    kept = base.select("customer_id", "urgent_value", amount.alias("balance")).dropna()
    return kept.select("customer_id", r6("urgent_value").alias("urgent_value"), r6("balance").alias("balance"))


# ------------------------------------------------------------------------------------------------------------- audit


@query
def table_overview(spark, sf_dir):
    return A.table_overview(customer_base(spark, sf_dir).select("nation", "market", "band", "urgent_status", "active"))


def profile(spark, sf_dir):
    return A.column_profile(audit_table(spark, sf_dir))


@query
def quality_report(spark, sf_dir):
    return A.data_quality_report(audit_table(spark, sf_dir))


@query
def pii_columns(spark, sf_dir):
    return A.likely_pii_columns(profile(spark, sf_dir))


@query
def sensitive_columns(spark, sf_dir):
    return A.likely_sensitive_columns(profile(spark, sf_dir))


@query
def id_candidates(spark, sf_dir):
    return A.likely_id_columns(profile(spark, sf_dir))


@query
def default_bases(spark, sf_dir):
    return A.default_basis_columns(profile(spark, sf_dir), "customer_id")


@query
def usable_bases(spark, sf_dir):
    return A.usable_basis_columns(profile(spark, sf_dir), "customer_id").select("ordinal", "column")


@query
def suggested_bases(spark, sf_dir):
    columns = profile(spark, sf_dir)
    found = None
    for recipe in ("auto", "behavior", "profile"):
        part = A.suggest_basis_columns(columns, "customer_id", recipe).withColumn("recipe", F.lit(recipe))
        found = part if found is None else found.unionByName(part)
    return found


@query
def descriptor_suggestions(spark, sf_dir):
    return A.descriptor_columns(profile(spark, sf_dir), "customer_id", ["recency_days", "order_frequency", "annual_spend"])


@query
def log_roles(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("status"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderkey").alias("order_id"),
        F.col("o_orderdate").alias("order_date"),
        F.col("o_totalprice").alias("amount"),
    )
    return A.transaction_roles(A.column_profile(orders))


@query
def customer_contract(spark, sf_dir):
    customer = A.customer_contract(table(spark, sf_dir, "customer"), "c_custkey", ["c_acctbal", "c_mktsegment"])
    orders = A.customer_contract(table(spark, sf_dir, "orders"), "o_custkey", ["o_totalprice"])
    return customer.withColumn("source", F.lit("customer")).unionByName(orders.withColumn("source", F.lit("orders")))


@query
def high_corr_pairs(spark, sf_dir):
    pairs = A.correlated_pairs(
        customer_base(spark, sf_dir),
        ["recency_days", "frequency", "monetary_value", "average_order_value", "customer_tenure_days", "urgent_value", "event_value"],
        threshold=0.3,
    )
    return pairs.select("left", "right", r6("correlation").alias("correlation"))


@query
def binary_numeric(spark, sf_dir):
    base = customer_base(spark, sf_dir).select(
        "frequency", F.col("active").cast("int").alias("active_flag"), F.lit(7.0).alias("same"), "urgent_value"
    )
    return A.binary_numeric_columns(A.column_profile(base), base.columns)


# ------------------------------------------------------------------------------------------------------- preparation


def plain_matrix(spark, sf_dir):
    base = customer_base(spark, sf_dir).persist()
    return base, P.prepare_features(base, matrix_config())


@query
def infer_types(spark, sf_dir):
    base = customer_base(spark, sf_dir)
    names = ["recency_days", "nation", "balance_text", "active", "urgent_value", "urgent_status"]
    numeric, _ = P.infer_feature_types(base, names)
    # The decision is per column; the share of readable values behind it comes from the whole table.
    cells = [
        F.struct(
            F.lit(name).alias("column"),
            F.lit("numeric" if name in numeric else "categorical").alias("kind"),
            F.count(quoted(name)).alias("present"),
        )
        for name in names
    ]
    return base.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


@query
def prep_missing_audit(spark, sf_dir):
    found = P.missing_audit(customer_base(spark, sf_dir), [*MATRIX_NUMERIC, "event_value"])
    return found.select("column", "rows", "missing", "unreadable", r6("missing_share").alias("missing_share"), "heavy")


@query
def prep_impute(spark, sf_dir):
    base = customer_base(spark, sf_dir).persist()
    config = P.PreprocessConfig(
        ("urgent_value", "balance_text", "event_value"), clip_outliers=False, log_skewed=False, standardize=False
    )
    wide = P.prepare_features(base, config).transform(base, "customer_id")
    return wide.select("id", r6("f_0").alias("urgent_value"), r6("f_1").alias("balance_text"), r6("f_2").alias("event_value"))


@query
def prep_steps(spark, sf_dir):
    _, model = plain_matrix(spark, sf_dir)
    rows = [(s.column, s.median, s.lower, s.upper, s.log, s.mean, s.scale) for s in model.numeric]
    found = spark.createDataFrame(
        rows, "column string, median double, lower double, upper double, logged boolean, mean double, scale double"
    )
    return found.select(
        "column", "logged", *[r6(name).alias(name) for name in ("median", "lower", "upper", "mean", "scale")]
    )


@query
def prep_standardize(spark, sf_dir):
    frame = rfm_prepared(spark, sf_dir).withColumn("x", vector_to_array("features"))
    return frame.select("id", *[r6(F.col("x")[i]).alias(name) for i, name in enumerate(RFM_BASES)])


@query
def level_counts(spark, sf_dir):
    return P.level_counts(customer_base(spark, sf_dir), [*MATRIX_CATEGORICAL, "market"]).select(
        "feature", "level", F.col("n").alias("customers")
    )


@query
def prep_onehot_rare(spark, sf_dir):
    base = customer_base(spark, sf_dir).persist()
    model = P.prepare_features(base, P.PreprocessConfig((), ("nation",)))
    wide = model.transform(base, "customer_id")
    # One row per indicator: which level it stands for and how many customers have it.
    cells = [
        F.struct(F.lit(name).alias("indicator"), F.sum(f"f_{i}").cast("long").alias("customers"))
        for i, name in enumerate(model.feature_names)
    ]
    return wide.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


@query
def prep_matrix(spark, sf_dir):
    base, model = plain_matrix(spark, sf_dir)
    wide = model.transform(base, "customer_id")
    numeric = [r6(f"f_{i}").alias(name) for i, name in enumerate(model.feature_names[: len(MATRIX_NUMERIC)])]
    place = {name: f"f_{i}" for i, name in enumerate(model.feature_names)}
    nation = F.round(
        sum((F.col(place[n]) for n in model.feature_names if n.startswith("nation_")), F.lit(0.0)), 6
    )
    return wide.select(
        "id",
        *numeric,
        nation.alias("nation_weight"),
        F.col(place["nation_infrequent"]).alias("nation_infrequent"),
        *[F.col(place[f"urgent_status_{v}"]).alias(f"urgent_status_{v}") for v in ("F", "Missing", "O", "P")],
        *[F.col(place[f"active_{v}"]).alias(f"active_{v}") for v in ("False", "True")],
    )


@query
def many_levels_warning(spark, sf_dir):
    base = customer_base(spark, sf_dir)
    most = matrix_config().max_categories
    return (
        P.level_counts(base, ["nation", "market", "balance_text"])
        .groupBy("feature")
        .agg(F.count(F.lit(1)).alias("levels"))
        .select("feature", "levels", (F.col("levels") > 2 * most).alias("warn"))
    )


# ------------------------------------------------------------------------------------------ diagnostics, given labels

GIVEN = {"market": 5, "band": 3, "active": 2}


@query
def segment_sizes(spark, sf_dir):
    sized = D.segment_sizes(customer_base(spark, sf_dir), "market")
    return sized.select("market", "customers", r6("share").alias("share"))


@query
def segment_balance(spark, sf_dir):
    found = None
    base = customer_base(spark, sf_dir)
    for label in ("market", "band", "nation"):
        part = D.size_balance(base, label).withColumn("labelling", F.lit(label))
        found = part if found is None else found.unionByName(part)
    return found.select(
        "labelling",
        "customers",
        "segments",
        "smallest_segment_customers",
        *[r6(f"`{n}`").alias(n) for n in ("smallest_segment_%", "largest_segment_%", "balance")],
    )


def separation(frame: DataFrame, labels) -> list[tuple[str, float, float]]:
    rows = []
    for label in labels:
        stats = D.segment_statistics(frame, label)
        spread = D.mean_spread(frame, label, stats)
        rows.append((label, float(D.calinski_harabasz(stats)), float(D.davies_bouldin(stats, spread))))
    return rows


@query
def calinski_harabasz(spark, sf_dir):
    frame = rfm_prepared(spark, sf_dir)
    rows = [(label, float(D.calinski_harabasz(stats))) for label, stats in D.grouped_statistics(frame, list(GIVEN)).items()]
    return spark.createDataFrame(rows, "labelling string, v double").select("labelling", r6("v").alias("calinski_harabasz"))


@query
def davies_bouldin(spark, sf_dir):
    frame = rfm_prepared(spark, sf_dir)
    found = D.grouped_statistics(frame, list(GIVEN))
    spread = D.grouped_spread(frame, found)
    rows = [(label, float(D.davies_bouldin(found[label], spread[label]))) for label in GIVEN]
    return spark.createDataFrame(rows, "labelling string, v double").select("labelling", r6("v").alias("davies_bouldin"))


@query
def silhouette_euclid(spark, sf_dir):
    scores = D.silhouette_rows(rfm_prepared(spark, sf_dir), list(GIVEN))
    return scores.groupBy("labelling").agg(r6(F.avg("silhouette")).alias("silhouette"), F.count(F.lit(1)).alias("sampled"))


@query
def embedding_label_separation(spark, sf_dir):
    """Labels without structure over 64 columns: the noise case."""
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), "label"
    )
    stats = D.segment_statistics(vectors, "label")
    spread = D.mean_spread(vectors, "label", stats)
    row = (len(stats.labels), float(D.calinski_harabasz(stats)), float(D.davies_bouldin(stats, spread)))
    found = spark.createDataFrame([row], "segments long, ch double, db double")
    scores = D.silhouette_rows(vectors, ["label"]).agg(F.avg("silhouette").alias("s"))
    return found.select(
        "segments",
        F.round("ch", 4).alias("calinski_harabasz"),
        F.round("db", 4).alias("davies_bouldin"),
        F.round(scores.scalar(), 5).alias("silhouette"),
    )


PAIRS = {"market|band": ("market", "band"), "market|nation": ("market", "nation"), "active|band": ("active", "band")}


@query
def ari_pairs(spark, sf_dir):
    base = customer_base(spark, sf_dir)
    return D.pair_agreement(base, PAIRS).select("pair", F.round("ari", 8).alias("ari"))


@query
def method_agreement(spark, sf_dir):
    base = customer_base(spark, sf_dir)
    pairs = D.pair_agreement(base, PAIRS).select(
        F.split("pair", r"\|")[0].alias("method_a"), F.split("pair", r"\|")[1].alias("method_b"), F.lit(3).alias("segments"), "ari"
    )
    found = D.method_agreement(pairs)
    return found.select("algorithm_key", "segments", F.round("cross_method_agreement", 8).alias("cross_method_agreement"))


def given_candidates(spark, sf_dir) -> DataFrame:
    """Evidence about the given labellings, one row each, shaped like the comparison's candidate table."""
    frame = rfm_prepared(spark, sf_dir)
    sizes = None
    for order, (label, k) in enumerate(GIVEN.items()):
        part = D.size_balance(frame, label).withColumn("algorithm_key", F.lit(label)).withColumn("order", F.lit(order))
        sizes = part if sizes is None else sizes.unionByName(part)
    scores = (
        D.silhouette_rows(frame, list(GIVEN))
        .groupBy(F.col("labelling").alias("algorithm_key"))
        .agg(F.avg("silhouette").alias("silhouette"))
    )
    # Agreement with the order-count bands stands in for resampling stability; markets have no peer at their count.
    same = D.pair_agreement(frame, {label: (label, "band") for label in GIVEN}).withColumnRenamed("pair", "algorithm_key")
    spreads = spark.createDataFrame(
        [(label, db) for label, _, db in separation(frame, GIVEN)], "algorithm_key string, davies_bouldin double"
    )
    return (
        sizes.join(scores, "algorithm_key")
        .join(same.withColumnRenamed("ari", "stability"), "algorithm_key")
        .join(spreads, "algorithm_key")
        .withColumn("method", F.upper("algorithm_key"))
        .withColumn("stability_repeats", F.lit(6))
        .withColumn("stability_successful_repeats", F.when(F.col("algorithm_key") == "active", 3).otherwise(6))
        .withColumn("stability_std", F.lit(0.0))
        .withColumn("cross_method_agreement", F.when(F.col("algorithm_key") != "market", F.col("stability")))
    )


def ranked_candidates(spark, sf_dir) -> DataFrame:
    return D.rank_candidates(D.quality_label(D.evidence_score(given_candidates(spark, sf_dir))))


@query
def evidence_score(spark, sf_dir):
    found = D.evidence_score(given_candidates(spark, sf_dir))
    return found.select("algorithm_key", r6("recommendation_score").alias("recommendation_score"), "agreement_component_source")


@query
def quality_labels(spark, sf_dir):
    """Quality of every nation's stand-alone figures: thresholds met by data-driven values."""
    base = customer_base(spark, sf_dir)
    per_nation = base.groupBy("nation").agg(
        F.count(F.lit(1)).alias("smallest_segment_customers"),
        F.avg(F.col("active").cast("double")).alias("silhouette"),
        F.avg((F.col("frequency") >= 8).cast("double")).alias("stability"),
        (100 * F.avg((F.col("band") == "many").cast("double"))).alias("smallest_segment_%"),
        (10 * F.count(F.lit(1))).alias("customers"),
        F.max("frequency").alias("stability_repeats"),
        F.min("frequency").alias("stability_successful_repeats"),
    )
    return D.quality_label(per_nation).select("nation", "quality")


@query
def ranking(spark, sf_dir):
    return ranked_candidates(spark, sf_dir).select("algorithm_key", "segments", "quality", "recommended", "position")


@query
def verdict(spark, sf_dir):
    return D.verdict(ranked_candidates(spark, sf_dir))


@query
def score_curve(spark, sf_dir):
    found = D.score_curve(ranked_candidates(spark, sf_dir))
    return found.select(
        "method", "segments", "recommended", "quality", "smallest_segment_customers",
        *[
            r6(f"`{n}`").alias(n)
            for n in (
                "recommendation_score", "silhouette", "stability", "stability_std", "cross_method_agreement",
                "smallest_segment_%", "davies_bouldin",
            )
        ],
    )


# -------------------------------------------------------------------------------------- chosen solution, given labels


@query
def segment_naming(spark, sf_dir):
    return S.segment_names(customer_base(spark, sf_dir), "market")


@query
def confidence_centroid(spark, sf_dir):
    frame = rfm_prepared(spark, sf_dir)
    scored = S.with_confidence(frame, "band", D.segment_statistics(frame, "band"))
    return scored.select("id", "band", r6("confidence").alias("confidence"))


@query
def confidence_summary(spark, sf_dir):
    frame = rfm_prepared(spark, sf_dir)
    found = S.confidence_summary(S.with_confidence(frame, "band", D.segment_statistics(frame, "band")))
    return found.select(*[r6(name).alias(name) for name in found.columns])


@query
def centroid_distances(spark, sf_dir):
    return D.centroid_distances(rfm_prepared(spark, sf_dir), "market", digits=6)


# --------------------------------------------------------------------------------------------- profiles, given labels

BASES = ("recency_days", "frequency", "urgent_status", "nation")
DESCRIPTORS = ("urgent_value", "average_order_value", "market", "active")
NUMERIC = ("recency_days", "frequency", "urgent_value", "average_order_value")
CATEGORICAL = ("urgent_status", "nation", "market", "active")
NAMES = {"few": "Occasional", "many": "Regulars"}


@query
def segment_summary(spark, sf_dir):
    found = T.segment_summary(customer_base(spark, sf_dir), "band", NAMES)
    return found.select("segment", "name", "customers", r6("`share_%`").alias("share_%"))


def numeric_by_band(spark, sf_dir, base: DataFrame | None = None):
    return T.numeric_profile(base or customer_base(spark, sf_dir).persist(), NUMERIC, BASES, "band")


def categorical_by_band(spark, sf_dir, base: DataFrame | None = None):
    return T.categorical_profile(base or customer_base(spark, sf_dir), CATEGORICAL, BASES, "band")


@query
def numeric_profile(spark, sf_dir):
    found = numeric_by_band(spark, sf_dir)
    return found.select(
        "segment", "role", "feature",
        *[r6(n).alias(n) for n in ("mean", "median", "overall_mean", "index_100", "z_difference")],
    )


@query
def categorical_profile(spark, sf_dir):
    found = categorical_by_band(spark, sf_dir)
    return found.select(
        "segment", "role", "feature", "level", "is_segment_mode",
        *[r6(f"`{n}`").alias(n) for n in ("segment_share_%", "overall_share_%", "index_100")],
    )


@query
def segment_cards(spark, sf_dir):
    base = customer_base(spark, sf_dir).persist()
    summary = T.segment_summary(base, "band")
    cards = T.segment_cards(summary, numeric_by_band(spark, sf_dir, base), categorical_by_band(spark, sf_dir, base))
    return cards.select("segment", "suggested_name")


@query
def trait_phrases(spark, sf_dir):
    found = numeric_by_band(spark, sf_dir)
    return found.select("segment", "feature", T.trait_phrase(F.col("feature"), F.col("z_difference")).alias("phrase"))


@query
def snake_profile(spark, sf_dir):
    found = T.snake_profile(numeric_by_band(spark, sf_dir), NAMES)
    return found.select("segment", "segment_name", "feature", r6("z_difference").alias("z_difference"))


@query
def descriptor_notes(spark, sf_dir):
    base = customer_base(spark, sf_dir).persist()
    found = T.descriptor_notes(numeric_by_band(spark, sf_dir, base), categorical_by_band(spark, sf_dir, base))
    return found.select("segment", "kind", "feature", "level", r6("strength").alias("strength"))


@query
def anova(spark, sf_dir):
    found = T.anova_table(customer_base(spark, sf_dir), NUMERIC, "band")
    return found.select("variable", F.round("F", 4).alias("f_value"), "df_between", "df_within", r6("eta_squared").alias("eta_squared"))


@query
def anova_p_values(spark, sf_dir):
    return T.anova_table(customer_base(spark, sf_dir), NUMERIC, "market").select("variable", r6("p_value").alias("p_value"))


@query
def segment_map(spark, sf_dir):
    frame = rfm_prepared(spark, sf_dir)
    scored = S.with_confidence(frame, "band", D.segment_statistics(frame, "band"))
    scored = scored.select(F.col("id").alias("segment"), F.col("band").alias("chosen"), "confidence")
    found = T.build_segment_map(scored, "segment", NAMES, "chosen")
    return found.select("customer_segment", "segment", "segment_name", r6("membership_confidence").alias("membership_confidence"))


@query
def edited_names(spark, sf_dir):
    edits = (
        customer_base(spark, sf_dir)
        .groupBy(F.col("nation").alias("segment"))
        .agg(F.max("urgent_status").alias("status"), F.min("market").alias("market"))
        .select(
            "segment",
            F.when(F.col("status") == "P", F.concat(F.lit(" "), F.lower("market"), F.lit(" "))).otherwise("  ").alias("name"),
        )
    )
    return T.resolve_names(edits)


@query
def map_sample(spark, sf_dir):
    base = customer_base(spark, sf_dir)
    found = T.map_sample(base, "customer_id", ["recency_days", "monetary_value", "band"])
    return found.select("customer_id", r6("recency_days").alias("recency_days"), r6("monetary_value").alias("monetary_value"), "band")


@query
def box_stats(spark, sf_dir):
    found = T.box_summary(customer_base(spark, sf_dir).persist(), "recency_days", "band")
    return found.select("segment", "outliers", *[r6(n).alias(n) for n in ("q1", "median", "q3", "lower_whisker", "upper_whisker")])


# ----------------------------------------------------------------------------------------------------------- exports


@query
def spreadsheet_safe(spark, sf_dir):
    """Whole document texts, with a formula, a control character or nothing in front, depending on their language."""
    documents = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(F.col("lang") == "en", F.concat(F.lit("  =1+1 "), "text"))
        .when(F.col("lang") == "fr", F.concat(F.lit("\u0007-"), "text"))
        .otherwise(F.col("text"))
        .alias("text"),
    )
    safe = documents.select("doc_id", neutral_text(F.col("text")).alias("text"))
    return safe.select("doc_id", F.length("text").alias("length"), F.md5("text").alias("digest"))


@query
def fingerprint(spark, sf_dir):
    base = customer_base(spark, sf_dir).select("customer_id", "frequency", "market", "urgent_status", "balance_text")
    return dataset_fingerprint(base, base.columns)


@query
def csv_round_trip(spark, sf_dir):
    """Customers written as neutralised delimited files and loaded again with detected types."""
    folder = f"{scratch_folder(spark)}.csv"
    base = customer_base(spark, sf_dir)
    write_csv(base.select("customer_id", "frequency", "recency_days", "active", "market", "urgent_status", "balance_text"), folder)
    back = load_data(spark, folder).tables["customers"]
    return back.withColumn("recency_days", r6("recency_days"))


@query
def json_round_trip(spark, sf_dir):
    """Order rows written as JSON lines and loaded again; key order and nulls survive."""
    folder = scratch_folder(spark)
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_totalprice", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("priority")
    )
    write_json({"orders": orders}, folder)
    back = read_json(spark, f"{folder}/orders")["customers"]
    return back.withColumn("o_totalprice", r6("o_totalprice"))


@query
def result_pack(spark, sf_dir):
    """A pack of several tables in folders with cleaned names, counted after reading it back."""
    base = customer_base(spark, sf_dir).persist()
    tables = {
        "Customer/segment map": base.select("customer_id", "band"),
        "Customer:segment map": T.segment_summary(base, "band"),
        "Levels of all categorical columns of the pack": P.level_counts(base, MATRIX_CATEGORICAL),
    }
    found = None
    for name, path in write_results(tables, scratch_folder(spark), "parquet").items():
        part = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table"), F.lit(path.rsplit("/", 1)[-1]).alias("folder"), "rows"
        )
        found = part if found is None else found.unionByName(part)
    return found


@query
def header_names(spark, sf_dir):
    """A delimited file whose headers are made of data, repeated, padded and blank: loaded headers are unique."""
    folder = f"{scratch_folder(spark)}.csv"
    name = F.col("n_name")
    cells = table(spark, sf_dir, "nation").select(
        "n_nationkey", F.concat_ws(",", name, F.concat(F.lit(" "), name, F.lit(" ")), F.concat(name, F.lit("__2")), F.lit(" ")).alias("four")
    )
    line = cells.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "four"))), lambda c: c["four"]), ",").alias("value"))
    line.select(F.concat_ws("\n", "value", F.regexp_replace("value", "[^,]+", "7")).alias("value")).coalesce(1).write.text(folder)
    loaded = load_data(spark, folder).tables["customers"]
    places = F.array(*[F.struct(F.lit(i).cast("long").alias("place"), F.lit(c).alias("header")) for i, c in enumerate(loaded.columns)])
    return loaded.select(F.inline(places))


def _document(spark, frame: DataFrame, order: str, text) -> str:
    """A one-document JSON file with the rows of a table."""
    folder = f"{scratch_folder(spark)}.json"
    rows = frame.agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), F.to_json(F.struct("*")).alias("row")))), lambda r: r["row"]).alias("rows"))
    rows.select(text(F.array_join("rows", ",\n")).alias("value")).coalesce(1).write.text(folder)
    return folder


@query
def json_list(spark, sf_dir):
    """Parts as JSON lists of records, a file per thousand keys, loaded again: key order and values survive."""
    parts = table(spark, sf_dir, "part").select("p_type", "p_partkey", F.col("p_retailprice").alias("a_price"))
    folder = f"{scratch_folder(spark)}.json"
    lists = parts.groupBy(F.floor(F.col("p_partkey") / 1000).alias("range")).agg(F.collect_list(F.struct(*parts.columns)).alias("rows"))
    lists.select(F.to_json("rows").alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
    back = load_data(spark, folder).tables["customers"]
    place = F.lit(",".join(back.columns))
    return back.select("p_partkey", "p_type", r6("a_price").alias("a_price"), place.alias("key_order"))


@query
def json_named_lists(spark, sf_dir):
    """One JSON object of two record lists: two tables."""
    regions = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    folder = _document(
        spark, regions, "r_regionkey", lambda t: F.concat(F.lit('{"suppliers": ['), t, F.lit('], "empty": [], "again": ['), t, F.lit("]}"))
    )
    tables = load_data(spark, folder).tables
    counted = [t.select(F.lit(n).alias("table"), "r_regionkey", "r_name") for n, t in sorted(tables.items())]
    return counted[0].unionByName(counted[1])


@query
def json_one_record(spark, sf_dir):
    """A JSON-lines file of a single record is a table of one row."""
    folder = scratch_folder(spark)
    one = table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("orders"), F.max("o_orderpriority").alias("last"), F.min("o_orderkey").alias("first"))
    write_json({"one": one}, folder)
    return read_json(spark, f"{folder}/one")["customers"]


@query
def json_columns(spark, sf_dir):
    """A column-oriented JSON object becomes rows."""
    folder = f"{scratch_folder(spark)}.json"
    rows = F.sort_array(F.collect_list(F.struct("s_suppkey", "s_name")))
    packed = table(spark, sf_dir, "supplier").agg(rows.alias("r")).select(
        F.to_json(F.struct(F.col("r.s_suppkey").alias("key"), F.col("r.s_name").alias("name"))).alias("value")
    )
    packed.coalesce(1).write.text(folder)
    return load_data(spark, folder).tables["customers"]


@query
def csv_semicolon_multiline(spark, sf_dir):
    """Notes with line breaks, quotes and delimiters in a semicolon file: every row comes back whole."""
    folder = f"{scratch_folder(spark)}.csv"
    notes = table(spark, sf_dir, "customer").select(
        "c_custkey", F.concat(F.lit('said; "'), F.col("c_mktsegment"), F.lit('"\nand left '), F.col("c_name")).alias("note"),
        r6("c_acctbal").alias("balance"),
    )
    notes.write.option("header", True).option("sep", ";").option("quote", '"').option("escape", '"').csv(folder)
    return load_data(spark, folder).tables["customers"]


@query
def folder_of_tables(spark, sf_dir):
    """A folder with a delimited, a JSON-lines and a Parquet table, counted after loading it as one source."""
    folder = scratch_folder(spark)
    table(spark, sf_dir, "nation").write.option("header", True).csv(f"{folder}/nation.csv")
    table(spark, sf_dir, "supplier").select("s_suppkey", "s_name").write.json(f"{folder}/supplier.jsonl")
    table(spark, sf_dir, "customer").write.parquet(f"{folder}/customer.parquet")
    found = None
    for name, loaded in sorted(load_data(spark, folder).tables.items()):
        part = loaded.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table"), "rows", F.lit(len(loaded.columns)).cast("long").alias("columns")
        )
        found = part if found is None else found.unionByName(part)
    return found


@query
def date_formats(spark, sf_dir):
    """Orders dated as month/day/year text: the layout is detected from the whole column."""
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", F.date_format("o_orderdate", "M/d/yyyy").alias("day"), "o_totalprice"
    )
    return rounded_rfm(build_rfm(orders, "o_custkey", "day", "o_totalprice"))


@query
def manifest(spark, sf_dir):
    base = customer_base(spark, sf_dir).persist()
    model = P.prepare_features(base, matrix_config())
    facts = {"algorithm": "kmeans", "segments": 4, "basis_variables": list(MATRIX_NUMERIC), "preprocessing": model.audit}
    facts["signature"] = settings_signature(spark, facts)
    return analysis_manifest(spark, facts)


# --------------------------------------------------------------------------------------------------- fits and pipeline

SETTINGS = FitSettings()


def prepared_rfm(spark, sf_dir) -> DataFrame:
    return ready(rfm_prepared(spark, sf_dir))


def solved(spark, sf_dir, algorithm: str, k: int = 4):
    return fit_solution(prepared_rfm(spark, sf_dir), algorithm, k, settings=SETTINGS)


def solution_rows(spark, sf_dir, algorithm: str) -> DataFrame:
    found = solved(spark, sf_dir, algorithm)
    return found.assignments.select("id", "segment", r6("confidence").alias("confidence"))


def solution_violations(spark, sf_dir, algorithm: str, least_confidence: float = 0.0) -> DataFrame:
    """Broken promises of a fit: ids lost or repeated, empty or missing segments, confidence out of bounds, and segments
    that explain less than a tenth of the spread on the two-axis map (labels drawn at random explain next to nothing)."""
    rows = written(solved(spark, sf_dir, algorithm).assignments)
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    known = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    expected = customers.join(known, "id", "left_semi")
    lost = expected.join(rows, "id", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    repeated = rows.groupBy("id").count().filter("count > 1").agg(F.count(F.lit(1)).alias("n"))
    outside = rows.agg(F.count_if(~F.col("confidence").between(least_confidence, 1) | F.col("confidence").isNull()).alias("n"))
    wrong_k = rows.agg((F.abs(F.count_distinct("segment") - 4)).alias("n"))
    within = rows.groupBy("segment").agg((F.count(F.lit(1)) * (F.var_pop("PC1") + F.var_pop("PC2"))).alias("w")).agg(F.sum("w").alias("w"))
    total = rows.agg((F.count(F.lit(1)) * (F.var_pop("PC1") + F.var_pop("PC2"))).alias("t"))
    scattered = within.select((F.col("w") > 0.9 * total.scalar()).cast("long").alias("n"))
    parts = lost.unionByName(repeated).unionByName(outside).unionByName(wrong_k).unionByName(scattered)
    return parts.agg(F.sum("n").cast("long").alias("violations"))


@query
def kmeans_fit(spark, sf_dir):
    return solution_rows(spark, sf_dir, "kmeans")


@query
def gmm_fit(spark, sf_dir):
    return solution_rows(spark, sf_dir, "gmm")


@query
def ward_fit(spark, sf_dir):
    return solution_rows(spark, sf_dir, "hierarchical")


@query
def spectral_fit(spark, sf_dir):
    return solution_rows(spark, sf_dir, "spectral")


@query
def kmeans_violations(spark, sf_dir):
    """A customer whose own segment centre is not the nearest one would have a confidence below one half."""
    return solution_violations(spark, sf_dir, "kmeans", 0.499)


@query
def gmm_violations(spark, sf_dir):
    return solution_violations(spark, sf_dir, "gmm")


@query
def ward_violations(spark, sf_dir):
    return solution_violations(spark, sf_dir, "hierarchical")


@query
def spectral_violations(spark, sf_dir):
    return solution_violations(spark, sf_dir, "spectral")


@query
def pca_map(spark, sf_dir):
    found = solved(spark, sf_dir, "kmeans")
    return found.assignments.select("id", r6("PC1").alias("PC1"), r6("PC2").alias("PC2"), "segment")


@query
def pca_map_violations(spark, sf_dir):
    """The axes are centred and uncorrelated, and the first carries at least as much variance."""
    rows = solved(spark, sf_dir, "kmeans").assignments
    found = rows.agg(
        F.abs(F.avg("PC1")).alias("m1"), F.abs(F.avg("PC2")).alias("m2"),
        F.abs(F.corr("PC1", "PC2")).alias("c"), (F.var_pop("PC2") - F.var_pop("PC1")).alias("v"),
    )
    broken = sum(((F.col(n) > 1e-6).cast("long") for n in ("m1", "m2", "c", "v")), F.lit(0))
    return found.select(broken.cast("long").alias("violations"))


def compared(spark, sf_dir, algorithms=("kmeans", "hierarchical"), counts=(3, 4)):
    return compare_solutions(prepared_rfm(spark, sf_dir), algorithms, counts, 4, settings=SETTINGS)


@query
def subsample_sizes(spark, sf_dir):
    """Customers in each of three stability subsamples, and those that any two have in common or not."""
    frame = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    drawn = with_subsamples(frame, 3, 42)
    return drawn.agg(
        F.count(F.lit(1)).alias("customers"), *[F.count_if(f"in_{r}").alias(f"drawn_{r}") for r in range(3)],
        (F.count_if(F.col("in_0") != F.col("in_1")) > 0).alias("differ"),
    )


@query
def compare_grid(spark, sf_dir):
    return compared(spark, sf_dir, ("kmeans", "gmm", "hierarchical"), (3, 4, 5)).diagnostics


@query
def stability(spark, sf_dir):
    found = compared(spark, sf_dir, ("kmeans",), (3, 4))
    return found.diagnostics.select("algorithm_key", "segments", "stability", "stability_std", "stability_successful_repeats")


@query
def compare_violations(spark, sf_dir):
    """Every candidate labels every customer once, metrics stay in range, and exactly one candidate leads."""
    found = compared(spark, sf_dir)
    d = found.diagnostics
    ranges = d.agg(
        F.count_if(~F.col("silhouette").between(-1, 1) | ~F.col("stability").between(-1, 1.000001)).alias("a"),
        F.abs(F.count_if("recommended") - 1).alias("b"),
        F.count_if(~F.col("recommendation_score").between(0, 100.000001)).alias("c"),
    ).select((F.col("a") + F.col("b") + F.col("c")).alias("n"))
    sizes = (
        found.long_labels()
        .groupBy("algorithm", "k")
        .agg(F.count("label").alias("rows"), F.count_distinct("label").alias("labels"))
        .agg(F.count_if((F.col("rows") != found.rows) | (F.col("labels") != F.col("k"))).alias("n"))
    )
    return ranges.unionByName(sizes).agg(F.sum("n").cast("long").alias("violations"))


@query
def custom_fit(spark, sf_dir):
    frame = prepared_rfm(spark, sf_dir)
    fit = fit_candidate(frame, "hierarchical", 7, settings=SETTINGS)
    return fit.label(frame.select("id", "features"), "label").groupBy("label").agg(F.count(F.lit(1)).alias("customers"))


@query
def icicle(spark, sf_dir):
    return WardHierarchy(prepared_rfm(spark, sf_dir), 42, SETTINGS).icicle()


@query
def top_merges(spark, sf_dir):
    return WardHierarchy(prepared_rfm(spark, sf_dir), 42, SETTINGS).top_merges()


@query
def nation_merges(spark, sf_dir):
    """All merges of the nations' hierarchy."""
    found = WardHierarchy(nation_prepared(spark, sf_dir), 42, SETTINGS).top_merges()
    return found.withColumn("height", r6("height"))


@query
def nation_icicle(spark, sf_dir):
    found = WardHierarchy(nation_prepared(spark, sf_dir), 42, SETTINGS).icicle()
    return found.withColumn("share_%", r6("share_%"))


@query
def nation_segments(spark, sf_dir):
    """Four segments of nations by the hierarchy, named by size, with each nation's confidence."""
    found = fit_solution(nation_prepared(spark, sf_dir), "hierarchical", 4, settings=SETTINGS).assignments
    return found.select(F.col("id").cast("long").alias("id"), "segment", r6("confidence").alias("confidence"))


@query
def kmeans_line(spark, sf_dir):
    """Three K-means segments of customers along one basis: the partition of least cost, and what it costs."""
    base = customer_base(spark, sf_dir)
    model = P.prepare_features(base, P.PreprocessConfig(("average_order_value",)))
    frame = model.attach(base.select(F.col("customer_id").alias("id"), F.struct("average_order_value").alias("source")), "source").drop("source")
    rows = written(fit_solution(frame, "kmeans", 3, settings=FitSettings(shift_tolerance=0.0)).assignments.select("id", "segment").join(frame.select("id", vector_to_array("features")[0].alias("x")), "id"))
    spread = rows.groupBy("segment").agg(F.count(F.lit(1)).alias("customers"), r6(F.min("x")).alias("low"), r6(F.max("x")).alias("high"), r6(F.var_pop("x") * F.count(F.lit(1))).alias("cost"))
    return spread


@query
def icicle_violations(spark, sf_dir):
    """Children add up to their parent and the root holds every customer."""
    frame = prepared_rfm(spark, sf_dir)
    nodes = WardHierarchy(frame, 42, SETTINGS).icicle()
    children = nodes.filter("parent <> ''").groupBy(F.col("parent").alias("id")).agg(F.sum("customers").alias("below"))
    unequal = nodes.join(children, "id").agg(F.count_if(F.col("customers") != F.col("below")).alias("n"))
    total = frame.agg(F.count(F.lit(1)).alias("all"))
    root = nodes.filter("parent = ''").select((F.abs(F.col("customers") - total.scalar())).alias("n"))
    return unequal.unionByName(root).agg(F.sum("n").cast("long").alias("violations"))
