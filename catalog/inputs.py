"""Tables the registered queries start from, each with the same definition in SQL.

``customer_base`` is a customer table derived from the star schema: roll-up features of ``orders``, attributes of
``customer``, and columns that are missing or unreadable for some customers by nature of the data (no urgent order, no
event, an overdrawn balance).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clientele.operators.prepare import PreprocessConfig, prepare_features
from clientele.operators.rfm import build_rfm

DAY = "86400000000"
RFM_BASES = ("recency_days", "frequency", "monetary_value")
MATRIX_NUMERIC = ("recency_days", "frequency", "monetary_value", "urgent_value", "balance_text")
MATRIX_CATEGORICAL = ("nation", "urgent_status", "active")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(column: Column | str) -> Column:
    """Six decimals without negative zero, the precision at which both engines agree."""
    return F.round(column, 6) + F.lit(0.0)


def order_rfm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_rfm(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_totalprice", check=False)


def customer_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    urgent = (
        orders.filter("o_orderpriority = '1-URGENT'")
        .groupBy(F.col("o_custkey").alias("customer_id"))
        .agg(F.avg("o_totalprice").alias("urgent_value"), F.max("o_orderstatus").alias("urgent_status"))
    )
    visits = (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("customer_id"))
        .agg(F.avg("value").alias("event_value"))
    )
    customer = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"),
        F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("nation"),
        F.col("c_mktsegment").alias("market"),
        F.when(F.col("c_acctbal") < 0, "overdrawn").otherwise(F.col("c_acctbal").cast("string")).alias("balance_text"),
    )
    return (
        order_rfm(spark, sf_dir)
        .join(customer, "customer_id")
        .join(urgent, "customer_id", "left")
        .join(visits, "customer_id", "left")
        .withColumn("active", F.col("recency_days") < 120)
        .withColumn(
            "band", F.when(F.col("frequency") < 8, "few").when(F.col("frequency") < 13, "some").otherwise("many")
        )
    )


def audit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer table with names that exercise every role rule."""
    base = customer_base(spark, sf_dir)
    handle = F.concat(F.lit("c"), F.col("customer_id").cast("string"))
    return base.select(
        "customer_id",
        handle.alias("account code"),
        F.concat(F.lit("Customer "), F.col("customer_id").cast("string")).alias("full_name"),
        F.concat(handle, F.lit("@example.org")).alias("contact"),
        F.col("nation").alias("nationality"),
        F.col("market").alias("market_segment"),
        F.col("band").alias("purchase_band"),
        "recency_days",
        F.col("frequency").alias("order_frequency"),
        F.col("monetary_value").alias("annual_spend"),
        "average_order_value",
        F.col("urgent_value").alias("urgent_rating"),
        F.col("urgent_status").alias("last_channel"),
        F.col("balance_text").alias("balance"),
        F.col("event_value").alias("visit_score"),
        F.col("active").alias("is_active"),
        F.lit(1).alias("wave"),
        F.concat(F.lit("day "), F.col("recency_days").cast("int").cast("string")).alias("last_order_date"),
    )


def rfm_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, features, market, band, nation, active)``: prepared roll-up bases next to given labels."""
    base = customer_base(spark, sf_dir).persist()
    model = prepare_features(base, PreprocessConfig(RFM_BASES))
    return model.attach(
        base.select(
            F.col("customer_id").alias("id"),
            "market",
            "band",
            "nation",
            F.col("active").cast("string").alias("active"),
            F.struct(*RFM_BASES).alias("source"),
        ),
        "source",
    ).drop("source")


NATION_BASES = ("balance", "customers", "order_value")


def nation_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, features)``: nations by what their customers hold and order."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg("o_totalprice").alias("price"))
    nations = (
        table(spark, sf_dir, "customer").join(orders, "c_custkey", "left").groupBy(F.col("c_nationkey").alias("customer_id"))
        .agg(F.avg("c_acctbal").alias("balance"), F.count(F.lit(1)).alias("customers"), F.avg("price").alias("order_value"))
    )
    model = prepare_features(nations, PreprocessConfig(NATION_BASES))
    return model.attach(nations.select(F.col("customer_id").alias("id"), F.struct(*NATION_BASES).alias("source")), "source").drop("source")


def matrix_config() -> PreprocessConfig:
    return PreprocessConfig(MATRIX_NUMERIC, MATRIX_CATEGORICAL, categorical_weight=0.5)


# ------------------------------------------------------------------------------------------------------------- in SQL

RFM_CTE = f"""
log AS (SELECT o_custkey AS customer_id, epoch_us(o_orderdate) AS micros, o_totalprice AS amount FROM orders
        WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL),
rfm AS (SELECT customer_id,
               round_even(((SELECT max(micros) FROM log) + {DAY} - max(micros)) / {DAY}.0, 2) AS recency_days,
               count(*) AS frequency, sum(amount) AS monetary_value, avg(amount) AS average_order_value,
               round_even((max(micros) - min(micros)) / {DAY}.0, 2) AS customer_tenure_days
        FROM log GROUP BY customer_id)"""

BASE_CTE = (
    RFM_CTE
    + """,
urgent AS (SELECT o_custkey AS customer_id, avg(o_totalprice) AS urgent_value, max(o_orderstatus) AS urgent_status
           FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1),
visits AS (SELECT user_id AS customer_id, avg(value) AS event_value FROM events GROUP BY 1),
base AS (SELECT rfm.*, 'N' || CAST(c_nationkey AS VARCHAR) AS nation, c_mktsegment AS market,
                CASE WHEN c_acctbal < 0 THEN 'overdrawn' ELSE CAST(c_acctbal AS VARCHAR) END AS balance_text,
                urgent_value, urgent_status, event_value, recency_days < 120 AS active,
                CASE WHEN frequency < 8 THEN 'few' WHEN frequency < 13 THEN 'some' ELSE 'many' END AS band
         FROM rfm JOIN customer ON c_custkey = customer_id
         LEFT JOIN urgent USING (customer_id) LEFT JOIN visits USING (customer_id))"""
)

AUDIT_CTE = (
    BASE_CTE
    + """,
audit AS (SELECT customer_id, 'c' || CAST(customer_id AS VARCHAR) AS "account code",
                 'Customer ' || CAST(customer_id AS VARCHAR) AS full_name,
                 'c' || CAST(customer_id AS VARCHAR) || '@example.org' AS contact,
                 nation AS nationality, market AS market_segment, band AS purchase_band, recency_days,
                 frequency AS order_frequency, monetary_value AS annual_spend, average_order_value,
                 urgent_value AS urgent_rating, urgent_status AS last_channel, balance_text AS balance,
                 event_value AS visit_score, active AS is_active, 1 AS wave,
                 'day ' || CAST(CAST(floor(recency_days) AS INTEGER) AS VARCHAR) AS last_order_date
          FROM base)"""
)
AUDIT_COLUMNS = (
    ("customer_id", "bigint"), ("account code", "string"), ("full_name", "string"), ("contact", "string"),
    ("nationality", "string"), ("market_segment", "string"), ("purchase_band", "string"), ("recency_days", "double"),
    ("order_frequency", "bigint"), ("annual_spend", "double"), ("average_order_value", "double"),
    ("urgent_rating", "double"), ("last_channel", "string"), ("balance", "string"), ("visit_score", "double"),
    ("is_active", "boolean"), ("wave", "int"), ("last_order_date", "string"),
)

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def numeric_steps(columns: dict[str, str], source: str = "base", standardize: bool = True) -> str:
    """CTEs ``imputed``, ``steps`` and ``scaled`` for numeric columns given as name → SQL value (null when missing)."""
    parts = ["raw AS (SELECT customer_id, " + ", ".join(f"{sql} AS {name}" for name, sql in columns.items()) + f" FROM {source})"]
    medians = ", ".join(f"coalesce({n}, (SELECT median({n}) FROM raw), 0) AS {n}" for n in columns)
    parts.append(f"imputed AS (SELECT customer_id, {medians} FROM raw)")
    clipped = ", ".join(
        f"greatest(least({n}, (SELECT quantile_cont({n}, 0.99) FROM imputed)), (SELECT quantile_cont({n}, 0.01) FROM imputed)) AS {n}"
        for n in columns
    )
    parts.append(f"clipped AS (SELECT customer_id, {clipped} FROM imputed)")
    tests = ", ".join(f"min({n}) >= 0 AND coalesce(skewness({n}), 0) > 1 AS {n}" for n in columns)
    parts.append(f"logs AS (SELECT {tests} FROM clipped)")
    logged = ", ".join(f"CASE WHEN (SELECT {n} FROM logs) THEN ln(1 + {n}) ELSE {n} END AS {n}" for n in columns)
    parts.append(f"logged AS (SELECT customer_id, {logged} FROM clipped)")
    scaled = ", ".join(
        f"({n} - (SELECT avg({n}) FROM logged)) / "
        f"(SELECT CASE WHEN max({n}) = min({n}) THEN 1 ELSE stddev_pop({n}) END FROM logged) AS {n}"
        for n in columns
    )
    parts.append(f"scaled AS (SELECT customer_id, {scaled} FROM logged)")
    return ",\n".join(parts)


RFM_VALUES = {name: f"CAST({name} AS DOUBLE)" for name in RFM_BASES}
MATRIX_VALUES = {
    **{name: f"CAST({name} AS DOUBLE)" for name in MATRIX_NUMERIC[:-1]},
    "balance_text": f"CASE WHEN regexp_matches(balance_text, '{NUMBER}') THEN CAST(balance_text AS DOUBLE) END",
}
PREPARED_CTE = (
    BASE_CTE
    + ",\n"
    + numeric_steps(RFM_VALUES)
    + """,
prepared AS (SELECT customer_id AS id, s.recency_days AS f0, s.frequency AS f1, s.monetary_value AS f2,
                    b.market, b.band, b.nation, CAST(b.active AS VARCHAR) AS active
             FROM scaled s JOIN base b USING (customer_id))"""
)

NATION_CTE = (
    """paid AS (SELECT o_custkey AS c_custkey, avg(o_totalprice) AS price FROM orders GROUP BY 1),
nations AS (SELECT c_nationkey AS customer_id, avg(c_acctbal) AS balance, count(*) AS customers, avg(price) AS order_value
            FROM customer LEFT JOIN paid USING (c_custkey) GROUP BY 1),
"""
    + numeric_steps({name: f"CAST({name} AS DOUBLE)" for name in NATION_BASES}, "nations")
    + """,
places AS (SELECT customer_id AS id, balance AS f0, customers AS f1, order_value AS f2 FROM scaled)"""
)
