import pytest

duckdb = pytest.importorskip("duckdb")

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from tools.check_oracles import TABLES, canonical  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
COMPARED = [
    "rfm_count_rows", "rfm_order_rollup", "quality_report", "suggested_bases", "high_corr_pairs", "prep_steps",
    "prep_matrix", "silhouette_euclid", "ari_pairs", "confidence_centroid", "numeric_profile", "categorical_profile",
    "segment_cards", "box_stats", "csv_round_trip",
]


@pytest.fixture(scope="module")
def engine():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", COMPARED)
def test_query_matches_sql(spark, engine, name):
    frame = queries()[name](spark, FOLDER)
    cursor = engine.execute(oracle_sql()[name])
    expected = canonical(cursor.fetchall(), [d[0] for d in cursor.description])
    assert canonical([tuple(r) for r in frame.collect()], frame.columns) == expected
    # Plans must not pair every row with every row.
    plan = frame._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    spark.catalog.clearCache()


def test_entry_and_registration(spark):
    assert entry(spark).count() > 0
    assert set(oracle_sql()) <= set(queries())


def test_hot_customer_is_rolled_up_like_any_other(spark):
    from pyspark.sql import functions as F

    from clientele.operators.rfm import build_rfm

    # One customer owns a third of the log; orders span several lines.
    log = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 500 + 1).alias("c"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).alias("t"),
        (F.col("id") % 97).cast("double").alias("a"),
        (F.col("id") / 4).cast("long").alias("o"),
    )
    rolled = build_rfm(log, "c", "t", "a", "o")
    hot = rolled.filter("customer_id = 0").first()
    rows = log.filter("c = 0").agg(F.sum("a").alias("a"), F.count_distinct("o").alias("o")).first()
    assert hot["monetary_value"] == rows["a"] and hot["frequency"] == rows["o"]
    lazy = build_rfm(log, "c", "t", "a", "o", "2030-01-01", check=False)
    plan = lazy._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_sum") == 2
    # Whatever else is asked for, the written roll-up is read, not the log.
    assert "Range" not in rolled._jdf.queryExecution().executedPlan().toString()


def test_column_oriented_object_holds_every_supplier(spark, tmp_path):
    from pyspark.sql import functions as F

    spark.range(700).select(F.col("id").alias("s_suppkey"), F.concat(F.lit("Supplier "), F.col("id")).alias("s_name")).write.parquet(f"{tmp_path}/supplier.parquet")
    rows = queries()["json_columns"](spark, str(tmp_path)).collect()
    assert sorted((r["key"], r["name"]) for r in rows) == [(i, f"Supplier {i}") for i in range(700)]
