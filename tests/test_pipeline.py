import numpy as np
import pytest
from pyspark.sql import functions as F

from clientele.operators.fits import FitSettings
from clientele.operators.rfm import build_rfm, rfm_bases
from clientele.plans.compare import compare_solutions, ready
from clientele.plans.pipeline import segment_customers
from clientele.sinks.exports import write_results

QUICK = FitSettings(gmm_starts=1)
BASES = [
    "recency_days", "purchase_frequency", "annual_spend", "engagement_score", "discount_share", "return_rate",
    "satisfaction_score",
]


@pytest.fixture(scope="module")
def behaviour(spark):
    """Four planted groups over seven behaviour columns, with gaps, plus descriptors."""
    rng = np.random.default_rng(42)
    centres = [
        (18, 15, 1050, 8.0, 0.18, 0.08, 8.5), (55, 6, 380, 7.2, 0.72, 0.14, 7.1),
        (235, 2, 125, 1.8, 0.32, 0.10, 5.8), (72, 3, 1280, 4.2, 0.09, 0.05, 8.0),
    ]
    spreads = [
        (13, 3, 260, 1.2, 0.12, 0.06, 0.8), (25, 2, 135, 1.5, 0.14, 0.08, 0.8),
        (75, 1, 65, 0.9, 0.14, 0.07, 0.8), (35, 1, 340, 1.2, 0.09, 0.05, 0.8),
    ]
    rows = []
    for group, (size, centre, spread) in enumerate(zip((180, 150, 150, 120), centres, spreads)):
        for values in rng.normal(centre, spread, (size, 7)):
            rows.append([float(max(v, 0)) for v in values] + [float(rng.integers(18, 78)), str(rng.choice(["North", "South"])), group])
    for i in rng.choice(600, 18, replace=False):
        rows[i][3] = None
    for i in rng.choice(600, 12, replace=False):
        rows[i][8] = None
    named = [(f"C{i:05d}", *row) for i, row in enumerate(rows)]
    columns = ", ".join(f"{name} double" for name in BASES)
    return spark.createDataFrame(named, f"customer_id string, {columns}, age double, region string, demo_truth int")


def test_behaviour_groups_are_recovered_and_exported(spark, behaviour, tmp_path):
    found = segment_customers(
        behaviour, "customer_id", BASES, ["age", "region"], algorithms=("kmeans", "hierarchical"), k_values=(3, 4),
        stability_repeats=4, settings=QUICK, purpose="test",
    )
    top = found.comparison.diagnostics.first()
    assert top["segments"] == 4 and top["quality"] in {"Strong", "Promising"} and top["recommended"]
    labelled = found.labelled().join(behaviour.select("customer_id", "demo_truth"), "customer_id")
    cells = labelled.groupBy("demo_truth", "__segment").count().collect()
    assert sum(max(c["count"] for c in cells if c["demo_truth"] == g) for g in range(4)) > 575
    assert found.segment_map().count() == 600
    assert {r["role"] for r in found.profile.numeric.select("role").distinct().collect()} == {"basis", "descriptor"}
    assert found.profile.categorical.filter("level = 'Missing'").count() == 4
    assert min(len(r["suggested_name"]) for r in found.profile.cards.collect()) > 2
    tables = found.result_tables()
    assert len(tables) == 8 and len(write_results(tables, str(tmp_path / "pack"))) == 8
    manifest = {r["field"]: r["value"] for r in found.manifest().collect()}
    assert manifest["customer_rows"] == "600" and len(manifest["dataset_fingerprint_sha256"]) == 64


def test_custom_fit_outside_the_grid(spark, behaviour):
    found = segment_customers(
        behaviour, "customer_id", BASES[:3] + ["region"], algorithms=("kmeans",), k_values=(3,), stability_repeats=2,
        settings=QUICK, choose=("hierarchical", 5),
    )
    assert found.solution.k == 5 and "Custom fit" in found.solution.note
    assert found.segment_map().select("segment").distinct().count() == 5
    assert found.result_tables()["Chosen diagnostics"].first()["note"].startswith("Custom")


def test_log_to_segments(spark):
    rng = np.random.default_rng(7)
    rows = []
    for customer in range(240):
        busy = customer % 3
        for order in range(2 + 6 * busy):
            day = int(rng.integers(0, 60) if busy else rng.integers(200, 360))
            rows.append((f"C{customer}", f"O{customer}-{order}", day, float(rng.gamma(4, 20 + 30 * busy))))
    log = spark.createDataFrame(rows, "customer_id string, order_id string, day int, order_value double").withColumn(
        "order_date", F.date_sub(F.lit("2026-06-30").cast("date"), F.col("day")).cast("string")
    )
    rfm = build_rfm(log, "customer_id", "order_date", "order_value", "order_id")
    bases, notes = rfm_bases()
    assert not notes
    found = segment_customers(rfm, "customer_id", bases, algorithms=("kmeans",), k_values=(3,), stability_repeats=4, settings=QUICK)
    assert found.comparison.diagnostics.first()["stability"] > 0.8
    assert found.segment_map().count() == 240
