import numpy as np
import pytest
from pyspark.sql import functions as F

from clientele.functions.quantiles import exact_quantiles

PROBABILITIES = [0.01, 0.25, 0.5, 0.9, 0.99, 1.0]


@pytest.mark.parametrize("one_task_values", [100_000, 500])
def test_quantiles_match_numpy_with_ties_and_gaps(spark, one_task_values):
    rng = np.random.default_rng(3)
    smooth = rng.lognormal(3, 2, 40_000)
    hot = np.where(rng.random(40_000) < 0.4, 7.0, rng.normal(6, 3, 40_000))
    frame = spark.createDataFrame(
        [(float(a), float(b), None if i % 7 == 0 else float(a)) for i, (a, b) in enumerate(zip(smooth, hot))],
        "smooth double, hot double, gaps double",
    ).repartition(8)
    got = exact_quantiles(
        frame, {c: F.col(c) for c in frame.columns}, PROBABILITIES, one_task_values=one_task_values
    )
    kept = np.array([a for i, a in enumerate(smooth) if i % 7])
    for name, values in (("smooth", smooth), ("hot", hot), ("gaps", kept)):
        assert np.allclose(got[(None, name)], np.quantile(values, PROBABILITIES), rtol=1e-12), name


@pytest.mark.parametrize("one_task_values", [100_000, 300])
def test_quantiles_by_group(spark, one_task_values):
    rng = np.random.default_rng(4)
    groups = rng.choice(["a", "b", "c"], 20_000, p=[0.9, 0.0995, 0.0005])
    values = rng.normal(0, 5, 20_000).round(2)
    frame = spark.createDataFrame(list(zip(groups.tolist(), values.tolist())), "g string, v double").repartition(8)
    got = exact_quantiles(frame, {"v": F.col("v")}, PROBABILITIES, by="g", one_task_values=one_task_values)
    for group in set(groups):
        assert np.allclose(got[(group, "v")], np.quantile(values[groups == group], PROBABILITIES)), group


def test_constant_and_empty_columns(spark):
    frame = spark.range(1000).select(F.lit(4.0).alias("same"), F.lit(None).cast("double").alias("none"))
    got = exact_quantiles(frame, {c: F.col(c) for c in frame.columns}, [0.5], one_task_values=10)
    assert got == {(None, "same"): [4.0], (None, "none"): [None]}
