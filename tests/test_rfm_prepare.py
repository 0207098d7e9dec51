from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from clientele.errors import DataProblem
from clientele.operators.prepare import PreprocessConfig, infer_feature_types, prepare_features
from clientele.operators.rfm import build_rfm, rfm_bases


def features(model, frame, id_column="id"):
    rows = model.transform(frame, id_column).orderBy("id").collect()
    return np.array([list(row)[1:] for row in rows], dtype=float)


def with_id(spark, values, schema):
    return spark.createDataFrame([(i, *row) for i, row in enumerate(values)], "id long, " + schema)


LOG = [("A", 1, "2026-01-01", 10.0), ("A", 1, "2026-01-01", 5.0), ("A", 2, "2026-01-10", 20.0), ("B", 3, "2026-01-05", 8.0)]


@pytest.mark.parametrize("check", [True, False])
def test_rfm_rolls_lines_up_to_orders(spark, check):
    log = spark.createDataFrame(LOG, "cid string, order long, date string, amount double")
    got = {r["customer_id"]: r for r in build_rfm(log, "cid", "date", "amount", "order", "2026-01-11", check=check).collect()}
    a = got["A"]
    assert (a["recency_days"], a["frequency"], a["monetary_value"]) == (1.0, 2, 35.0)
    assert (a["average_order_value"], a["customer_tenure_days"]) == (17.5, 9.0)


@pytest.mark.parametrize("check", [True, False])
def test_rfm_default_reference_is_one_day_after_the_last_row(spark, check):
    log = spark.createDataFrame(LOG, "cid string, order long, date string, amount double")
    got = {r["customer_id"]: r for r in build_rfm(log, "cid", "date", "amount", check=check).collect()}
    assert got["A"]["recency_days"] == 1.0 and got["A"]["frequency"] == 3
    assert got["B"]["recency_days"] == 6.0


def test_rfm_drops_unreadable_rows_and_keeps_refunds(spark):
    log = spark.createDataFrame(
        [("1", "2026-01-01", "10"), ("x", "not a date", "5"), (None, "2026-01-02", "7"), ("1", "2026-01-03", "-4"), ("1", "2026-01-03", "inf")],
        "cid string, date string, amount string",
    )
    (row,) = build_rfm(log, "cid", "date", "amount").collect()
    assert (row["customer_id"], row["frequency"], row["monetary_value"], row["customer_tenure_days"]) == ("1", 2, 6.0, 2.0)


def test_rfm_detects_date_layouts(spark):
    def rolled(*dates):
        log = spark.createDataFrame([(f"c{i}", d, 1.0) for i, d in enumerate(dates)], "c string, d string, a double")
        return {r["customer_id"]: r["recency_days"] for r in build_rfm(log, "c", "d", "a", reference_date="2026-02-01").collect()}

    assert rolled("01/13/2026", "2026-01-05", "2026/01/09", "01/02/2026") == {"c0": 19.0, "c1": 27.0, "c2": 23.0, "c3": 30.0}
    assert rolled("13/01/2026", "02/01/2026", "3.1.2026") == {"c0": 19.0, "c1": 30.0, "c2": 29.0}
    assert rolled("01/01/2026", "soon") == {"c0": 31.0}
    for ambiguous in (["01/02/2026"], ["01/13/2026", "13/01/2026"]):
        with pytest.raises(DataProblem, match="date_formats"):
            rolled(*ambiguous)


def test_rfm_refuses_bad_input(spark):
    log = spark.createDataFrame([("A", "2026-01-01", 1.0, "1"), ("B", "2026-01-02", 1.0, None)], "c string, d string, a double, o string")
    with pytest.raises(DataProblem, match="order ID contains blank"):
        build_rfm(log, "c", "d", "a", "o")
    with pytest.raises(Exception, match="order ID contains blank"):
        build_rfm(log, "c", "d", "a", "o", check=False).collect()
    with pytest.raises(DataProblem, match="before the latest"):
        build_rfm(log, "c", "d", "a", reference_date=datetime(2026, 1, 1))
    with pytest.raises(DataProblem, match="different"):
        build_rfm(log, "c", "d", "c")
    with pytest.raises(DataProblem, match="not found"):
        build_rfm(log, "c", "d", "z")
    with pytest.raises(DataProblem, match="readable"):
        build_rfm(log.withColumn("d", F.lit("soon")), "c", "d", "a")
    assert rfm_bases(["frequency", "monetary_value", "average_order_value"])[1]


def test_mixed_preparation_imputes_and_encodes(spark):
    frame = with_id(
        spark,
        [(1.0, 1, "Email"), (2.0, 2, "Store"), (None, 3, None), (1000.0, 4, "Email"), (5.0, 5, "Social"), (6.0, 6, "Email")],
        "spend double, engagement int, channel string",
    )
    model = prepare_features(frame, PreprocessConfig(("spend", "engagement"), ("channel",)))
    matrix = features(model, frame)
    assert matrix.shape[0] == 6 and matrix.shape[1] >= 4 and np.isfinite(matrix).all()
    assert model.audit["missing_values_imputed"] == 2


def test_numeric_steps_match_numpy(spark):
    rng = np.random.default_rng(8)
    values = rng.lognormal(2, 1, 400)
    gaps = rng.random(400) < 0.3
    column = [None if g else float(v) for v, g in zip(values, gaps)]
    frame = with_id(spark, [(v,) for v in column], "x double")
    for one_task_values in (100_000, 50):
        model = prepare_features(frame, PreprocessConfig(("x",)), one_task_values)
        raw = np.where(gaps, np.nan, values)
        filled = np.where(gaps, np.nanmedian(raw), raw)
        clipped = np.clip(filled, *np.quantile(filled, [0.01, 0.99]))
        assert pd.Series(clipped).skew() > 1 and model.audit["log1p_columns"] == ["x"]
        logged = np.log1p(clipped)
        expected = (logged - logged.mean()) / logged.std()
        assert np.allclose(features(model, frame)[:, 0], expected, atol=1e-9)


def test_constant_and_empty_columns_are_left_out(spark):
    frame = with_id(spark, [(1.0, None, float(i)) for i in range(40)], "same double, empty double, x double")
    model = prepare_features(frame, PreprocessConfig(("same", "empty", "x")))
    assert features(model, frame).shape == (40, 1)
    assert model.audit["dropped_constant_numeric"] == ["same", "empty"] and len(model.warnings) >= 2


def test_numeric_looking_text(spark):
    frame = with_id(spark, [(str(i),) for i in range(38)] + [("bad",), ("",)], "x string")
    assert infer_feature_types(frame, ["x"]) == (["x"], [])
    model = prepare_features(frame, PreprocessConfig(("x",)))
    assert model.audit["numeric_parse_failures"] == {"x": 2}


def test_booleans_are_categories(spark):
    frame = with_id(spark, [(i % 2 == 0,) for i in range(40)], "b boolean")
    assert infer_feature_types(frame, ["b"]) == ([], ["b"])
    assert prepare_features(frame, PreprocessConfig((), ("b",))).feature_names == ["b_False", "b_True"]


def test_only_rare_levels_is_refused(spark):
    frame = with_id(spark, [(f"level {i}",) for i in range(40)], "c string")
    with pytest.raises(DataProblem, match="no usable variation"):
        prepare_features(frame, PreprocessConfig((), ("c",)))


def test_twenty_frequent_levels_collapse_to_nineteen_and_a_rest(spark):
    levels = [f"L{i:02d}" for i in range(20) for _ in range(3 if i else 2)]
    model = prepare_features(with_id(spark, [(v,) for v in levels], "c string"), PreprocessConfig((), ("c",)))
    (step,) = model.categorical
    assert len(step.kept) == 19 and step.rest and "L00" not in step.kept
    assert model.feature_names[-1] == "c_infrequent"


def test_categorical_weight_and_raw_scale(spark):
    frame = with_id(spark, [(float(i % 5 + 1), "ab"[i % 2]) for i in range(50)], "a double, c string")
    model = prepare_features(frame, PreprocessConfig(("a",), ("c",), clip_outliers=False, standardize=False, categorical_weight=0.5))
    matrix = features(model, frame)
    assert set(matrix[:, 0]) == {1.0, 2.0, 3.0, 4.0, 5.0}
    assert set(matrix[:, 1:].ravel()) == {0.0, 0.5}
    scaled = features(prepare_features(frame, PreprocessConfig(("a",))), frame)
    assert abs(scaled.mean()) < 1e-12


def test_preparation_guards(spark):
    frame = with_id(spark, [(1.0,), (2.0,)], "x double")
    with pytest.raises(DataProblem, match="three rows"):
        prepare_features(frame, PreprocessConfig(("x",)))
    with pytest.raises(DataProblem, match="not found"):
        prepare_features(frame, PreprocessConfig(("y",)))
    with pytest.raises(DataProblem, match="No basis"):
        prepare_features(frame, PreprocessConfig(()))


def test_slices_of_a_log_add_up_to_one_roll_up(spark, tmp_path):
    from clientele.operators.rollup_state import RollupState

    rows = [("a", "2026-01-01", 10.0, "1"), ("a", "2026-01-02", 5.0, "1"), ("b", "2026-01-03", 7.0, "1"), ("a", "2026-02-01", -2.0, "2"),
            ("c", "2026-02-02", 1.0, "9"), ("b", None, 3.0, "4"), (None, "2026-02-02", 3.0, "4"), ("a", "2026-02-03", 4.0, "1")]
    log = spark.createDataFrame(rows, "who string, day string, paid double, bill string")
    columns = ("who", "day", "paid", "bill")
    state = RollupState(spark, str(tmp_path / "state"), buckets=4)
    with pytest.raises(DataProblem):
        state.rfm()
    assert state.add(log.filter("day < '2026-02-01'"), *columns) == 1
    (tmp_path / "state" / "rows-2").mkdir()  # what a failed run leaves behind
    assert state.rows().count() == 2
    assert state.add(log.filter("day >= '2026-02-01' or day is null"), *columns) == 2
    whole = sorted(map(tuple, build_rfm(log, *columns).collect()))
    assert sorted(map(tuple, state.rfm().collect())) == whole
    assert sorted(map(tuple, state.rfm("2026-03-01").collect())) == sorted(map(tuple, build_rfm(log, *columns, "2026-03-01").collect()))
    assert state.rows().agg({"lines": "sum"}).first()[0] == 6
    with pytest.raises(DataProblem):
        state.add(log.limit(0), *columns)
    with pytest.raises(Exception, match="blank"):
        state.add(spark.createDataFrame([("a", "2026-01-01", 1.0, " ")], "who string, day string, paid double, bill string"), *columns)
    assert sorted(map(tuple, state.rfm().collect())) == whole
