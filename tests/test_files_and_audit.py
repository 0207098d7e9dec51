import json

import pytest
from pyspark.sql import functions as F

from clientele.errors import DataProblem
from clientele.functions.names import unique_headers, unique_table_names
from clientele.operators import audit as A
from clientele.sinks import exports as E
from clientele.sources.files import detect_delimiter, load_data


def names(frame):
    return [row["column"] for row in frame.orderBy("ordinal").collect()]


def put(folder, name, text):
    path = folder / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_types_delimiters_and_headers(spark, tmp_path):
    text = "customer_id; spend ;spend;flag;note;empty\nA;1,5;2;True;=1+1;\nB;2;NA;False;\"x;y\";\n"
    table = load_data(spark, put(tmp_path, "t.csv", text)).tables["customers"]
    assert table.columns == ["customer_id", "spend", "spend__2", "flag", "note", "empty"]
    assert dict(table.dtypes)["spend__2"] == "bigint" and dict(table.dtypes)["flag"] == "boolean"
    assert dict(table.dtypes)["spend"] == "string" and dict(table.dtypes)["empty"] == "double"
    rows = table.orderBy("customer_id").collect()
    assert rows[1]["note"] == "x;y" and rows[1]["spend__2"] is None
    assert detect_delimiter(["a\tb", "1\t2,3"]) == "\t"


def test_csv_line_breaks_surplus_cells_and_schema(spark, tmp_path):
    broken = 'id,note\n1,"two\nlines, ""quoted"""\n2,NA\n3\n'
    rows = load_data(spark, put(tmp_path, "b.csv", broken)).tables["customers"].orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, 'two\nlines, "quoted"'), (2, None), (3, None)]
    with pytest.raises(DataProblem, match="more cells"):
        load_data(spark, put(tmp_path, "w.csv", "a,b\n1,2\n3,4,5\n"))
    typed = load_data(spark, put(tmp_path, "s.csv", "a,b\n1,NA\nx, 2 \n"), "a int, b double").tables["customers"]
    assert [tuple(r) for r in typed.collect()] == [(1, None), (None, 2.0)]
    with pytest.raises(Exception, match="more cells"):
        load_data(spark, put(tmp_path, "v.csv", "a,b\n1,2,3\n"), "a int, b double").tables["customers"].collect()
    frame = spark.createDataFrame([(1, "a\nb"), (2, "c")], "id long, note string")
    E.write_csv(frame, str(tmp_path / "own.csv"))
    assert sorted(tuple(r) for r in load_data(spark, str(tmp_path / "own.csv")).tables["customers"].collect()) == [(1, "a\nb"), (2, "c")]


def test_whole_numbers_of_nineteen_digits_keep_every_digit(spark, tmp_path):
    ids = [9223372036854775807, -9223372036854775808, 1000000000000000001, 7]
    frame = spark.createDataFrame([(i,) for i in ids], "id long")
    E.write_csv(frame, str(tmp_path / "ids.csv"))
    back = load_data(spark, str(tmp_path / "ids.csv")).tables["customers"]
    assert dict(back.dtypes)["id"] == "bigint" and sorted(r["id"] for r in back.collect()) == sorted(ids)
    beyond = load_data(spark, put(tmp_path, "beyond.csv", "id\n9223372036854775808\n1\n")).tables["customers"]
    assert dict(beyond.dtypes)["id"] == "double" and beyond.count() == 2


def test_json_key_order_and_single_records(spark, tmp_path):
    keys = [f"k{i}" for i in reversed(range(40))]
    long = json.dumps([{k: 1 for k in keys}] * 2, indent=1)
    assert load_data(spark, put(tmp_path, "o.json", long)).tables["customers"].columns == keys
    one = load_data(spark, put(tmp_path, "one.jsonl", '{"b": 1, "a": "x"}\n')).tables["customers"]
    assert one.columns == ["b", "a"] and [tuple(r) for r in one.collect()] == [(1, "x")]
    pretty = load_data(spark, put(tmp_path, "p.json", '{\n "b": 1,\n "a": null\n}')).tables["customers"]
    assert pretty.columns == ["b", "a"] and pretty.count() == 1


def test_headers_and_table_names():
    assert unique_headers(["a", " a", "a__2", "", None]) == ["a", "a__2", "a__2__2", "column_4", "column_5"]
    assert unique_table_names(["a/b", "a:b", "", "x" * 40, "x" * 40]) == ["a-b", "a-b_2", "Results", "x" * 31, "x" * 29 + "_2"]


def test_json_shapes(spark, tmp_path):
    records = load_data(spark, put(tmp_path, "r.json", '[{"spend": 1, "id": "A"},\n {"spend": 2, "id": "B"}]')).tables["customers"]
    assert records.columns == ["spend", "id"] and records.count() == 2
    columns = load_data(spark, put(tmp_path, "c.json", '\ufeff{"customer_id":["A","B"],"spend":[1,2]}')).tables["customers"]
    assert [tuple(r) for r in columns.collect()] == [("A", 1), ("B", 2)]
    named = load_data(spark, put(tmp_path, "n.json", '{"people": [{"id": 1}], "none": [], "log": [{"x": 1}, {"x": 2}]}')).tables
    assert sorted(named) == ["log", "people"] and named["log"].count() == 2
    keyed = load_data(spark, put(tmp_path, "k.json", '{"a": {"0": 1, "1": 2}, "b": {"0": "x", "1": "y"}}')).tables["customers"]
    assert sorted(tuple(r) for r in keyed.collect()) == [(1, "x"), (2, "y")]
    lines = load_data(spark, put(tmp_path, "l.jsonl", '{"b": 1, "a": 2}\n{"b": 3, "a": 4}\n')).tables["customers"]
    assert lines.columns == ["b", "a"] and lines.count() == 2
    with pytest.raises(DataProblem, match="length"):
        load_data(spark, put(tmp_path, "bad.json", '{"a": [1], "b": [1, 2]}'))
    with pytest.raises(DataProblem, match="empty"):
        load_data(spark, put(tmp_path, "e.json", ""))
    with pytest.raises(DataProblem, match="no usable"):
        load_data(spark, put(tmp_path, "none.json", '{"a": []}'))


def test_folders_and_refusals(spark, tmp_path):
    folder = tmp_path / "pack"
    folder.mkdir()
    put(folder, "customers.csv", "id,x\n1,2\n")
    put(folder, "log.json", '[{"id": 1}]')
    spark.range(3).write.parquet(str(folder / "more.parquet"))
    found = load_data(spark, str(folder)).tables
    assert {name: table.count() for name, table in found.items()} == {"customers": 1, "log": 1, "more": 3}
    with pytest.raises(DataProblem, match="Supported"):
        load_data(spark, str(tmp_path / "a.docx"))
    with pytest.raises(DataProblem, match="empty"):
        load_data(spark, put(tmp_path, "e.csv", "\n"))


def test_spreadsheet_strings(spark):
    frame = spark.createDataFrame([(" =2+2", -2, "A\x00B"), ("\t+cmd", 3, "-x"), ("ordinary", 4, None)], "`@sum` string, `-run` int, safe string")
    safe = E.safe_for_spreadsheet(frame)
    assert safe.columns == ["'@sum", "'-run", "safe"]
    assert [tuple(r) for r in safe.collect()] == [("' =2+2", -2, "AB"), ("'\t+cmd", 3, "'-x"), ("ordinary", 4, None)]


def test_result_packs(spark, tmp_path):
    frame = spark.createDataFrame([(1, float("nan"), None), (2, 1.5, "=x")], "id int, v double, s string")
    written = E.write_results({"A/B": frame, "A:B": frame}, str(tmp_path / "pack"))
    assert written["A:B"].endswith("A-B_2")
    back = spark.read.csv(written["A/B"], header=True)
    assert {r["s"] for r in back.collect()} == {None, "'=x"}
    E.write_json({"rows": frame}, str(tmp_path / "json"), {"seed": 42})
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "json" / "rows")).collect()]
    assert {"id": 1, "v": None, "s": None} in lines
    assert spark.read.text(str(tmp_path / "json" / "analysis_metadata")).first()["value"] == '{"seed": 42}'
    manifest = {r["field"]: r["value"] for r in E.analysis_manifest(spark, {"k": 4, "bases": ["b", "a"]}).collect()}
    assert manifest == {"k": "4", "bases": '["b", "a"]'}


def test_fingerprint_ignores_order_and_sees_changes(spark):
    frame = spark.createDataFrame([(i, float(i)) for i in range(50)], "id int, v double")
    first = E.dataset_fingerprint(frame, ["id", "v"]).first()
    again = E.dataset_fingerprint(frame.repartition(5).orderBy(F.desc("v")), ["id", "v"]).first()
    changed = E.dataset_fingerprint(frame.withColumn("v", F.when(F.col("id") == 7, None).otherwise(F.col("v"))), ["id", "v"]).first()
    assert first == again and first["customers"] == 50 and first["fingerprint"] != changed["fingerprint"]


def test_profile_flags(spark):
    rows = [(f"C{i}", f"u{i}@x.org", f"u{i}@x.org" if i % 4 else "none", 20 + i % 5, "N" if i % 2 else None, float("nan") if i == 0 else float(i), "2026-01-01", 1)
            for i in range(40)]
    frame = spark.createDataFrame(rows, "client string, email_address string, contact string, age int, region string, annual_spend double, signup_date string, same int")
    profile = A.column_profile(frame).cache()
    report = {r["column"]: r for r in A.data_quality_report(frame, profile).collect()}
    assert report["email_address"]["privacy_note"] == report["contact"]["privacy_note"] == "email"
    assert report["region"]["missing_%"] == 50.0 and report["annual_spend"]["missing_%"] == 2.5
    assert report["same"]["constant"] and report["client"]["likely_id"] and not report["annual_spend"]["likely_id"]
    assert names(A.default_basis_columns(profile, "client")) == ["annual_spend"]
    assert names(A.usable_basis_columns(profile, "client")) == ["age", "annual_spend"]
    assert names(A.suggest_basis_columns(profile, "client", "profile")) == ["age"]
    assert names(A.suggest_basis_columns(profile, "client", "manual")) == []
    assert A.starting_bases(profile, "client") == ["age", "annual_spend"]
    descriptors = {r["column"]: r["suggested"] for r in A.descriptor_columns(profile, "client", ["annual_spend"]).collect()}
    assert descriptors["age"] and not descriptors["same"] and "contact" not in descriptors
    roles = A.transaction_roles(profile).first()
    assert (roles["customer"], roles["purchase_date"], roles["amount"], roles["order_id"]) == ("client", "signup_date", "age", None)
    near = {r["column"]: r["unique"] for r in A.column_profile(frame, approximate=True).collect()}
    assert near["age"] == 5 and abs(near["client"] - 40) <= 2


def test_recipes_match_the_documented_choices(spark):
    rows = [(f"C{i}", 20 + i, ["low", "high"][i % 2], "NESW"[i % 4], f"u{i}@x.org") for i in range(40)]
    profile = A.column_profile(spark.createDataFrame(rows, "customer_id string, age int, income_band string, region string, email string"))
    assert names(A.suggest_basis_columns(profile, "customer_id", "profile")) == ["age", "income_band", "region"]
    familiar = spark.createDataFrame([(i, i % 3, i % 7, i) for i in range(40)], "customer_id int, annual_spend int, recency_days int, loyalty int")
    assert A.starting_bases(A.column_profile(familiar), "customer_id") == ["recency_days", "annual_spend"]


def test_contract(spark):
    frame = spark.createDataFrame([(f"C{i}", float(i), 1.0) for i in range(40)], "id string, x double, same double")
    A.validate_customer_table(frame, "id", ["x"])
    for change, bases, message in (
        (lambda f: f.union(f.limit(1)), ["x"], "repeats on 2 rows"),
        (lambda f: f.withColumn("id", F.when(F.col("x") == 3, " ").otherwise(F.col("id"))), ["x"], "blank"),
        (lambda f: f.limit(20), ["x"], "30 customers"),
        (lambda f: f, [], "No segmentation basis"),
        (lambda f: f, ["y"], "not found"),
        (lambda f: f, ["same"], "varies"),
    ):
        with pytest.raises(DataProblem, match=message):
            A.validate_customer_table(change(frame), "id", bases)
    with pytest.raises(DataProblem, match="more than 10"):
        A.validate_customer_table(frame, "id", ["x"], max_customers=10)


def test_overview_and_correlation(spark):
    frame = spark.createDataFrame([(1, 2.0, 1.0), (1, 2.0, 1.0), (2, 4.1, 1.0), (3, None, 1.0)], "a int, b double, c double")
    assert tuple(A.table_overview(frame).first()) == (4, 3, 1, 1)
    pairs = A.correlated_pairs(frame, ["a", "b", "c"]).collect()
    assert [(p["left"], p["right"]) for p in pairs] == [("a", "b")]
    assert names(A.binary_numeric_columns(A.column_profile(frame), ["a", "b", "c"])) == ["b", "c"]


@pytest.mark.parametrize("end,few", [("\n", True), ("\r\n", True), ("\n", False)])
def test_quoted_line_breaks_are_read_by_many_tasks(spark, tmp_path, end, few):
    import csv
    import random

    from clientele.sources.files import read_csv
    from clientele.sources.records import Quotes, file_records, numbered_lines

    rng = random.Random(5)
    pieces = ["a", '"', ",", "\n", "é", '" ', "\n\n", " "]
    rows = [[str(i), "".join(rng.choice(pieces) for _ in range(rng.choice([0, 3, 30, 400]))) or "z", str(2 * i)] for i in range(800)]
    path = str(tmp_path / "notes.csv")
    with open(path, "w", newline="") as file:
        csv.writer(file, lineterminator=end).writerows([["id", "note, \n here", "x"], *rows])
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert numbered_lines(spark, path, "\n").select("__start").distinct().count() > 40
        found = file_records(spark, path, ",", most_broadcast=1000 if few else 0)
        assert found.count() == 801 and found.filter("first").count() == 1
        table = read_csv(spark, path)
        assert len(table.columns) == 3 and table.columns[0] == "id"
        got = sorted(tuple(r) for r in table.collect())
        one = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True).collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert got == [(int(a), b, int(c)) for a, b, c in rows]
    assert [(str(a), b, str(c)) for a, b, c in got] == sorted(((r[0], r[1], r[2].rstrip("\r")) for r in one), key=lambda r: int(r[0]))
    quotes = Quotes(",")
    assert [quotes.open_after(t, False) for t in ('a,"b', 'a"b', '"a""', '"a"x"', '"a",  "b', "a")] == [True, False, True, False, True, False]
    assert quotes.open_after("a", True) and not quotes.open_after('b",c', True) and quotes.open_after('b","c', True)


def test_a_document_of_one_line_is_read_by_many_tasks(spark, tmp_path):
    import json
    import random

    from clientele.sources.files import read_json
    from clientele.sources.structure import RECORD_END, list_records, object_keys, structured_pieces

    rng = random.Random(7)
    text = lambda: "".join(rng.choice(["a", "}", "{", "[", "]", ",", '"', "\\", "é", "\n", ":"]) for _ in range(rng.choice([0, 2, 60])))
    rows = [{"zeta": i, "alpha": text(), "mid": {"x": [1, 2], "y": text()}} for i in range(1500)]
    (tmp_path / "list.json").write_text(json.dumps(rows, ensure_ascii=False))
    (tmp_path / "pretty.json").write_text("﻿" + json.dumps(rows[:300], indent=2))
    (tmp_path / "columns.json").write_text(json.dumps({"zeta": [r["zeta"] for r in rows], 'a "quoted", key': [r["alpha"] for r in rows], "mid": [1] * len(rows)}))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3k")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert structured_pieces(spark, str(tmp_path / "list.json"), RECORD_END).select("__start").distinct().count() > 20
        found = list_records(spark, str(tmp_path / "list.json")).orderBy("path", "start", "ordinal").collect()
        assert [json.loads(r["record"]) for r in found] == rows
        for name, n in (("list", 1500), ("pretty", 300)):
            table = read_json(spark, str(tmp_path / f"{name}.json"))["customers"]
            assert table.columns == ["zeta", "alpha", "mid"] and table.count() == n
            assert {(r["zeta"], r["alpha"], r["mid"]["y"]) for r in table.collect()} == {(r["zeta"], r["alpha"], r["mid"]["y"]) for r in rows[:n]}
        assert object_keys(spark, str(tmp_path / "columns.json")) == ["zeta", 'a "quoted", key', "mid"]
        columns = read_json(spark, str(tmp_path / "columns.json"))["customers"]
        assert columns.columns[0] == "zeta" and columns.columns[2] == "mid" and columns.count() == 1500
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    for k, broken in enumerate(['[{"a": 1}, {"a": ', '[{"a": 1} x]', '[{"a": 1}, 5]', "[1, 2"]):
        (tmp_path / f"broken{k}.json").write_text(broken)
        with pytest.raises(DataProblem):
            read_json(spark, str(tmp_path / f"broken{k}.json"))["customers"].collect()
