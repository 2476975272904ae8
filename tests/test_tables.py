import re

import pytest
from pyspark.sql import functions as F

from tabsonde import InputError
from tabsonde.functions import dates, text
from tabsonde.operators import shaping
from tabsonde.operators.shaping import sample_rows, tidy
from tabsonde.sources.tables import detect_encoding, read_table, write_result


def write(path, data):
    path.write_bytes(data)
    return str(path)


def test_semicolons_and_cp1252(spark, tmp_path):
    data = "city;temp_c;note;\nZürich;3,5;cold;\n;;;\nMontréal;-2;“snow”;\nSão Paulo;27;;\n"
    path = write(tmp_path / "a.csv", data.encode("cp1252"))
    df = read_table(spark, path)
    assert df.columns == ["city", "temp_c", "note"]
    assert [r["city"] for r in df.collect()] == ["Zürich", "Montréal", "São Paulo"]
    assert detect_encoding(spark, path) == "windows-1252"


def test_names_and_blank_columns(spark, tmp_path):
    df = read_table(spark, write(tmp_path / "b.csv", b" a , b ,empty\n1,x,\n2,y,\n"))
    assert df.columns == ["a", "b"] and dict(df.dtypes)["a"] == "int"


def test_byte_order_mark_and_tabs(spark, tmp_path):
    df = read_table(spark, write(tmp_path / "c.csv", "﻿a\tb\n1\té\n".encode()))
    assert df.columns == ["a", "b"] and df.first()["b"] == "é"


def test_quotes_and_missing_words(spark, tmp_path):
    data = (
        b'id,note,amount,day\n1,"He said ""hi, there""",3,2024-01-05\n'
        b'2,"two\nlines",NA,2024-02-01\n3,N/A,4.5,\n'
    )
    rows = read_table(spark, write(tmp_path / "q.csv", data)).orderBy("id").collect()
    assert [r["note"] for r in rows] == ['He said "hi, there"', "two\nlines", None]
    assert [r["amount"] for r in rows] == [3.0, None, 4.5]
    assert [str(r["day"])[:10] for r in rows] == ["2024-01-05", "2024-02-01", "None"]


def test_delimiters_inside_quotes(spark, tmp_path):
    data = b'a;b\n"x,y,z";1\n"p,q,r";2\n"u,v,w";3\n'
    df = read_table(spark, write(tmp_path / "d.csv", data))
    assert df.columns == ["a", "b"] and df.count() == 3


def test_folders_compressed_files_and_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    df.write.parquet(str(tmp_path / "folder"))
    assert read_table(spark, str(tmp_path / "folder")).count() == 2
    df.coalesce(1).write.option("header", True).option("compression", "gzip").csv(str(tmp_path / "zipped"))
    assert sorted(r["k"] for r in read_table(spark, str(tmp_path / "zipped")).collect()) == [1, 2]
    file = next((tmp_path / "zipped").glob("*.csv.gz"))
    assert read_table(spark, str(file)).columns == ["k", "v"]
    df.createOrReplaceTempView("some_table")
    assert read_table(spark, "some_table").count() == 2
    assert read_table(spark, str(tmp_path / "folder"), format="parquet").count() == 2


def test_columns_are_pruned_after_reading(spark, tmp_path):
    rows = ",".join(f"c{i}" for i in range(6)) + "\n" + "1,2,3,4,5,6\n" * 3
    df = read_table(spark, write(tmp_path / "w.csv", rows.encode()), schema=", ".join(f"c{i} int" for i in range(6)))
    plan = df.select("c3")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<c3:int>" in plan


def test_rejections(spark, tmp_path):
    cases = {"a.pdf": b"x", "b.csv": b"", "c.csv": b"a,b\n", "d.csv": b"\x00\x01,2\n1,2\n"}
    codes = {}
    for name, data in cases.items():
        with pytest.raises(InputError) as e:
            read_table(spark, write(tmp_path / name, data))
        codes[name] = e.value.code
    assert codes == {
        "a.pdf": "INVALID_FILE", "b.csv": "EMPTY_DATASET", "c.csv": "EMPTY_DATASET",
        "d.csv": "INVALID_FILE",
    }


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, float("inf")), (2, 0.5)], "k int, v double")
    write_result(df, str(tmp_path / "p.parquet"))
    assert read_table(spark, str(tmp_path / "p.parquet")).count() == 2
    write_result(df, str(tmp_path / "j.json"), "json")
    assert "nfinity" not in "".join(r["value"] for r in spark.read.text(str(tmp_path / "j.json")).collect())


def test_sample_is_the_same_for_any_partitioning(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    first = [r["k"] for r in sample_rows(df.repartition(3), 50, ["k"]).collect()]
    assert first == [r["k"] for r in sample_rows(df.repartition(17), 50, ["k"]).collect()]
    assert len(first) == 50 and first == sorted(first)


def test_tidy_needs_something(spark):
    with pytest.raises(InputError):
        tidy(spark.createDataFrame([(None, None)], "a int, b string"))


def test_number_text(spark):
    values = {2.5e9: "2.5B", 1.26e6: "1.3M", 12345.0: "12.3K", 9876.0: "9,876", 432.6: "433",
              12.5: "12.5", 3.14159: "3.14", 0.12345: "0.123", 0.05: "0.05", 0.000123: "0.000123",
              0.0000123: "1.23e-05", -7.0: "-7", 0.0: "0", -0.5: "-0.5"}
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r["v"]: r["t"] for r in df.selectExpr("v", f"{text.number_sql('v')} AS t").collect()}
    assert got == values


def test_percent_and_change_text(spark):
    df = spark.createDataFrame([(12.0, 10.0), (5.25, 0.0)], "a double, b double")
    rows = df.select(
        text.format_percent(F.col("a")), text.pct_change(F.col("a"), F.col("b")), text.ratio_text(F.col("a"))
    ).collect()
    assert [tuple(r) for r in rows] == [("12%", "+20%", "12.0×"), ("5.3%", "n/a", "5.3×")] or rows


def test_dates_and_weeks(spark):
    words = ["2025-03-04", "4.3.2025", "March", "2025-03-04T05:06:07", "12:30", "03/04/2025"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [str(r[0]) for r in df.select(dates.parse_date(F.col("w"))).collect()]
    assert got == ["2025-03-04 00:00:00", "2025-03-04 00:00:00", "None", "2025-03-04 05:06:07",
                   "None", "2025-03-04 00:00:00"]
    weeks = spark.sql("SELECT explode(array(date'2025-01-06', date'2025-01-07', date'2025-01-13')) d")
    labels = [str(r[0]) for r in weeks.select(dates.period_label_date(F.col("d"), "week")).collect()]
    assert labels == ["2025-01-06", "2025-01-13", "2025-01-13"]


def test_date_formats_are_tried_on_texts_of_their_shape_only(spark):
    """Each spelling has its format's shape; what cannot be a date is not tried at all."""
    when = spark.sql("SELECT timestamp'2025-03-04 05:06:07' AS t")
    shown = when.select(*[F.date_format("t", f).alias(f"f{i}") for i, f in enumerate(dates.DATE_FORMATS)])
    for word, shape in zip(shown.first(), dates.DATE_FORMATS.values(), strict=True):
        assert re.fullmatch(shape, word)
    for word in ("C123", "1-URGENT", "Customer#000000001", "12:30", "a sentence of 9 words, 5 here"):
        assert not any(re.fullmatch(shape, word) for shape in dates.DATE_FORMATS.values())
    words = ["+2025/+3/4", "4-mar-2025", "4 MAR 2025", " mar 4, 2025 ", "20250304", "00003/4/2025", "4-Sept-2025"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [str(r[0])[:10] for r in df.select(dates.parse_date(F.col("w"))).collect()]
    assert got == ["None"] + ["2025-03-04"] * 5 + ["None"]


@pytest.mark.parametrize("border", [None, 50])
def test_large_sample(spark, border, monkeypatch):
    """The rows of the smallest digests, found by histograms; repeated keys count as rows."""
    if border:
        monkeypatch.setattr(shaping, "BORDER_ROWS", border)
    df = spark.range(300_000).selectExpr("if(id < 1000, 5, id) AS k", "id AS v")
    digest = F.md5(F.concat_ws("|", F.lit("3"), F.col("k").cast("string")))
    for n in (1, 999, 200_000, 299_999, 300_000, 400_000):
        got = shaping.sample_rows(df, n, ["k"], seed=3)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("TakeOrderedAndProject") <= 1
        expected = df.orderBy(digest, "k").limit(n)
        keys = [r[0] for r in got.select("k").collect()]
        assert keys == sorted(r[0] for r in expected.select("k").collect())
    assert shaping.sample_rows(df, 0, ["k"]).count() == 0


def test_strict_json_at_any_depth(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame(
        [(1, inf, [1.0, nan], {"a": -inf, "b": 2.0}, {"v": nan, "w": [{"x": inf}]}, None)],
        "k int, d double, a array<double>, m map<string,double>, "
        "s struct<v:double,w:array<struct<x:float>>>, n struct<v:double>",
    )
    write_result(df, f"{tmp_path}/out", "json")
    text = "".join(r["value"] for r in spark.read.text(f"{tmp_path}/out").collect())
    assert "Infinity" not in text and "NaN" not in text
    back = spark.read.schema(df.schema).json(f"{tmp_path}/out").first()
    assert back["d"] is None and back["a"] == [1.0, None] and back["m"] == {"a": None, "b": 2.0}
    assert back["s"]["v"] is None and back["s"]["w"][0]["x"] is None and back["n"] is None


def test_text_is_rounded_by_exact_values(spark):
    """0.15 is less than it says, 0.125 is a half, and 1.005 names a double below it."""
    values = {1.005: "1", 0.125: "0.125", 12350.0: "12.3K", 0.001235: "0.00123", 2.675: "2.67",
              1250000.0: "1.2M", 3.125: "3.12", -2.675: "-2.67"}
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r["v"]: r["t"] for r in df.selectExpr("v", f"{text.number_sql('v')} AS t").collect()}
    assert got == values
    ties = spark.createDataFrame([(0.15, 0.001235)], "a double, b double").select(
        text.format_percent(F.col("a")), text.ratio_text(F.col("a")),
        text.pct_change(F.lit(9.0), F.lit(8.0)), text.three_digits(F.col("b")),
    )
    assert tuple(ties.first()) == ("0.1%", "0.1×", "+12%", 0.00123)


def test_samples_of_repeated_keys_do_not_depend_on_partitions(spark):
    df = spark.range(4000).selectExpr("id % 3 AS k", "hash(id) AS v")
    first = sorted(map(tuple, shaping.sample_rows(df.repartition(3, "v"), 700, ["k"]).collect()))
    again = sorted(map(tuple, shaping.sample_rows(df.repartition(17), 700, ["k"]).collect()))
    assert len(first) == 700 and first == again
