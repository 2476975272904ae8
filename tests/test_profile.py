import pandas as pd
import pytest

from tabsonde.operators.profile import (
    SKETCH_ERROR,
    distinct_values,
    duplicate_count,
    profile,
    profile_warnings,
    top_correlations,
)


def rows_of(p):
    return {r["name"]: r for r in p.rows}


def test_exact_numeric_statistics(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 4.0, 100.0, None)], "x double")
    x = rows_of(profile(df))["x"]
    assert (x["mean"], x["median"], x["p25"], x["p75"]) == (22, 3, 2, 4)
    assert (x["outlier_count"], x["missing_pct"], x["missing_count"]) == (1, 16.67, 1)
    assert x["skew"] == pytest.approx(pd.Series([1, 2, 3, 4, 100]).skew(), abs=1e-6)


def test_quartiles_with_one_common_value(spark):
    data = pd.DataFrame({"x": [7.0] * 450 + [float(i) for i in range(50)], "k": range(500)})
    x = rows_of(profile(spark.createDataFrame(data).repartition(9)))["x"]
    expected = data["x"].quantile([0.25, 0.5, 0.75]).tolist()
    assert [x["p25"], x["median"], x["p75"]] == expected


def test_all_columns_are_profiled(spark):
    df = spark.range(30).selectExpr("id", *[f"id * {i} % 7 AS c{i}" for i in range(210)])
    p = profile(df, correlate=False, duplicates=False)
    assert p.columns.count() == 211
    assert profile(df, correlate=False, duplicates=False, max_columns=5).columns.count() == 5


def test_duplicates_of_nested_values(spark):
    rows = [([1, None], (1, None), [[1], [2, 3]]), ([1], (None, 1), [[1, 2], [3]])]
    kinds = {"a": "array<int>", "s": "struct<x:int,y:int>", "n": "array<array<int>>"}
    for k, (name, kind) in enumerate(kinds.items()):
        df = spark.createDataFrame([(r[k],) for r in rows], f"{name} {kind}")
        assert duplicate_count(df).first()["duplicate_rows"] == 0
        assert duplicate_count(df.union(df)).first()["duplicate_rows"] == 2


def test_infinite_and_constant(spark):
    inf = float("inf")
    df = spark.createDataFrame([(1.0, 1), (inf, 1), (-inf, 1), (2.0, 1)], "x double, k int")
    p = profile(df)
    x = rows_of(p)["x"]
    assert (x["infinite_count"], x["mean"], x["max"], x["missing_count"]) == (2, 1.5, 2.0, 0)
    notes = {r["message"] for r in profile_warnings(p.columns, p.dataset).collect()}
    assert "'k' is constant and carries no information." in notes
    assert "'x' has 2 infinite values (excluded from stats)." in notes


def test_types(spark):
    n = 40
    df = spark.createDataFrame(
        pd.DataFrame(
            {
                "customer_id": range(n),
                "amount": range(n),
                "code": [f"K{i:03d}" for i in range(n)],
                "flag": ["yes", "No", " t "] * 13 + [None],
                "day": [f"2025-01-{1 + i % 28:02d}" for i in range(n)],
                "note": ["a long remark that goes on well beyond fifty characters of text"] * n,
                "kind": ["a", "b", "c", "d"] * 10,
            }
        )
    ).selectExpr("*", "array(1, 2) AS parts", "CAST(NULL AS STRING) AS nothing", "amount > 5 AS big")
    kinds = {k: r["inferred_type"] for k, r in rows_of(profile(df)).items()}
    assert kinds == {
        "customer_id": "id", "amount": "numeric", "code": "id", "flag": "boolean",
        "day": "datetime", "note": "text", "kind": "categorical", "parts": "complex",
        "nothing": "categorical", "big": "boolean",
    }


def test_yes_no_words_with_spaces(spark):
    rows = [(" " * 60 + "FALSE" + " " * 60, "truely"), ("y", "yes"), (None, None)]
    p = rows_of(profile(spark.createDataFrame(rows, "a string, b string"), correlate=False))
    assert (p["a"]["inferred_type"], p["b"]["inferred_type"]) == ("boolean", "categorical")


def test_duplicates_treat_missing_as_equal(spark):
    rows = [(None, "x"), (None, "x"), (1, None), (1, None), ("x", None), (None, "x")]
    df = spark.createDataFrame([(str(a) if a else None, b) for a, b in rows], "a string, b string")
    p = profile(df)
    assert p.dataset.first()["duplicate_rows"] == 3
    messages = [r["message"] for r in profile_warnings(p.columns, p.dataset).collect()]
    assert "3 fully duplicated rows." in messages


def test_correlations(spark):
    a = [((i * 37) % 101) / 10 for i in range(101)]
    noise = [((i * i * 53 + 7 * i) % 97) / 9 for i in range(101)]
    df = spark.createDataFrame(
        pd.DataFrame({"a": a, "b": [2 * v + 1 for v in a], "neg": [-v for v in a], "noise": noise})
    )
    top = {(r["a"], r["b"]): r["r"] for r in top_correlations(profile(df).correlations).collect()}
    assert top == {("a", "b"): 1.0, ("a", "neg"): -1.0, ("b", "neg"): -1.0}


def test_odd_names(spark):
    df = spark.createDataFrame([(1.0, "x"), (2.0, "y")], "`a.b c` double, `it's` string")
    assert rows_of(profile(df))["a.b c"]["mean"] == 1.5


@pytest.mark.parametrize("approximate", [False, True])
def test_distinct_values_are_those_of_a_profile(spark, approximate):
    df = spark.range(500).selectExpr(
        "id AS k", "if(id % 9 = 0, NULL, id % 7) AS `a.b`", "if(id % 2 = 0, 0D, -0D) AS zero",
        "CAST(NULL AS STRING) AS nothing", "repeat(concat(id % 31, ' '), 40) AS prose",
    )
    got = {r["name"]: r["unique_count"] for r in distinct_values(df, approximate).collect()}
    assert got == {"k": 500, "a.b": 7, "zero": 1, "nothing": 0, "prose": 31}
    full = profile(df, correlate=False, approximate=approximate)
    assert got == {n: r["unique_count"] for n, r in rows_of(full).items()}


def test_approximate_distinct_values(spark):
    """Sketches stay within their error; what may be unique is counted all the same."""
    df = spark.range(60_000).selectExpr(
        "id AS row_id", "id % 7 AS few", "CAST(id % 20011 AS DOUBLE) AS many",
        "if(id < 59000, concat('n', id), 'n0') AS name", "concat('k', id % 12) AS kind",
        "if(id % 2 = 0, 0D, -0D) AS zero", "CAST(NULL AS STRING) AS nothing",
        "if(id % 3 = 0, NULL, id % 2 = 0) AS flag", "repeat(concat(id % 31, ' '), 40) AS prose",
    )
    exact = {r["name"]: r for r in profile(df, correlate=False).columns.collect()}
    guess = {r["name"]: r for r in profile(df, correlate=False, approximate=True).columns.collect()}
    for name, row in exact.items():
        assert abs(guess[name]["unique_count"] - row["unique_count"]) <= (
            4 * SKETCH_ERROR * row["unique_count"]
        )
        assert guess[name]["inferred_type"] == row["inferred_type"]
        assert guess[name]["top_values"] == row["top_values"]
    assert guess["row_id"]["unique_count"] == 60_000 and guess["name"]["unique_count"] == 59_000
    assert guess["zero"]["unique_count"] == 1 and guess["nothing"]["unique_count"] == 0
