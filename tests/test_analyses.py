import numpy as np
import pandas as pd
import pytest

from tabsonde import ROWS, AnalysisError, Frame, Where
from tabsonde.operators.bands import metric_bands, metric_by_bins
from tabsonde.operators.concentration import concentration, pareto
from tabsonde.operators.crosstab import crosstab
from tabsonde.operators.drivers import components_of, driver_ranking
from tabsonde.operators.findings import finding
from tabsonde.operators.frame import lump_levels
from tabsonde.operators.segments import compare_segments
from tabsonde.operators.trend import trend, trend_series

from planted import courses, harvest


@pytest.fixture(scope="module")
def shop(spark):
    return Frame.of(
        harvest(spark).cache(), ["failed", "labelled"], "picked_on"
    )


@pytest.fixture(scope="module")
def saas(spark):
    return Frame.of(
        courses(spark).cache(), ["cancelled", "voucher"]
    )


def one(rows):
    return finding(rows).first()


def labels(f):
    return [p["category"] for p in f["chart"]["points"]]


def test_segments_of_a_yes_no_outcome(shop):
    f = one(compare_segments(shop, "failed", "bench"))
    assert f["facts"]["top"] == labels(f)[0] == "C"
    assert f["agg"] == "rate" and f["significant"] and f["effect"]["name"] == "rate ratio"
    assert "C" in f["summary"] and "%" in f["headline"]


def test_segments_ignore_the_case_of_column_names(shop):
    f = one(compare_segments(shop, "Stored_H", "COVER"))
    assert (f["target"], f["dimension"], f["facts"]["top"]) == ("stored_h", "cover", "film")
    assert f["title"] == "stored_h by cover: film stands out"


def test_filter_is_applied_and_reported(saas):
    f = one(compare_segments(saas, "cancelled", "fee_plan", where=Where("level", " starter ")))
    assert f["filter"] == "level = Starter"
    assert "Computed on the subset where level = Starter." in f["caveats"]
    assert f["n"] < saas.n_rows


def test_bad_requests(shop, saas):
    with pytest.raises(AnalysisError, match="Unknown metric"):
        compare_segments(shop, "nope", "cover")
    with pytest.raises(AnalysisError, match="No rows where cover = 'Mars'. Values include"):
        compare_segments(shop, "failed", "cover", where=Where("cover", "Mars"))
    with pytest.raises(AnalysisError, match="yes/no"):
        metric_by_bins(shop, "profit_eur", "failed")
    with pytest.raises(AnalysisError, match="no date column"):
        trend(saas, "cancelled")
    with pytest.raises(AnalysisError, match="negative"):
        concentration(shop, "profit_eur", "supplier")


def test_bands(shop, saas):
    tickets = one(metric_by_bins(saas, "cancelled", "complaints_filed"))
    assert labels(tickets)[-1].endswith("+")
    assert float(tickets["facts"]["last_value"]) > float(tickets["facts"]["first_value"])
    margin = one(metric_by_bins(shop, "profit_eur", "stored_h"))
    assert margin["facts"]["shape"] == "decreasing"
    assert not one(metric_by_bins(shop, "crates", "stored_h"))["significant"]


def test_quantile_bands_equal_pandas(spark):
    rng = np.random.default_rng(2)
    x = np.where(rng.random(900) < 0.4, 3.5, rng.gamma(2, 3, 900))
    data = pd.DataFrame({"x": x, "y": rng.normal(size=900)})
    want = data.groupby(pd.qcut(data.x, 6, labels=False, duplicates="drop")).y.agg(["mean", "size"])
    frame = Frame.of(spark.createDataFrame(data))
    got = metric_bands(frame, "y", "x", 6).orderBy("band").collect()
    assert [r["n"] for r in got] == want["size"].tolist()
    assert [r["value"] for r in got] == pytest.approx(want["mean"].tolist())


def test_seasonal_volume(shop):
    f = one(trend(shop, ROWS))
    assert f["facts"]["peak_months"] == "Jun,Jul" and "Jun–Jul" in f["headline"]
    assert f["chart"]["kind"] == "line" and len(f["chart"]["points"]) == 24


def test_series_fill_gaps_and_drop_partial_periods(spark):
    days = [f"2024-01-{d:02d}" for d in range(1, 32)] + ["2024-03-30", "2024-03-31"]
    days += ["2024-04-01", "2024-04-02"]
    data = [(d, 2.0) for d in days]
    df = spark.createDataFrame(data, "day string, amount double")
    got = trend_series(Frame.of(df, time="day"), "amount", "month").orderBy("period").collect()
    assert [(r["label"], r["value"]) for r in got] == [
        ("2024-01", 62.0), ("2024-02", 0.0), ("2024-03", 4.0),
    ]


def test_concentration(shop):
    f = one(concentration(shop, "sales_eur", "supplier"))
    assert labels(f) == ["Top 10%", "Top 20%", "Top 50%"]
    assert float(f["facts"]["top10_share"]) > 0.35 and f["significant"]
    data = shop.df.toPandas()
    totals = data.groupby("supplier").sales_eur.sum().sort_values()
    row = pareto(shop, "sales_eur", "supplier").first()
    k = int(np.ceil(len(totals) * 0.1))
    assert row["top10_share"] == pytest.approx(totals[-k:].sum() / totals.sum())
    cum = totals.cumsum() / totals.sum()
    assert row["gini"] == pytest.approx(1 - 2 * cum.sum() / len(totals) + 1 / len(totals))


def test_crosstab(shop):
    f = one(crosstab(shop, "tool", "bench"))
    assert f["kind"] == "crosstab" and f["effect"]["name"] == "Cramer's V"
    assert not f["significant"]


def test_components_are_not_drivers(shop):
    measures = ["sales_eur", "packing_eur", "crates", "stored_h"]
    assert components_of(shop, "profit_eur", measures) == ["packing_eur", "sales_eur"]
    f = one(driver_ranking(shop, "profit_eur", ["cover", "bench"], measures))
    assert not {"sales_eur", "packing_eur"} & set(labels(f))
    assert any("components" in c for c in f["caveats"])


def test_rare_levels_fold(spark):
    rng = np.random.default_rng(1)
    levels = ["big"] * 300 + ["mid"] * 90 + [f"rare{i}" for i in range(10)]
    df = spark.createDataFrame(pd.DataFrame({"y": rng.normal(size=400), "g": levels}))
    frame = Frame.of(df)
    assert labels(one(compare_segments(frame, "y", "g"))) in (["big", "mid"], ["mid", "big"])
    counts = {r["level"]: r["count"] for r in lump_levels(frame, "g").groupBy("level").count().collect()}
    assert counts == {"big": 300, "mid": 90, None: 10}


def test_missing_is_a_group_and_wide_dimensions_keep_twelve(spark):
    levels = [f"v{i % 20:02d}" for i in range(2000)] + [None] * 500
    df = spark.createDataFrame([(i, v) for i, v in enumerate(levels)], "y int, g string")
    counts = lump_levels(Frame.of(df), "g").groupBy("level").count().collect()
    counts = {r["level"]: r["count"] for r in counts}
    assert counts["(missing)"] == 500 and counts["Other"] == 900 and len(counts) == 13


def test_errors_instead_of_nothing(spark):
    """No numbers, too few bands, too few periods: said, not left to an empty result."""
    df = spark.range(400).selectExpr(
        "CAST(id AS DOUBLE) AS y", "if(id < 395, 0D, 1D + id) AS x", "concat('t', id) AS words",
        "id % 2 = 0 AS side", "date_add(DATE'2024-01-01', CAST(id % 50 AS INT)) AS day",
    )
    frame = Frame.of(df, ["side"], time="day")
    for asked in (
        lambda: compare_segments(frame, "words", "side"),
        lambda: metric_by_bins(frame, "words", "x"),
        lambda: metric_by_bins(frame, "y", "x"),
        lambda: trend(frame, "y", "quarter"),
    ):
        with pytest.raises(AnalysisError):
            asked()


def test_no_small_group_is_null(spark, tmp_path):
    from tabsonde import catalog

    spark.range(400).selectExpr(
        "id AS doc_id", "'t' AS text", "if(id % 2 = 0, 'en', 'de') AS lang", "'web' AS source", "1L AS n_chars"
    ).write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(400).selectExpr(
        "id AS doc_id", "CAST(id % 3 = 0 AS INT) AS quality", "CAST(id % 5 = 0 AS INT) AS toxic"
    ).write.parquet(f"{tmp_path}/labels.parquet")
    row = catalog.QUERIES["segment_finding"](spark, str(tmp_path)).first()
    assert row["n"] == 400 and row["small_groups"] is None
