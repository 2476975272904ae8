import random

import pytest

from tabsonde import Frame
from tabsonde.operators import nearest
from tabsonde.operators.findings import finding, finding_json
from tabsonde.operators.grounding import (
    evidence_from_findings,
    evidence_from_profile,
    extract_numbers,
    ground_claims,
    grounding_report,
    report_texts,
    unverified_numbers,
)
from tabsonde.operators.profile import profile, top_correlations
from tabsonde.operators.segments import compare_segments
from pyspark.sql import functions as F

from planted import harvest


@pytest.fixture(scope="module")
def social(spark):
    frame = Frame.of(harvest(spark).cache(), ["failed"])
    return finding(compare_segments(frame, "failed", "bench")).cache()


@pytest.fixture(scope="module")
def evidence(spark, social):
    p = profile(harvest(spark), duplicates=False)
    one = F.lit(1).cast("long")
    rows = evidence_from_profile(p.columns, p.dataset, top_correlations(p.correlations), one)
    return rows.unionByName(evidence_from_findings(social, one)).cache()


def check(spark, evidence, text):
    claims = spark.createDataFrame([(1, "detail", text)], "doc_id long, location string, text string")
    return ground_claims(claims, evidence)


def test_backed_numbers(spark, evidence, social):
    facts = social.first()["facts"]
    top, bottom = float(facts["top_value"]), float(facts["bottom_value"])
    text = f"Failed {top:.1f}% of the time vs {bottom:.0f}%, about {top / bottom:.1f}× as often."
    report = grounding_report(check(spark, evidence, text)).first()
    assert (report["checked"], report["unverified_count"]) == (3, 0)


def test_invented_numbers_are_listed_with_context(spark, evidence):
    text = "Returns cost the company 4,321,987 dollars and rose 73.4% last year."
    rows = unverified_numbers(check(spark, evidence, text)).collect()
    assert {r["value"] for r in rows} == {"4,321,987", "73.4%"}
    assert all(r["location"] == "detail" for r in rows)
    assert any("rose 73.4% last" in r["context"] for r in rows)


def test_ignored_numbers(spark, evidence):
    for text in (
        "In 2025 the top 3 channels (see F12) drove readmitted_30d and Q4 volume.",
        "a strong effect (p < 0.001, and a second test gave p≈2e-232)",
        "about 3.1 × 10^-5 of them",
    ):
        assert check(spark, evidence, text).count() == 0


def test_complements_and_percent_columns(spark, evidence, social):
    top = float(social.first()["facts"]["top_value"])
    text = f"{100 - top:.1f}% of the lots on C pass; 7% an hour is lost; 30% have no taste score."
    report = grounding_report(check(spark, evidence, text)).first()
    assert report["checked"] == 3 and report["unverified_count"] <= 1


def test_parsing(spark):
    text = "Sales of −1,234.50, 12.5 K and 3.2M; x2 2x 7pp 5 points 1.5B é9 9é"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [(r["raw"], r["unit"], r["value"]) for r in extract_numbers(df).orderBy("seq").collect()]
    assert ("12.5", "K", 12500.0) in got and ("3.2", "M", 3200000.0) in got
    assert ("2", "x", 2.0) in got and ("7", "pp", 7.0) in got and ("5", "points", 5.0) in got
    assert ("1.5", "B", 1.5e9) in got
    assert not any(raw == "9" for raw, _, _ in got)


def test_scaled_tolerance_and_many_documents(spark):
    claims = spark.createDataFrame(
        [(i, "t", f"total {v}") for i, v in ((1, "12.4M"), (2, "12.4M"), (3, "250"), (4, "0.07"))],
        "doc_id long, location string, text string",
    )
    facts = spark.createDataFrame(
        [(1, "numbers", 12.1e6), (2, "numbers", 10e6), (3, "percents", 250.4), (4, "ratios", 0.07)],
        "doc_id long, pool string, value double",
    )
    got = {r["doc_id"]: r["supported"] for r in ground_claims(claims, facts).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False}


def test_threshold_far_before_its_number(spark):
    text = "a test gave p <" + " " * 200 + "0.25, and sharp < 0.75 of n=" + "x " * 300 + "44.5"
    df = spark.createDataFrame([(1, "t", text)], "doc_id long, location string, text string")
    got = [(r["raw"], r["threshold"]) for r in extract_numbers(df).orderBy("seq").collect()]
    assert got == [("0.25", True), ("0.75", False), ("44.5", False)]


def test_context_of_close_numbers(spark):
    text = " ".join(f"{k}.5%" for k in range(200)) + " end"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    for r in extract_numbers(df).collect():
        token = f"{r['seq']}.5%"
        at = (" " + text).index(f" {token}")
        near = text[max(0, at - 40) : at + len(token) + 40].strip()
        assert r["token"] == token and r["context"] == near


def test_numbers_without_context_search_each_text_once(spark):
    text = "p < 0.05,\u0001 −1,234 K\u0002 of 7%\u0002, 3×, 12.50 and 4e-5"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    bare = extract_numbers(df, context=False)
    assert bare.columns == [c for c in extract_numbers(df).columns if c != "context"]
    assert bare.collect() == extract_numbers(df).drop("context").collect()
    got = [(r["raw"], r["unit"], r["value"]) for r in bare.orderBy("seq").collect()]
    assert got == [
        ("0.05", None, 0.05), ("−1,234", "K", -1234000.0), ("7", "%", 7.0), ("3", "×", 3.0),
        ("12.50", None, 12.5),
    ]
    plan = bare.select("raw", "unit", "value")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract" not in plan


def nearest_by_looking(wanted, known, kinds):
    out = []
    for key, at in wanted:
        row = [key, at]
        for kind in kinds:
            same = [v for k, p, v in known if k == key and p == kind and v == v]
            row.append(max((v for v in same if v <= at), default=None))
            row.append(min((v for v in same if v >= at), default=None))
        out.append(tuple(row))
    return sorted(out, key=repr)


@pytest.mark.parametrize("large", [None, 50])
def test_nearest_known(spark, large, monkeypatch):
    """One key holds nine tenths of the rows; with a low bound it is cut into ranges."""
    if large:
        monkeypatch.setattr(nearest, "LARGE_KEY", large)
    rng = random.Random(8)
    kinds = ("a", "b", "c")
    known = [
        (0 if k % 10 else k % 7, rng.choice("aab"), rng.choice([rng.uniform(0, 50), rng.randint(0, 9) * 1.0]))
        for k in range(4000)
    ]
    known += [(0, "a", float("nan")), (0, "c", 1e6), (9, "a", 2.0), (0, "b", -3e5)]
    wanted = [(rng.choice([0, 0, 1, 2, 8]), rng.uniform(-5, 60)) for _ in range(300)]
    wanted += [(0, 3.0), (0, 3.0), (0, 2e6), (0, -1e9)]
    got = nearest.nearest_known(
        spark.createDataFrame(wanted, "key int, at double").repartition(3),
        spark.createDataFrame(known, "key int, kind string, v double").repartition(3),
        ["key"], "at", "v", "kind", kinds,
    )
    rows = sorted(((*r,) for r in got.collect()), key=repr)
    assert rows == nearest_by_looking(wanted, known, kinds)


def test_one_document_with_most_evidence(spark, monkeypatch):
    monkeypatch.setattr(nearest, "LARGE_KEY", 100)
    facts = spark.range(20_000).selectExpr(
        "if(id % 10 = 0, id % 50, 7) AS doc_id",
        "elt(1 + cast(id % 3 AS int), 'numbers', 'percents', 'ratios') AS pool",
        "cast(id * 37 % 20000 AS double) / 8 AS value",
    )
    text = "of 812.3 and 99.999 were 44.1%, 12.125x, 1.2K and 7,777,777 more"
    claims = spark.range(50).selectExpr("id AS doc_id", "'t' AS location", f"'{text}' AS text")
    grounded = ground_claims(claims, facts)
    known = {(r["doc_id"], r["pool"], r["value"]) for r in facts.collect()}
    for r in grounded.collect():
        pools = {"%": ("percents",), "x": ("ratios",)}.get(r["unit"], ("numbers", "percents"))
        reach = 60.0 if r["unit"] == "K" else 10.0 ** -r["decimals"] / 2 + 1e-9
        near = any(
            d == r["doc_id"] and p in pools and abs(v - r["value"]) <= reach for d, p, v in known
        )
        assert r["supported"] == near


def test_report_is_flattened(spark):
    report = '{"title": "A 5", "column": "x", "slides": [{"bullets": ["b1", "b2"]}], "n": 3}'
    df = spark.createDataFrame([(1, report)], "doc_id long, report string")
    got = {(r["location"], r["text"]) for r in report_texts(df).collect()}
    assert got == {("title", "A 5"), ("slides[0].bullets[0]", "b1"), ("slides[0].bullets[1]", "b2")}


def test_deep_reports_are_read_to_the_end(spark):
    report = '"the end"'
    for k in range(12):
        report = f'{{"level{k}": {report}}}' if k % 2 else f"[{report}]"
    df = spark.createDataFrame([(1, report)], "doc_id long, report string")
    assert [r["text"] for r in report_texts(df).collect()] == ["the end"]


def test_compact_json(social):
    text = finding_json(social).first()["json"]
    assert '"score"' not in text and '"source"' not in text and '"q_value"' not in text
