"""Tests, ranks and quantiles against brute force on small skewed tables."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabsonde import Frame
from tabsonde.functions import effects, pvalues
from tabsonde.operators import hypotheses, ranks
from tabsonde.operators.hypotheses import benjamini_hochberg, chi2_uniform, melt
from tabsonde.operators.testbed import TestBed, single_test


def frame(spark, columns, binaries=()):
    return Frame.of(spark.createDataFrame(pd.DataFrame(columns)), binaries)


@pytest.fixture(scope="module")
def skewed():
    """A third of the rows share one value, a third of the groups one level."""
    rng = np.random.default_rng(3)
    n = 4000
    x = np.where(rng.random(n) < 0.4, 7.0, np.round(rng.pareto(1.2, n) * 5, 2))
    y = np.where(rng.random(n) < 0.35, 0.0, np.round(x + rng.normal(0, 20, n), 1))
    g = np.where(rng.random(n) < 0.6, "big", rng.choice(["a", "b", "c"], n))
    return pd.DataFrame({"x": x, "y": y, "g": g, "won": rng.random(n) < 0.3 + 0.2 * (x > 7)})


def brute_kruskal(values, groups):
    r = pd.Series(values).rank()
    n = len(r)
    h = 12 / (n * (n + 1)) * sum(
        len(s) * (s.mean() - (n + 1) / 2) ** 2 for _, s in r.groupby(np.asarray(groups))
    )
    t = pd.Series(values).value_counts().astype(float)
    return h / (1 - (t**3 - t).sum() / (float(n) ** 3 - n))


@pytest.mark.parametrize("partitions", [1, 7, 64])
def test_rank_tests_match_brute_force(spark, skewed, partitions):
    df = spark.createDataFrame(skewed).repartition(partitions)
    f = Frame.of(df, ["won"])
    kw = single_test(f, "group", "y", "g").first()
    assert kw["statistic"] == pytest.approx(brute_kruskal(skewed.y, skewed.g), rel=1e-9)
    sp = single_test(f, "number", "y", "x").first()
    assert sp["effect"] == pytest.approx(skewed.x.rank().corr(skewed.y.rank()), rel=1e-9)
    mw = single_test(f, "number", "won", "x").first()
    r = skewed.x.rank()
    n1 = skewed.won.sum()
    u = r[skewed.won].sum() - n1 * (n1 + 1) / 2
    assert mw["statistic"] == pytest.approx(u)
    assert mw["effect"] == pytest.approx(2 * u / (n1 * (len(r) - n1)) - 1)


def test_hot_values_get_their_own_bucket(spark, skewed):
    df = spark.createDataFrame(skewed)
    cuts = ranks.find_cuts(df, ["x", "y"], len(skewed))
    assert 7.0 in [cuts["x"].edges[i] for i in cuts["x"].solo]
    assert 0.0 in [cuts["y"].edges[i] for i in cuts["y"].solo]
    counts = ranks.with_buckets(df, cuts).groupBy("x__bucket").count().collect()
    biggest = max(r["count"] for r in counts if r["x__bucket"] >= 0)
    assert biggest <= 2.5 * len(skewed) / 16


def test_average_ranks_and_quantiles(spark, skewed):
    df = spark.createDataFrame(skewed[["x"]].rename(columns={"x": "value"}))
    got = {r["value"]: r["avg_rank"] for r in ranks.avg_rank(df, "value", len(skewed)).collect()}
    assert got == dict(zip(skewed.x, skewed.x.rank(), strict=True))
    cuts = ranks.find_cuts(df, ["value"], len(skewed))
    rows = melt(
        ranks.with_buckets(df, cuts),
        [{"k": "1", "bucket": "value__bucket", "v": "value"}],
    )
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)
    row = ranks.exact_quantiles(rows, ["k"], "v", "bucket", probs, 16).first()
    for i, p in enumerate(probs):
        assert row[f"q{i}"] == pytest.approx(skewed.x.quantile(p))


def test_contingency_against_hand_computed(spark):
    cells = {("a", True): 30, ("a", False): 70, ("b", True): 10, ("b", False): 90}
    rows = [k for k, n in cells.items() for _ in range(n)]
    f = frame(spark, {"g": [a for a, _ in rows], "won": [b for _, b in rows]}, ["won"])
    out = single_test(f, "group", "won", "g").first()
    assert out["effect"] == pytest.approx(3.0) and out["p_value"] < 0.001
    d = abs(30 - 20) - 0.5
    assert out["statistic"] == pytest.approx(d * d * (2 / 20 + 2 / 80))
    v = single_test(f, "pair", "won", "g").first()
    assert v["effect"] == pytest.approx(math.sqrt(100 * (2 / 20 + 2 / 80) / 200))


def test_monotone_and_perfect_cases(spark):
    x = list(range(100))
    f = frame(spark, {"x": x, "y": [v**3 for v in x], "won": [v > 50 for v in x]}, ["won"])
    assert single_test(f, "number", "y", "x").first()["effect"] == pytest.approx(1.0)
    assert single_test(f, "number", "won", "x").first()["effect"] == pytest.approx(1.0)


def test_degenerate_inputs_have_no_p(spark):
    n = 60
    f = frame(
        spark,
        {"flat": [1.0] * n, "g": ["a", "b"] * (n // 2), "x": list(range(n)), "won": [True] * n},
        ["won"],
    )
    assert single_test(f, "group", "flat", "g").first()["p_value"] is None
    assert single_test(f, "number", "flat", "x").first()["p_value"] is None
    assert single_test(f, "number", "won", "x").first()["p_value"] is None
    assert single_test(f, "group", "won", "g").first()["p_value"] is None


def test_missing_outcomes_are_left_out(spark):
    words = ["yes", "no", None, "y"] * 30
    f = frame(spark, {"won": words, "x": [float(i) for i in range(120)]}, ["won"])
    assert single_test(f, "number", "won", "x").first()["n"] == 90


def tails(spark, expression, rows):
    """p-values of (statistic, df) rows, with a look at the plan: no Python."""
    df = spark.createDataFrame([(k, float(x), float(n)) for k, (x, n) in enumerate(rows)], "k int, x double, n double")
    out = df.select("k", expression(F.col("x"), F.col("n")).alias("p"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    return [r["p"] for r in sorted(out.collect())]


def test_tails(spark):
    chi2 = tails(spark, pvalues.chi2_p, [
        (3.841458820694124, 1), (5.991464547107979, 2), (7.814727903251179, 3),
        (19.67513757268249, 11), (43.77297182574219, 30), (1370.0, 1), (0.0, 4), (-1.0, 1),
    ])
    assert chi2[:5] == pytest.approx([0.05] * 5, rel=1e-9)
    assert 0 < chi2[5] < 1e-298 and chi2[6:] == [1.0, 1.0]
    x = [k / 7 for k in range(1, 250)]
    odd = tails(spark, pvalues.chi2_p, [(v, 5) for v in x])
    plain = [
        math.erfc(math.sqrt(v / 2)) + math.sqrt(2 * v / math.pi) * math.exp(-v / 2) * (1 + v / 3) for v in x
    ]
    assert odd == pytest.approx(plain, rel=1e-11)
    normal = tails(spark, lambda z, _: pvalues.normal_p(z), [(v, 0) for v in (*x, -1.959963984540054)])
    assert normal == pytest.approx([*(math.erfc(v / math.sqrt(2)) for v in x), 0.05], rel=1e-11)
    student = tails(spark, pvalues.student_p, [
        (2.2281388519649385, 10), (1.9623390808264078, 1000), (math.inf, 5), (0.0, 3), (-1.0, 1),
        (1e6, 2),
    ])
    assert student == pytest.approx([0.05, 0.05, 0.0, 1.0, 0.5, 1 - 1 / math.sqrt(1 + 2e-12)], rel=1e-4)
    for v, p in zip(x, tails(spark, pvalues.student_p, [(v, 4) for v in x]), strict=True):
        s = v / math.sqrt(v * v + 4)
        assert p == pytest.approx(1 - s * (1 + (1 - s * s) / 2), rel=1e-7, abs=1e-13)
    assert pvalues.exact_mann_whitney(0, 3, 3) == pytest.approx(0.1)
    assert pvalues.exact_mann_whitney(2, 4, 5) == pytest.approx(8 / 126)


def test_missing_tails(spark):
    df = spark.range(1).select(
        pvalues.chi2_p(F.lit(None), F.lit(1)), pvalues.chi2_p(F.lit(math.nan), F.lit(1)),
        pvalues.chi2_p(F.lit(1.0), F.lit(None)), pvalues.normal_p(F.lit(None)),
        pvalues.student_p(F.lit(None), F.lit(3)), pvalues.student_p(F.lit(1.0), F.lit(None)),
        pvalues.tail_p(F.lit(None).cast("string"), F.lit(1.0), F.lit(1.0), F.lit(1.0)),
        pvalues.tail_p(F.lit("exact_u"), F.lit(0.0), F.lit(3.0), F.lit(3.0)),
    )
    *missing, exact = df.first()
    assert missing == [None] * 7 and exact == pytest.approx(0.1)


def test_exact_small_side(spark):
    f = frame(spark, {"won": [True] * 3 + [False] * 3, "x": [1.0, 2, 3, 4, 5, 6]}, ["won"])
    assert single_test(f, "number", "won", "x").first()["p_value"] == pytest.approx(0.1)


def test_false_discovery_rate(spark):
    p = [(0, 0.01), (1, 0.04), (2, 0.03), (3, None), (4, 0.20)]
    df = spark.createDataFrame(p, "i int, p double")
    q = {r["i"]: r["q_value"] for r in benjamini_hochberg(df, "p", 5).collect()}
    assert q[3] is None
    expected = {0: 0.04, 1: 0.16 / 3, 2: 0.16 / 3, 4: 0.20}
    assert {k: v for k, v in q.items() if v is not None} == pytest.approx(expected)


def test_false_discovery_rate_with_a_dominant_p(spark):
    rng = np.random.default_rng(5)
    p = np.where(rng.random(3000) < 0.4, 1.0, rng.random(3000) ** 3)
    df = spark.createDataFrame(pd.DataFrame({"i": range(3000), "p": p}))
    got = benjamini_hochberg(df, "p", 3000).toPandas().set_index("i").q_value
    order = np.argsort(p, kind="stable")
    raw = p[order] * 3000 / np.arange(1, 3001)
    want = np.empty(3000)
    want[order] = np.minimum(np.minimum.accumulate(raw[::-1])[::-1], 1)
    assert len(got) == 3000
    np.testing.assert_allclose(got.sort_index().to_numpy(), want)


def test_uniform_counts_absent_categories(spark):
    df = spark.createDataFrame([(0, 10), (0, 14)], "test int, n long")
    row = chi2_uniform(df, 12).first()
    assert row["statistic"] == pytest.approx((8**2 + 12**2 + 10 * 4) / 2)


def test_effect_scale(spark):
    rows = [(effects.SPEARMAN, -0.4), (effects.RATE_RATIO, 1.1), (effects.EPSILON_SQUARED, 0.25)]
    df = spark.createDataFrame(rows, "name string, v double")
    out = df.select(
        effects.strength_of(F.col("name"), F.col("v")),
        effects.normalized(F.col("name"), F.col("v")),
        effects.association(F.col("name"), F.col("v")),
    ).collect()
    assert [r[0] for r in out] == ["moderate", "negligible", "strong"]
    assert [r[1] for r in out] == pytest.approx([0.8, 0.1, 1.5])
    assert [r[2] for r in out] == pytest.approx([0.4, 1.0, 0.5])


def test_student_tail_has_no_jump(spark):
    ts = (0.3, 2.0, 9.0, 30.0)
    below, above = (tails(spark, pvalues.student_p, [(t, n) for t in ts]) for n in (99_999, 100_001))
    for t, one, other in zip(ts, below, above, strict=True):
        # The tail itself changes by about t**4 / (4 * df**2) per degree of freedom.
        assert other == pytest.approx(one, rel=1e-9 + t**4 / 1e10)
    far, normal = tails(spark, pvalues.student_p, [(30.0, 10_000_001), (2.0, 1e15)])
    assert far == pytest.approx(1.001e-197, rel=1e-3)
    assert normal == pytest.approx(math.erfc(math.sqrt(2)))


def counted_mann_whitney(u, n1, n2):
    """The same p from the number of arrangements for each U, counted row by row."""
    ways = {(0, 0): 1}
    for rank in range(n1 + n2):
        grown = {}
        for (chosen, total), n in ways.items():
            grown[chosen, total] = grown.get((chosen, total), 0) + n
            if chosen < n1:
                at = chosen + 1, total + rank - chosen
                grown[at] = grown.get(at, 0) + n
        ways = grown
    tail = sum(n for (k, total), n in ways.items() if k == n1 and total >= max(u, n1 * n2 - u))
    return min(2 * tail / math.comb(n1 + n2, n1), 1.0)


def test_exact_tail_against_counting():
    for n1, n2 in ((1, 30), (2, 9), (3, 40), (5, 5), (7, 12), (8, 8), (8, 20)):
        for u in range(0, n1 * n2 + 1, 1 + n1 * n2 // 12):
            expected = counted_mann_whitney(u, n1, n2)
            assert pvalues.exact_mann_whitney(u, n1, n2) == pytest.approx(expected, rel=1e-12)
            assert pvalues.exact_mann_whitney(u, n2, n1) == pytest.approx(expected, rel=1e-12)


@pytest.mark.parametrize("n", [6_666, 6_667, 50_000])
def test_exact_small_side_of_a_large_table(spark, n):
    x = [float(k) for k in range(n + 3)]
    f = frame(spark, {"won": [False] * n + [True] * 3, "x": x}, ["won"])
    p = single_test(f, "number", "won", "x").first()["p_value"]
    assert p == pytest.approx(2 / math.comb(n + 3, 3), rel=1e-9)
    assert pvalues.exact_mann_whitney(0, 8, 10**12) == pytest.approx(2 / math.comb(10**12 + 8, 8))


def _plain_ranks(values):
    order = sorted(values)
    return [
        (sum(o < v for o in order) + 1 + sum(o <= v for o in order)) / 2 for v in values
    ]


@pytest.mark.parametrize("rows_bound", [None, 0])
def test_five_tests_share_one_ranking(spark, rows_bound, monkeypatch):
    """Kruskal-Wallis and Mann-Whitney of one column, some partners with gaps, one sort."""
    if rows_bound is not None:
        monkeypatch.setattr(ranks, "BROADCAST_ROWS", -1)
    df = spark.range(3000).selectExpr(
        "if(id % 11 = 0, NULL, CAST(pmod(hash(id), 40) AS DOUBLE)) AS v",
        "CAST(1 + id % 3 AS SMALLINT) AS g0", "CAST(1 + id % 5 AS SMALLINT) AS g1",
        "CAST(if(id % 7 = 0, NULL, 1 + id % 4) AS SMALLINT) AS g2",
        "CAST(if(id % 13 = 0, NULL, id % 2) AS SMALLINT) AS b0",
        "CAST(if(id < 6, id % 2, NULL) AS SMALLINT) AS b1",
    )
    cuts = ranks.find_cuts(df, ["v"], 3000)
    base = ranks.with_buckets(df, cuts)
    tests = [(0, "v", "g0"), (1, "v", "g1"), (2, "v", "g2"), (3, "v", "b0"), (4, "v", "b1")]
    columns = hypotheses.ranked_columns(tests, {"g0", "g1"})
    assert len(columns) == 1 and columns[0].among == (None, 2, 3, 4)
    sums = hypotheses.rank_sums(base, columns, 20)
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") + plan.count("RunningWindowFunction") <= 3
    got = {(r["test"], r["g"]): (r["n"], r["rank_sum"], r["ties"], r["total"]) for r in sums.collect()}
    rows = df.collect()
    for test, _, g in tests:
        known = [(r["v"], r[g]) for r in rows if r["v"] is not None and r[g] is not None]
        placed = list(zip(_plain_ranks([v for v, _ in known]), known, strict=True))
        counts = {}
        for v, _ in known:
            counts[v] = counts.get(v, 0) + 1
        for group in {k for _, k in known}:
            own = [(r, v) for r, (v, k) in placed if k == group]
            n, total, ties, size = got[test, group]
            assert n == len(own) and size == len(known)
            assert abs(total - sum(r for r, _ in own)) < 1e-6
            assert ties == sum(counts[v] ** 2 - 1 for _, v in own)


def test_spearman_ranks_each_outcome_once(spark):
    df = spark.range(2000).selectExpr(
        "CAST(pmod(hash(id), 50) AS DOUBLE) AS y", "CAST(pmod(hash(id), 50) + id % 9 AS DOUBLE) AS a",
        "if(id % 5 = 0, NULL, CAST(id % 17 AS DOUBLE)) AS b", "CAST(-(id % 3) AS DOUBLE) AS c",
    )
    names = ["y", "a", "b", "c"]
    cuts = ranks.find_cuts(df, names, 2000)
    base = ranks.with_buckets(df, cuts)
    specs = [hypotheses.Spec(k, "spearman", "y", x) for k, x in enumerate("abc")]
    specs.append(hypotheses.Spec(3, "spearman", "a", "b"))
    rows = df.collect()
    for whole in ((), ("a", "c")):
        got = {r["test"]: r for r in hypotheses.run_specs(base, specs, cuts, whole).collect()}
        for s in specs:
            both = [(r[s.x], r[s.y]) for r in rows if r[s.x] is not None and r[s.y] is not None]
            rx, ry = (np.array(_plain_ranks([p[k] for p in both])) for k in (0, 1))
            assert got[s.test]["n"] == len(both)
            assert abs(got[s.test]["effect"] - np.corrcoef(rx, ry)[0, 1]) < 1e-9


def test_spearman_sorts_equal_pairs_as_one_row(spark, monkeypatch):
    """Repeated pairs are counted before they are sorted, and buckets get partitions of their own."""
    monkeypatch.setattr(ranks, "FEW_BUCKETS", 0)
    df = spark.range(4000).selectExpr(
        "if(id % 11 = 0, NULL, CAST(pmod(hash(id % 400), 90) AS DOUBLE)) AS y",
        "if(id % 7 = 0, NULL, CAST(pmod(hash(id % 400), 23) + id % 2 AS DOUBLE)) AS x",
    )
    cuts = ranks.find_cuts(df, ["y", "x"], 4000)
    base = ranks.with_buckets(df, cuts)
    spec = hypotheses.Spec(0, "spearman", "y", "x")
    both = [(r["x"], r["y"]) for r in df.where("x IS NOT NULL AND y IS NOT NULL").collect()]
    rx, ry = (np.array(_plain_ranks([p[k] for p in both])) for k in (0, 1))
    out = hypotheses.run_specs(base, [spec], cuts)
    got = out.first()
    assert got["n"] == len(both) and abs(got["effect"] - np.corrcoef(rx, ry)[0, 1]) < 1e-9
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # Below the sort by the outcome there is a count of its pairs.
    assert "Aggregate [y" in plan[plan.rindex("Window ["):]


def test_fraction_works_out_its_inputs_once(spark):
    """The steps of the fraction look at named inputs, not at the columns behind them."""
    df = spark.createDataFrame([(7.0, 0.3), (500.0, 0.01)], "dof double, far double")
    out = df.select(
        pvalues._beta_fraction(F.col("dof") / 2, F.lit(0.5), 1 - F.col("far"), F.lit(60)).alias("f")
    )
    bodies = out._jdf.queryExecution().analyzed().toString().split("lambdafunction(")[1:]
    assert bodies
    for body in bodies:
        depth = 1
        for end, sign in enumerate(body):
            depth += (sign == "(") - (sign == ")")
            if not depth:
                break
        assert "dof#" not in body[:end] and "far#" not in body[:end]
    assert all(r["f"] > 0 for r in out.collect())


def spearman_inputs(spark, monkeypatch, df, y, xs):
    """Results by x, how many rows are ranked on either side, and the table as pandas."""
    seen = {}
    for name in ("with_shared_ranks", "with_ranks"):
        def watched(rows, *args, own=getattr(hypotheses, name), name=name):
            seen[name] = rows.count()
            return own(rows, *args)

        monkeypatch.setattr(hypotheses, name, watched)
    bed = TestBed.build(Frame.of(spark.createDataFrame(df)), [y, *xs], [])
    found = bed.run([bed.number_spec(k, y, x) for k, x in enumerate(xs)]).collect()
    return {xs[r["test"]]: r for r in found}, seen


@pytest.mark.parametrize("y", ["continuous", "few"])
def test_spearman_counts_before_it_sorts(spark, monkeypatch, y):
    rng = np.random.default_rng(11)
    n = 3000
    a = rng.integers(0, 9, n).astype(float)
    df = pd.DataFrame({"a": a, "b": a + rng.integers(0, 4, n), "few": rng.integers(1, 40, n) + a})
    df["continuous"] = df.few + rng.normal(0, 30, n)
    df.loc[rng.random(n) < 0.2, "b"] = np.nan
    found, seen = spearman_inputs(spark, monkeypatch, df, y, ["a", "b"])
    for x in ("a", "b"):
        both = df[[x, y]].dropna()
        assert found[x]["n"] == len(both)
        assert found[x]["effect"] == pytest.approx(both[x].rank().corr(both[y].rank()), rel=1e-9)
    # The other side has one row per value, whatever the ranks of y.
    assert seen["with_ranks"] == df.a.nunique() + df.b.nunique()
    different = len(df[["a", "b", "few"]].drop_duplicates())
    assert seen["with_shared_ranks"] == (different if y == "few" else n)


def test_few_valued_columns_are_told_from_others(spark):
    df = spark.range(20_000).selectExpr("id % 7 + 0D AS a", "id % 90 + 0D AS b", "id + 0D AS c")
    cuts = ranks.find_cuts(df, ["a", "b", "c"], 20_000)
    assert (cuts["a"].levels, cuts["b"].levels, cuts["c"].levels) == (7, 90, None)
    assert ranks.repeating([cuts["a"], cuts["b"]])
    assert not ranks.repeating([cuts["a"], cuts["c"]]) and not ranks.repeating([cuts["b"]] * 3)
