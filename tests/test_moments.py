"""Moments from one scan against numpy, with gaps, constants and far-off values."""

import itertools

import numpy as np
import pytest

from tabsonde import Frame
from tabsonde.operators.drivers import formula_components, ingredients
from tabsonde.operators.moments import correlations, pair_moments
from tabsonde.operators.profile import correlation_pairs


def numbers(rows=900, columns=7, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(rows, columns)) * 10.0 ** np.arange(columns) + 1e5
    x[:, 1] += x[:, 0]
    x[rng.random(x.shape) < 0.15] = np.nan
    x[:, 3] = 0.1
    x[0, 2] = 1e9
    return x


def table(spark, x, parts=5):
    names = [f"c{k}" for k in range(x.shape[1])]
    rows = [tuple(None if np.isnan(v) else float(v) for v in row) for row in x]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(parts), names


def plain(a, b):
    both = ~np.isnan(a) & ~np.isnan(b)
    a, b = a[both], b[both]
    if not len(a) or np.ptp(a) == 0 or np.ptp(b) == 0:
        return None, both.sum()
    return np.corrcoef(a, b)[0, 1], both.sum()


def near(got, expected):
    return (got is None) == (expected is None) and (got is None or abs(got - expected) < 1e-6)


def scans(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Scan parquet")


def test_pairs(spark):
    x = numbers()
    df, names = table(spark, x)
    got = {(r.a, r.b): r for r in correlation_pairs(df, names).collect()}
    assert len(got) == 21
    for i, j in itertools.combinations(range(7), 2):
        r, n = plain(x[:, i], x[:, j])
        row = got[names[i], names[j]]
        assert row.n == n and near(row.r, None if r is None else round(r, 4))


def test_one_scan(spark, tmp_path):
    df, names = table(spark, numbers())
    df.write.parquet(f"{tmp_path}/t")
    wide = spark.read.parquet(f"{tmp_path}/t")
    assert scans(correlations(pair_moments(wide, names))) == 1
    assert scans(pair_moments(wide, names, names[:3]).table) == 1


def test_formulas(spark):
    x = numbers(columns=6)
    df, names = table(spark, np.column_stack([x, x[:, 0] - x[:, 1]]))
    y = x[:, 0] - x[:, 1]
    got = {(r.a, r.b, r.operation): r for r in formula_components(Frame.of(df), "c6", names).collect()}
    signs = {"minus": np.subtract, "plus": np.add, "times": np.multiply}
    for i in range(6):
        r, n = plain(x[:, i], y)
        assert near(got[names[i], None, "same"].r, r) and got[names[i], None, "same"].n == n
        for j, (name, sign) in itertools.product(range(i + 1, 6), signs.items()):
            r, n = plain(sign(x[:, i], x[:, j]), y)
            row = got[names[i], names[j], name]
            assert row.n == n and near(row.r, r)
            assert row.component == (r is not None and abs(r) >= 0.995 and n >= 10)
    assert len(got) == 6 + 15 * 3
    parts = ingredients(Frame.of(df), {"c6": names[:2], "c0": names[4:6]})
    assert parts == {"c6": ["c0", "c1"], "c0": []}


@pytest.mark.parametrize("gap", [1e-5, 1e-9])
def test_terms_that_nearly_cancel(spark, gap):
    """A difference far smaller than its terms is looked at row by row."""
    rng = np.random.default_rng(2)
    a = rng.normal(size=500) * 1000
    small = np.round(rng.normal(size=500) * 1024) / 1024
    b = a + small * gap * 2**10
    df, names = table(spark, np.column_stack([a, b, small]))
    got = {r.operation: r for r in formula_components(Frame.of(df), "c2", names[:2]).collect() if r.b}
    r, _ = plain(a - b, small)
    assert near(got["minus"].r, r) and got["minus"].component == (abs(r) >= 0.995)


def test_empty_and_missing(spark):
    x = np.full((5, 3), np.nan)
    df, names = table(spark, x)
    assert [(r.r, r.n) for r in correlation_pairs(df, names).collect()] == [(None, 0)] * 3
    assert correlation_pairs(df, names[:1]).count() == 0
    assert not any(r.component for r in formula_components(Frame.of(df), "c0", names).collect())


def test_rows_are_not_repeated_per_formula(spark):
    """Formulas whose terms nearly cancel are worked out in batches, to the last digits."""
    from tabsonde.operators.moments import Formula, row_correlations

    rng = np.random.default_rng(5)
    a, e, y = rng.normal(1e6, 1e3, 4000), rng.normal(0, 1e-3, 4000), rng.normal(0, 1, 4000)
    b, y = a + e, y + 500 * e
    a[:50], y[50:90] = np.nan, np.inf
    df = spark.createDataFrame(
        [tuple(map(float, r)) for r in zip(y, a, b, strict=True)], "y double, a double, b double"
    ).repartition(7)
    asked = [Formula("y", "a", "b", o) for o in ("minus", "plus", "times")] * 50
    out = row_correlations(df, asked)
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["formula"]: (r["r"], r["n"]) for r in out.collect()}
    known = np.isfinite(a) & np.isfinite(y)
    for k, c in enumerate((a - b, a + b, a * b)):
        assert got[k] == got[k + 147]
        assert got[k][1] == 3910 and abs(got[k][0] - np.corrcoef(c[known], y[known])[0, 1]) < 1e-9
