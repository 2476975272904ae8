import math

import numpy as np
import pytest
from pyspark.sql import types as T
from tabsonde.llm.hard_negatives import Columns, hard_negatives, least_negative, scan

SCHEMA = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.DoubleType())),
        T.StructField("label", T.IntegerType()),
        T.StructField("v", T.StringType()),
        T.StructField("slice", T.IntegerType()),
        T.StructField("part", T.StringType()),
        T.StructField("place", T.IntegerType()),
    ]
)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA).repartition(4)


def brute(rows, step=100):
    good = [
        (i, label, [math.floor(256 * x) for x in v])
        for i, v, label in rows
        if i is not None and label is not None and v is not None
        and all(x is not None and math.isfinite(x) for x in v)
    ]
    asked = {}
    for i, label, v in good:
        if i % step == 0:
            asked[i] = min((label, v), asked.get(i, (label, v)))
    out = []
    for anchor, (label, q) in asked.items():
        scores = sorted(
            (-sum(a * b for a, b in zip(q, v, strict=False)), i, own)
            for i, own, v in good if i != anchor
        )
        positives = [(-s, i) for s, i, own in scores if own == label][:5]
        negatives = [(-s, i) for s, i, own in scores if own != label]
        for p, positive in positives:
            inside = [x for x in negatives if 80 * p <= 100 * x[0] <= 100 * p][:5]
            out += [(anchor, positive, r + 1, i, p, s) for r, (s, i) in enumerate(inside)]
    return sorted(out)


def found(df):
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def vectors(n, seed=1, width=12, coarse=False):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    x = centres[rng.integers(0, 6, n)] + rng.normal(size=(n, width)) * 0.4
    if coarse:  # many equal scores
        x = np.round(x)
    return [(k, v.tolist(), int(rng.integers(0, 4))) for k, v in enumerate(x)]


@pytest.mark.parametrize("coarse", [False, True])
@pytest.mark.parametrize("sizes", [{}, {"group_anchors": 3, "slice_rows": 150}])
def test_equals_brute_force(spark, coarse, sizes):
    rows = vectors(1500, coarse=coarse)
    got = found(hard_negatives(table(spark, rows), **sizes))
    assert got == brute(rows) and got


def test_the_scan_drops_rows_early():
    rng = np.random.default_rng(2)
    x = rng.integers(-9, 10, (400, 16)) * np.array([400] * 4 + [1] * 12)
    anchor = x[0] + 1
    looked = []

    class Watched(Columns):
        def __init__(self, x):
            super().__init__(x)
            self.kept = self.x
            self.x = self

        shape = (16, 400)

        def __getitem__(self, d):
            column = self.kept[d]
            return Column(column)

    class Column(np.ndarray):
        def __new__(cls, values):
            return values.view(cls)

        def __getitem__(self, rows):
            if isinstance(rows, np.ndarray):
                looked.append(len(rows))
            return np.asarray(self)[rows]

    rows, scores = scan(Watched(x), anchor, np.arange(400), [(None, None)], 5, stride=2)
    whole = x @ anchor
    best = np.sort(whole)[-5:]
    assert set(best) <= set(scores) and (whole[rows] == scores).all()
    assert looked[-1] < 40


def test_least_negative():
    for p in range(-300, 300):
        assert 80 * p <= 100 * least_negative(p) < 80 * p + 100


def test_odd_rows(spark):
    rows = vectors(300, width=4)
    rows += [
        (None, [1.0] * 4, 1), (301, None, 1), (302, [1.0, None, 1.0, 1.0], 1), (303, [1.0] * 4, None),
        (304, [math.nan] * 4, 1), (305, [math.inf] * 4, 1), (306, [], 1), (307, [2.0], 2),
        (200, [0.5] * 4, 0), (0, [-1.0] * 4, 3), (5, [1.0] * 4, 2), (5, [1.0] * 4, 2),
        (400, [0.0] * 4, 1), (500, [1.0] * 4, 77), (-100, [0.3] * 4, 1),
    ]
    assert found(hard_negatives(table(spark, rows))) == brute(rows)


def test_equal_rows_tie_by_id(spark):
    rows = [(k, [1.0, 2.0], k % 2) for k in range(230)]
    assert found(hard_negatives(table(spark, rows), slice_rows=40)) == brute(rows)


def test_numbers_beyond_64_bits_do_not_fail(spark):
    rows = [(k, [1e12 * (k + 1), -1e12], k % 2) for k in range(120)]
    assert hard_negatives(table(spark, rows)).count() >= 0


def test_empty_table(spark):
    assert hard_negatives(table(spark, [])).count() == 0
    assert hard_negatives(table(spark, [(1, [1.0], 1)])).count() == 0
    assert hard_negatives(table(spark, [(0, [], 1)])).count() == 0
