import math

import numpy as np
import pytest
from pyspark.sql import types as T
from tabsonde.llm.topk import nearest_pivot, needed_from, top_k

SCHEMA = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("cell", T.IntegerType()),
        T.StructField("v", T.StringType()),
    ]
)


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA).repartition(4)


def brute(rows, k=5, step=50):
    good = [
        (i, [math.floor(256 * float(np.float32(x))) for x in v])
        for i, v in rows
        if i is not None and v is not None
        and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q in sorted({i for i, _ in good if i % step == 0}):
        mine = min(v for i, v in good if i == q)
        scores = sorted(
            (-sum(a * b for a, b in zip(mine, v, strict=False)), i) for i, v in good if i != q
        )
        out += [(q, p + 1, i, -s) for p, (s, i) in enumerate(scores[:k])]
    return out


def got(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def clustered(n, seed=1, width=8, clusters=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, width)) * 20
    return [
        (k, (centres[k % clusters] + rng.normal(size=width) * 0.3).astype("f4").tolist())
        for k in range(n)
    ]


@pytest.mark.parametrize("sizes", [{}, {"pivots": 12, "group_queries": 3, "slice_rows": 100}])
def test_clusters(spark, sizes):
    rows = clustered(1500)
    assert got(top_k(table(spark, rows), **sizes)) == brute(rows)


def test_far_cells_are_not_needed():
    rows = clustered(1200)
    x = np.floor(256 * np.array([v for _, v in rows]))
    pivots = x[:24]
    cell, distance = nearest_pivot(x, pivots)
    near = [(c, d) for c in range(24) for d in np.sort(distance[cell == c])[:6]]
    near_cell, near = np.array([c for c, _ in near]), np.array([d for _, d in near])
    least = needed_from(x[::50], pivots, near_cell, near, 6)
    needed = least[:, cell] <= distance[None, :]
    assert needed.mean() < 0.5
    scores = x[::50] @ x.T
    for q in range(len(scores)):
        assert needed[q][np.argsort(-scores[q])[:6]].all()


def test_ties_copies_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    same = rng.normal(size=6).astype("f4").tolist()
    rows = [(k, same) for k in range(0, 700)]
    rows += [(k, rng.normal(size=6).astype("f4").tolist()) for k in range(700, 1000)]
    rows += [
        (None, same), (1050, None), (1100, [1.0, None, 2.0, 0.0, 0.0, 0.0]),
        (1150, [float("nan")] * 6), (1200, [float("inf")] * 6), (1250, [1.0, 2.0]),
        (1300, []), (50, same), (3, same), (3, same),
    ]
    assert got(top_k(table(spark, rows), slice_rows=128)) == brute(rows)


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(k, (rng.normal(size=4) * 3e5).astype("f4").tolist()) for k in range(120)]
    assert got(top_k(table(spark, rows))) == brute(rows)


def test_few_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])]
    assert got(top_k(table(spark, rows))) == brute(rows)
    assert got(top_k(table(spark, rows[:1]))) == []
    assert got(top_k(table(spark, rows[1:]))) == []
    empty = top_k(table(spark, []).limit(0))
    assert empty.collect() == []
    assert empty.columns == ["query_id", "rank", "vec_id", "score"]
