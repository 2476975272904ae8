import numpy as np
import odd
import pytest
from tabsonde.llm.learning import BoostedTrees, Isotonic, Logistic, sigmoid
from tabsonde.llm.quality import keep_good_documents, score_quality

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def scored(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    unseen = labels.where("doc_id % 3 = 0")
    score = score_quality(docs, labels.where("doc_id % 3 != 0"))
    return score, unseen, docs, labels


def test_unseen_labels(scored):
    score, unseen, _, _ = scored
    rows = score.join(unseen, "doc_id").collect()
    right = sum(r.accepted == bool(r.quality) for r in rows) / len(rows)
    assert len(rows) > 100 and right > 0.95
    good = [r.accepted for r in rows if r.quality == 1]
    assert sum(good) / len(good) > 0.97


def test_kept_are_the_accepted(spark, scored):
    _, _, docs, labels = scored
    kept = keep_good_documents(docs, labels)
    assert kept.schema == docs.schema
    accepted = score_quality(docs, labels).where("accepted")
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in accepted.collect()}


def test_odd_documents(spark, scored):
    labels = scored[3]
    docs = odd.documents(spark).unionByName(scored[2], allowMissingColumns=True)
    rows = score_quality(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(0 <= s <= 1 for r in rows for s in r[1:4])
    kept = keep_good_documents(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.accepted for r in rows)


@pytest.mark.parametrize("columns", [("doc_id", "text"), ("doc_id", "text", "lang")])
def test_missing_columns(spark, columns):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select(*columns)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    assert score_quality(docs, labels).count() == docs.count()


def test_nothing_to_learn_from(spark):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    docs = odd.documents(spark)
    assert all(r.score == 1 and r.accepted for r in score_quality(docs, labels).collect())
    assert keep_good_documents(docs, labels).count() == docs.count()
    assert score_quality(odd.empty(spark), labels).collect() == []


def test_models():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 3))
    y = (rng.random(4000) < sigmoid(2 * x[:, 0] - x[:, 1])).astype(float)
    fitted = Logistic(1e-6).fit(x, y)
    slopes = fitted.weights[:3] / fitted.scale
    assert np.allclose(slopes, [2, -1, 0], atol=0.2)
    steps = Isotonic().fit(x[:, 0], y)
    values = steps(np.linspace(-3, 3, 50))
    assert (np.diff(values) >= 0).all() and values[0] < 0.15 and values[-1] > 0.85
    ring = ((x[:, 0] > 0) ^ (x[:, 2] > 0)).astype(float)
    trees = BoostedTrees().fit(x[:3000], ring[:3000])
    assert ((trees.margin(x[3000:]) > 0) == ring[3000:]).mean() > 0.95
