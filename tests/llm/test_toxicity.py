import zlib

import odd
import pytest
from tabsonde.llm.toxicity import Lexicon, features, score_toxicity, units_of, words_of


@pytest.fixture(scope="module")
def tables(spark):
    folder = "/root/testdata/sf0.1"
    return (
        spark.read.parquet(f"{folder}/documents.parquet"),
        spark.read.parquet(f"{folder}/labels.parquet"),
    )


def test_held_out_accuracy(tables):
    docs, labels = tables
    score = score_toxicity(docs, labels)
    assert score.count() == docs.count()
    rows = score.join(labels, "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.predicted == int(r.score >= 0.3)
    unseen = [r for r in rows if r.held_out]
    toxic = [r for r in unseen if r.toxic == 1]
    clean = [r for r in unseen if r.toxic == 0]
    assert sum(r.predicted for r in toxic) / len(toxic) > 0.9
    assert sum(r.predicted for r in clean) / len(clean) < 0.02
    # Calibrated: the mean score is near the share of toxic documents.
    mean = sum(r.score for r in unseen) / len(unseen)
    assert mean == pytest.approx(len(toxic) / len(unseen), abs=0.06)


def test_labels_of_held_out_rows_change_nothing(spark, tables):
    docs, labels = tables
    docs = docs.where("doc_id < 4000")
    labels = labels.where("doc_id < 4000")
    turned = labels.selectExpr(
        "doc_id", "quality", "if(crc32(cast(doc_id AS string)) % 4 = 2, 1 - toxic, toxic) AS toxic"
    )
    one = {r.doc_id: r.score for r in score_toxicity(docs, labels).collect()}
    two = {r.doc_id: r.score for r in score_toxicity(docs, turned).collect()}
    assert one == two


def test_odd_documents(spark, tables):
    labels = tables[1]
    docs = odd.documents(spark)
    both = tables[0].where("doc_id < 2000").unionByName(docs, allowMissingColumns=True)
    rows = score_toxicity(both, labels).collect()
    assert len(rows) == both.count()
    assert all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
    none = spark.createDataFrame([(1, None), (None, 1), (2, 5)], "doc_id long, toxic int")
    assert {r.score for r in score_toxicity(docs, none).collect()} == {0.0}
    assert score_toxicity(odd.empty(spark), none).collect() == []


def test_features():
    lexicon = Lexicon({"idiot": 2, "scum": 1, "lowei-": 2})
    plain = features("A calm text.", lexicon)
    assert features("", lexicon)[:9] == [0.0] * 9
    assert plain[:3] == [0.0] * 3
    assert features("you idiot", lexicon)[0] == 0.5
    assert features("you id1ot", lexicon)[5] == 0.5  # masked
    assert features("you idiot", lexicon)[6] > 0  # near a second person
    far = "you " + "word " * 30 + "idiot"
    assert features(far, lexicon)[6] == 0
    assert features("loweischaft", lexicon)[0] == 1.0
    assert features("scum", lexicon)[3:5] == [1.0, 1.0]
    assert "idio-" in units_of(words_of("Idiots!")) and "idiots" in units_of(words_of("Idiots!"))
