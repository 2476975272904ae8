import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabsonde.llm.exact_dedup import exact_duplicates
from tabsonde.llm.quality import score_quality
from tabsonde.llm.simhash import near_duplicates

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def passed(spark, tmp_path_factory):
    """What each stage leaves, written and read as the next one's input."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out, folder = [docs], tmp_path_factory.mktemp("stages")
    for k, (_, function) in enumerate(corpus_pipeline.STAGES):
        function(spark, out[-1], FOLDER).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return out


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_columns(passed):
    assert all(p.columns == passed[0].columns for p in passed[:-1])


def test_quality_stage(spark, passed):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    accepted = score_quality(passed[0], labels).where("accepted")
    assert ids(passed[1]) == ids(accepted)
    good = labels.where("quality = 1")
    lost = good.join(passed[1], "doc_id", "left_anti").count()
    assert lost <= 0.01 * good.count()


def test_exact_stage(passed):
    assert ids(passed[2]) == ids(exact_duplicates(passed[1]).where("kept"))


def test_near_stage(passed):
    groups = near_duplicates(passed[2]).groupBy("component_id").count()
    assert ids(passed[3]) == sorted(r.component_id for r in groups.collect())


def test_mixing_stage(passed):
    assert set(ids(passed[4])) == set(ids(passed[3]))
    most = passed[4].groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert most <= 2


def test_packing_stage(passed):
    rows = passed[5].collect()
    assert {r.doc_id for r in rows} == set(ids(passed[4]))
    assert sum(r.piece == 0 for r in rows) == passed[4].count()
    tokens = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= -(-tokens // 2048) + 1


def test_run_equals_the_stages(spark, passed):
    # Rows that repeat stand in any order inside a sequence, the pieces are the same.
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    whole = corpus_pipeline.run(spark, FOLDER).select(columns)
    assert whole.exceptAll(passed[5].select(columns)).count() == 0
    assert whole.count() == passed[5].count()
