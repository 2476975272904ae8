from math import exp, log

import odd
import pytest
from pyspark.sql import functions as F
from tabsonde.llm.mixing import exponent, mix

SIZES = {"a": 4000, "b": 900, "c": 300, None: 60}


@pytest.fixture(scope="module")
def docs(spark):
    rows, k = [], 0
    for source, n in SIZES.items():
        for _ in range(n):
            rows.append((k, " ".join(["w"] * (1 + k % 7)), source))
            k += 1
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)


def tokens(rows):
    out = {}
    for r in rows:
        out[r.source] = out.get(r.source, 0) + len(r.text.split())
    return out


def test_no_document_is_lost_and_repeats_are_limited(docs):
    rows = mix(docs, max_repeats=2.0).collect()
    times = {}
    for r in rows:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert set(times) == set(range(sum(SIZES.values())))
    assert max(times.values()) <= 2 and 1 in times.values()
    before, after = tokens(docs.collect()), tokens(rows)
    weight = {r.source: (r.mix_weight, r.mix_repeats) for r in rows}
    total = sum(after.values())
    for source, (share, repeats) in weight.items():
        assert after[source] / before[source] == pytest.approx(repeats, abs=0.02)
        assert after[source] / total == pytest.approx(share, abs=0.01)
    # The smallest source stands at the limit, the largest runs through once.
    assert weight[None][1] == pytest.approx(2.0, abs=1e-5)
    assert weight["a"][1] == pytest.approx(1.0, abs=1e-6)


def test_blocks_hold_the_weights(docs):
    rows = mix(docs, max_repeats=3.0, blocks=4).collect()
    for block in range(4):
        held = tokens([r for r in rows if r.mix_block == block])
        whole = tokens(rows)
        for source in ("a", "b", "c"):
            assert held[source] / whole[source] == pytest.approx(0.25, abs=0.05)


def test_budget_is_kept(docs):
    rows = mix(docs, max_repeats=1.0, budget_tokens=10_000).collect()
    total = sum(tokens(rows).values())
    assert 9_900 <= total <= 10_000


def test_entropy_target(docs):
    rows = mix(docs, target_entropy=1.0).collect()
    weights = {r.source: r.mix_weight for r in rows}.values()
    assert -sum(w * log(w) for w in weights) == pytest.approx(1.0, abs=1e-4)


def test_exponent_against_bisection(spark):
    shares = [0.7, 0.2, 0.06, 0.04]
    df = spark.createDataFrame([(s,) for s in shares], "share double")

    def entropy(t):
        z = sum(s**t for s in shares)
        return -sum(s**t / z * log(s**t / z) for s in shares)

    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if entropy(mid) <= 1.1 else (mid, high)
    assert exponent(df, 1.1, entropy=True) == pytest.approx(high, abs=1e-6)
    # min share / max share to the power of (t - 1) is 3
    assert exponent(df, 3.0) == pytest.approx(1 - log(3) / log(0.7 / 0.04), abs=1e-6)
    assert exponent(df.limit(0), 3.0) == 1.0
    assert exp(entropy(0)) == pytest.approx(4)


def test_odd_documents(spark):
    docs = odd.documents(spark)
    rows = mix(docs)
    assert rows.columns[: len(docs.columns)] == docs.columns
    counts = {r.doc_id: r["count"] for r in rows.groupBy("doc_id").count().collect()}
    expected = {r[0] for r in odd.rows()}
    assert set(counts) == expected and counts[10] % 2 == 0
    assert mix(odd.empty(spark)).collect() == []


def test_the_same_on_every_run(docs):
    one = mix(docs).agg(F.sum(F.xxhash64("doc_id", "mix_epoch", "mix_block").cast("decimal(38)")))
    two = mix(docs.repartition(3)).agg(
        F.sum(F.xxhash64("doc_id", "mix_epoch", "mix_block").cast("decimal(38)"))
    )
    assert one.first()[0] == two.first()[0]
