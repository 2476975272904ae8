import math
import random
import re
from collections import Counter

import odd
import pytest
from tabsonde.llm.ranked_search import ranked_search, terms_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    """(item, rank, id, score) by looking at every document for every item."""
    held = [(i, Counter(t)) for i, t in ((i, plain_terms(t)) for i, t in docs) if t]
    n, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    least = {}
    for item, text in items:
        if text is not None:
            least[item] = min(text, least.get(item, text))
    out = []
    for item, text in least.items():
        asked = Counter(plain_terms(text))
        scores = []
        for i, c in held:
            m = 25 + 75 * sum(c.values()) * n // length
            score = sum(
                q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
                for t, q in asked.items() if t in c
            )
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        scores.sort()
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(scores[:k])]
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


def items_of(spark, rows):
    schema = "item_id long, text string, doc_id long, score string, item int, n long, terms string"
    return spark.createDataFrame([(*r, 3, "x", 4, 5, "y") for r in rows], schema)


def zipf_documents(count, seed=3):
    """Few very frequent words, many rare ones, and many documents that tie."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    weights = [1 / (k + 1) for k in range(400)]
    texts = [" ".join(rng.choices(words, weights, k=rng.randint(1, 60))) for _ in range(count)]
    return [(k, texts[k // 3 if k % 2 else k]) for k in range(count)]


def test_terms():
    text = "A_b-Ünï漢\U0001f600 x9\x00Y\x7fz\n[q]{r}Ω\xa0s"
    assert [t.decode() for t in terms_of(text.encode())] == plain_terms(text)


@pytest.mark.parametrize("sizes", [{}, {"chunk_chars": 600, "block_postings": 300}, {"k": 3}])
def test_equals_brute_force(spark, sizes):
    docs = zipf_documents(1200)
    rng = random.Random(5)
    items = [
        (k, " ".join(rng.choices([f"w{j}" for j in range(420)], k=rng.randint(1, 30))))
        for k in range(25)
    ]
    items.append((25, "w0 W0 w1 w0 w399"))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = found(ranked_search(df, items_of(spark, items), **sizes))
    assert got == brute(docs, items, sizes.get("k", 10))


def test_word_of_every_document(spark):
    docs = [(k, "all the same") for k in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items = [(1, "all the same"), (2, "absent"), (3, "...")]
    assert found(ranked_search(df, items_of(spark, items))) == brute(docs, items)


def test_odd_documents(spark):
    docs = [r[:2] for r in odd.rows()]
    items = [
        (1, "the same text twice"), (2, None), (3, ""), (None, "repeated row"), (5, "WORD and ünïcödé"),
        (6, "one"), (6, "a text without an id"), (7, odd.LONG),
    ]
    got = found(ranked_search(odd.documents(spark), items_of(spark, items)))
    assert got == brute(docs, items)


def test_empty_tables(spark):
    some = items_of(spark, [(1, "one")])
    assert ranked_search(odd.empty(spark), some).count() == 0
    assert ranked_search(odd.documents(spark), some.limit(0)).count() == 0
