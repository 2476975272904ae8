import random

import numpy as np
import odd
import pytest
from tabsonde.llm import minhash
from tabsonde.llm.minhash import WordHashes, drop_similar, minhash_components, shingle_set, signature

SPACES = str.maketrans({c: " " for c in "\t\n\x0b\x0c\r"})
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_set(text, words=2):
    tokens = [w for w in (text or "").translate(SPACES).translate(LOWER).split(" ") if w]
    if not tokens:
        return frozenset()
    return frozenset(
        " ".join(tokens[k : k + words]) for k in range(max(1, len(tokens) - words + 1))
    )


def brute(rows, words=2):
    """(id, set size, component, kept) by comparing every pair."""
    sets = [plain_set(t, words) for _, t in rows]
    label = list(range(len(rows)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * min(len(a), len(b)) >= 80 * max(len(a), len(b)) and (
                a == b or 100 * len(a & b) >= 80 * len(a | b)
            ):
                label[root(i)] = root(j)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(k)] = min(doc_id, least.get(root(k), doc_id))
    out = []
    for k, (doc_id, _) in enumerate(rows):
        component = least.get(root(k)) if sets[k] else doc_id
        out.append((doc_id, len(sets[k]), component, doc_id == component))
    return sorted(out, key=repr)


def found(df):
    return sorted(
        ((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=repr
    )


def table(spark, rows, parts=4):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


def templated(count, shared, own, seed):
    """Texts of ``shared`` words in common and ``own`` of their own: a pair shares the former."""
    rng = random.Random(seed)
    base = [f"t{seed}x{k}" for k in range(shared)]
    return [
        " ".join(base + [f"o{seed}x{n}x{k}x{rng.random()}" for k in range(own)]) for n in range(count)
    ]


def near(text, changes, rng):
    """The text with its last words replaced."""
    words = text.split()
    return " ".join(words[: len(words) - changes] + [f"n{rng.random()}" for _ in range(changes)])


def dense_group(count, seed=7):
    """Texts at 0.76 of each other; each with one at 0.81, in no order."""
    rng = random.Random(seed)
    texts = templated(count // 2, 120, 19, seed)
    texts += [near(t, 12, rng) for t in texts]
    return texts


def test_jaccard_of_the_dense_group():
    texts = dense_group(40)
    a, b, c = (plain_set(t) for t in (texts[0], texts[1], texts[20]))
    assert 0.74 < len(a & b) / len(a | b) < 0.79 and 0.8 <= len(a & c) / len(a | c) < 0.86


@pytest.mark.parametrize("tile", [None, 16])
def test_links_inside_a_dense_group(spark, tile, monkeypatch):
    if tile:
        monkeypatch.setattr(minhash, "TILE_CLASSES", tile)
    rows = list(enumerate(dense_group(120) + templated(20, 60, 3, 9)))
    random.Random(1).shuffle(rows)
    expected = brute(rows)
    assert 50 < len({c for _, _, c, _ in expected}) < 100
    for parts in (2, 13):
        assert found(minhash_components(table(spark, rows, parts))) == expected


def test_recall_at_the_threshold(spark):
    """Pairs just above 0.8, none of them connected otherwise."""
    rng = random.Random(3)
    firsts = [" ".join(f"a{n}x{k}" for k in range(60)) for n in range(1500)]
    rows = list(enumerate(firsts + [near(t, 6, rng) for t in firsts]))
    a, b = plain_set(rows[0][1]), plain_set(rows[1500][1])
    assert 0.8 <= len(a & b) / len(a | b) < 0.83
    got = {r.doc_id: r.component_id for r in minhash_components(table(spark, rows)).collect()}
    linked = sum(got[n + 1500] == n for n in range(1500))
    assert linked >= 1498 and all(got[n] == n for n in range(1500))


def test_a_chain_and_copies(spark):
    rng = random.Random(4)
    chain = [" ".join(f"c{k}" for k in range(50))]
    for _ in range(12):
        chain.append(near(chain[-1], 4, rng) if rng.random() < 0.5 else chain[-1].upper())
        chain[-1] = " ".join(sorted(chain[-1].split(), key=lambda w: w.lower()))
    rows = [(k, t) for k, t in enumerate(chain * 30)]
    assert found(minhash_components(table(spark, rows))) == brute(rows)


def test_odd_documents(spark):
    rows = [r[:2] for r in odd.rows()]
    assert found(minhash_components(odd.documents(spark))) == brute(rows)


def test_other_shingles(spark):
    rows = [r[:2] for r in odd.rows()]
    assert found(minhash_components(odd.documents(spark), words=5)) == brute(rows, 5)


def test_empty_table(spark):
    assert minhash_components(odd.empty(spark)).count() == 0
    assert drop_similar(odd.empty(spark)).columns == odd.empty(spark).columns


def test_dropping_keeps_columns(spark):
    docs = odd.documents(spark)
    kept = drop_similar(docs)
    assert kept.columns == docs.columns
    expected = {i for i, _, _, k in brute([r[:2] for r in odd.rows()]) if k}
    assert {r.doc_id for r in kept.collect()} == expected


def test_coordinates_estimate_the_similarity():
    """Shifts of one permutation agree as often as sets are similar, small sets too."""
    kept = WordHashes()
    rng = random.Random(5)
    for size, own in ((40, 5), (400, 44), (4, 1)):
        agree = []
        for n in range(300):
            base = [f"s{n}x{k}" for k in range(size)]
            a, b = (
                shingle_set(" ".join(base + [f"{rng.random()}" for _ in range(own)]), 1, kept)
                for _ in range(2)
            )
            agree.append((signature(a, 125) == signature(b, 125)).mean())
        expected = size / (size + 2 * own)
        assert abs(np.mean(agree) - expected) < 0.02
        # As independent coordinates would scatter, or less.
        assert np.std(agree) < 1.25 * (expected * (1 - expected) / 125) ** 0.5
