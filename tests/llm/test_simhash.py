import numpy as np
import odd
import pytest
import xxhash
from tabsonde.llm.components import components
from tabsonde.llm.simhash import drop_near_duplicates, links_within, near_duplicates


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest_reachable(prints, radius=3):
    """Component by flooding, over all pairs."""
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i in range(len(prints)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= radius and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def test_odd_documents(spark):
    rows = [r[:2] for r in odd.rows()]
    prints = [plain_fingerprint(t) for _, t in rows]
    label = smallest_reachable(prints)
    ids = {}
    for (doc_id, _), k in zip(rows, label, strict=True):
        if doc_id is not None:
            ids[k] = min(ids.get(k, doc_id), doc_id)
    expected = sorted(
        (str(d), f"{p:016x}", str(ids.get(k)))
        for (d, _), p, k in zip(rows, prints, label, strict=True)
    )
    found = near_duplicates(odd.documents(spark)).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in found) == expected


@pytest.mark.parametrize("radius", [3, 1])
def test_every_link_is_found(spark, radius):
    rng = np.random.default_rng(8)
    prints = [int(x) for x in rng.integers(0, 1 << 62, 300)]
    for k in range(0, 250):  # chains of few flipped bits, some across tiles of counts
        flips = rng.choice(64, rng.integers(1, 5), replace=False)
        prints.append(prints[int(rng.integers(len(prints)))] ^ sum(1 << int(f) for f in flips))
    prints = sorted({p % (1 << 64) for p in prints})
    df = spark.createDataFrame([(p - (p >> 63 << 64),) for p in prints], "fp long")
    roots = {r.node: r.root for r in components(links_within(df, radius)).collect()}
    got = [roots.get(p - (p >> 63 << 64), p - (p >> 63 << 64)) for p in prints]
    label = smallest_reachable(prints, radius)
    pairs = {(a, b) for a, b in zip(got, label, strict=True)}
    assert len(pairs) == len(set(got)) == len(set(label))
    linked = len(prints) - len(set(label))
    assert linked > (20 if radius == 1 else 100)


def test_large_group_of_near_copies(spark):
    rows = [(k, " ".join(f"w{j}" for j in range(300)) + f" end{k}") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_duplicates(df).collect()
    assert {r.component_id for r in found} == {0}
    assert [r.doc_id for r in drop_near_duplicates(df).collect()] == [0]


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)]
    links += [(7, 7), (3, 2), (200, 201), (201, 200)]
    df = spark.createDataFrame(links, "a long, b long")
    roots = {r.node: r.root for r in components(df).collect()}
    assert {roots[k] for k in range(41)} == {0}
    assert {roots[k] for k in range(100, 160)} == {100}
    assert roots[200] == roots[201] == 200


def test_empty_table(spark):
    assert near_duplicates(odd.empty(spark)).collect() == []
    assert drop_near_duplicates(odd.empty(spark)).collect() == []
