from collections import Counter
from math import exp, lgamma, log, log10, pi

import numpy as np
import odd
import pytest
from tabsonde.llm import lm_score
from tabsonde.llm.lm_score import Held, is_held_out, language_scores, words_of


class PlainTree:
    """Context-tree weighting by recursion over nested dictionaries."""

    def __init__(self, texts, depth):
        self.depth = depth
        self.counts = Counter()
        for text in texts:
            for bits, context in self.decisions(text):
                node, bit = bits[:-1], bits[-1]
                for d in range(depth + 1):
                    self.counts[context[:d], node, bit] += 1
        self.children = {}
        for context, node, _ in list(self.counts):
            if context:
                self.children.setdefault((context[:-1], node), set()).add(context)
        self.known = {}

    def decisions(self, text):
        padded = b"\n" * self.depth + text
        for k in range(self.depth, len(padded)):
            context = tuple(padded[k - d - 1] for d in range(self.depth))
            bits = tuple(padded[k] >> (7 - b) & 1 for b in range(8))
            for b in range(8):
                yield bits[: b + 1], context

    def ln_kt(self, context, node):
        a, b = self.counts[context, node, 0], self.counts[context, node, 1]
        return lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1) - log(pi)

    def ln_w(self, context, node):
        if (context, node) not in self.known:
            own = self.ln_kt(context, node)
            if len(context) < self.depth:
                below = sum(self.ln_w(c, node) for c in self.children.get((context, node), ()))
                own = log(0.5) + max(own, below) + log(1 + exp(-abs(own - below)))
            self.known[context, node] = own
        return self.known[context, node]

    def probability(self, context, node, bit, d=0):
        here = context[:d]
        a, b = self.counts[here, node, 0], self.counts[here, node, 1]
        kt = ((b if bit else a) + 0.5) / (a + b + 1)
        if d == self.depth:
            return kt
        if not a + b:
            return 0.5
        weight = exp(log(0.5) + self.ln_kt(here, node) - self.ln_w(here, node))
        return weight * kt + (1 - weight) * self.probability(context, node, bit, d + 1)

    def log10(self, text):
        return sum(
            log10(self.probability(context, bits[:-1], bits[-1]))
            for bits, context in self.decisions(text)
        )


def texts():
    rng = np.random.default_rng(6)
    vocabulary = ["the", "tha", "cat", "Sat", "on", "mat", "über", "a", "rat", "ran"]
    out = []
    for k in range(60):
        n = int(rng.integers(0, 9))
        out.append((k, "  ".join(rng.choice(vocabulary, n)) + ("\n" if k % 2 else "")))
    return [*out, (60, None), (61, ""), (61, ""), (None, "the cat"), (62, "unseen wörds zzz")]


def check(df, rows, depth):
    joined = [b" ".join(words_of(t or "")) + b"\n" for _, t in rows]
    trains = [not is_held_out(d) for d, _ in rows]
    tree = PlainTree([t for t, learns in zip(joined, trains, strict=True) if learns], depth)
    words = Counter()
    for text, learns in zip(joined, trains, strict=True):
        if learns:
            words.update([*text.split(), b"\n"])
    total, kinds = sum(words.values()), len(words)
    expected = []
    for (doc_id, _), text, learns in zip(rows, joined, trains, strict=True):
        own = [*text.split(), b"\n"]
        base = sum(log10((words[w] + 1) / (total + kinds + 1)) for w in own)
        known = sum(words[w] > 0 for w in own)
        expected.append((str(doc_id), not learns, len(own), known, base, tree.log10(text)))
    found = sorted(
        (str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.base_score, r.score, r.train_tokens)
        for r in df.collect()
    )
    assert len(found) == len(expected)
    for ours, theirs in zip(found, sorted(expected), strict=True):
        assert ours[:4] == theirs[:4] and ours[6] == total
        assert ours[4:6] == pytest.approx(theirs[4:6], rel=1e-6, abs=1e-6)


@pytest.mark.parametrize("depth", [4, 6])
def test_against_recursion(spark, depth):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    check(language_scores(df, depth=depth), rows, depth)


def test_what_is_not_held_is_joined(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "HELD_STRINGS", 20)
    monkeypatch.setattr(lm_score, "HELD_WORDS", 3)
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(language_scores(df, depth=4), rows, 4)


def test_small_portions(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "PORTION_BYTES", 37)
    monkeypatch.setattr(lm_score, "SUBTREE_BYTES", 16)
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(language_scores(df, depth=4), rows, 4)


def test_probabilities_add_up():
    rows = [b"abcabd\n", b"abd\n", b"xab\n"]
    tree = PlainTree(rows, 4)
    context = tuple(b"baba")
    total = 0.0
    for byte in range(256):
        bits = tuple(byte >> (7 - b) & 1 for b in range(8))
        p = 1.0
        for b in range(8):
            p *= tree.probability(context, bits[:b], bits[b])
        total += p
    assert total == pytest.approx(1.0)


def test_held_table():
    rng = np.random.default_rng(7)
    keys = np.unique(rng.integers(0, 1 << 56, 5000))
    held = Held(keys[::2], np.arange(len(keys[::2]), dtype=float))
    values, missing = held.look_up(keys)
    assert missing[1::2].all() and (values[1::2] == 0).all()
    found = ~missing[::2]
    assert found.mean() > 0.99
    assert (values[::2][found] == np.arange(len(keys[::2]))[found]).all()


def test_model_beats_single_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    row = (
        language_scores(docs)
        .where("held_out")
        .selectExpr("sum(score) AS score", "sum(base_score) AS base", "count(*) AS n")
        .first()
    )
    assert row.n > 1000 and row.score > row.base


def test_odd_documents(spark):
    rows = language_scores(odd.documents(spark)).collect()
    assert len(rows) == len(odd.rows())
    assert all(np.isfinite(r.score) and r.score < 0 and r.n_bytes > 0 for r in rows)
    assert language_scores(odd.empty(spark)).collect() == []
