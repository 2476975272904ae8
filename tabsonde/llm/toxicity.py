"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned: words and beginnings of words that documents labelled toxic hold and
others do not, counted in Spark over a bounded sample of labelled documents. The features that
the trees are fitted on come from lexicons of the other folds, so that no document is described
by entries it has made itself. Scoring reads every whole text; language, source, ids and labels
are no inputs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .common import hashed_sample, small_batches, stage, text_of
from .learning import BoostedTrees, Isotonic

#: Bound of the sample of labelled rows that everything is fitted on.
LABELLED_ROWS = 30_000
#: Folds of the sample; those from TREE_FOLDS on calibrate instead of fitting the trees.
FOLDS, TREE_FOLDS = 8, 6
#: A strong and a weak entry: (toxic - 1) / documents and toxic documents are so many at least.
STRONG, STRONG_DOCUMENTS = 0.7, 4
WEAK, WEAK_DOCUMENTS = 0.35, 6
ENTRIES = 20_000
BEGINNINGS = (4, 5, 6, 7)
THRESHOLD = 0.3
#: Words between an entry and a second person that still count as near.
NEAR_WORDS = 5
HELD_OUT_PARTS, HELD_OUT = 4, 2

#: Words for the person spoken to, in four languages.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen ihr euch tu te toi ton ta tes "
    "vous votre vos tú ti tus usted ustedes vosotros os".split()
)
#: Characters that stand for letters in masked words.
MASKS = str.maketrans("013457@$!", "oieastasi")
EDGES = ".,;:!?\"'()[]{}*#%&$-_|<>«»¿¡…"
REPEATED = re.compile(r"(\w)\1\1")


def words_of(text: str) -> list[str]:
    return [w for w in (t.strip(EDGES) for t in text.lower().split()) if w]


def units_of(words: list[str]) -> set[str]:
    """Words, and beginnings of longer words marked by a hyphen."""
    distinct = set(words)
    return distinct | {
        w[:k] + "-" for w in distinct for k in BEGINNINGS if len(w) > k
    }


class Lexicon:
    """Looks words up; what a word came to is kept for the next time, within bounds."""

    KEPT = 500_000

    def __init__(self, entries: dict[str, int]):
        self.entries = entries
        self.seen: dict[str, tuple[int, bool]] = {}

    def _level(self, word: str) -> int:
        levels = [self.entries.get(word[:k] + "-", 0) for k in BEGINNINGS if len(word) > k]
        return max([self.entries.get(word, 0), *levels])

    def look_up(self, word: str) -> tuple[int, bool]:
        """How strongly the word is in the lexicon (0 to 2), and whether only after unmasking."""
        found = self.seen.get(word)
        if found is None:
            level = self._level(word)
            masked = not level and not word.isalpha()
            if masked:
                level = self._level(word.translate(MASKS))
            found = (level, masked and level > 0)
            if len(self.seen) >= self.KEPT:
                self.seen.clear()
            self.seen[word] = found
        return found


def features(text: str, lexicon: Lexicon) -> list[float]:
    """Dense rates of a text; an empty one has zeros."""
    words = words_of(text)
    n = max(len(words), 1)
    found = list(map(lexicon.look_up, words))
    hits = [k for k, (level, _) in enumerate(found) if level == 2]
    weak = sum(level == 1 for level, _ in found)
    persons = np.array([k for k, w in enumerate(words) if w in SECOND_PERSON], np.int64)
    near = 0
    if len(persons) and hits:
        at = np.array(hits, np.int64)
        right = np.searchsorted(persons, at)
        after = np.abs(persons[np.minimum(right, len(persons) - 1)] - at)
        before = np.abs(at - persons[np.maximum(right - 1, 0)])
        near = int((np.minimum(after, before) <= NEAR_WORDS).sum())
    raw = text.encode("utf-8", "surrogatepass")
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = max(len(raw), 1)
    letters = max(seen[65:91].sum() + seen[97:123].sum(), 1)
    marks = seen[33:48].sum() + seen[58:65].sum() + seen[91:97].sum() + seen[123:127].sum()
    mixed = sum(not w.isalpha() for w in words)
    return [
        len(hits) / n,
        float(len(hits)),
        float(len({words[k] for k in hits})),
        weak / n,
        float(weak),
        sum(masked for _, masked in found) / n,
        near / n,
        len(persons) / n,
        seen[65:91].sum() / letters,
        sum(map(str.isupper, text.split())) / n,
        seen[33] / size,
        marks / size,
        mixed / n,
        len(REPEATED.findall(text)) / n,
        float(np.log1p(len(words))),
    ]


@dataclass
class Scorer:
    """What is fitted: entries of the lexicon, trees, calibration."""

    entries: dict[str, int]
    trees: BoostedTrees
    steps: Isotonic

    def __call__(self, texts: list[str], lexicon: Lexicon) -> np.ndarray:
        x = np.array([features(t, lexicon) for t in texts], float)
        return np.clip(self.steps(self.trees.margin(x)), 0, 1)


def _entries(units: list[Row], without: int | None = None) -> dict[str, int]:
    """Entries and how strong they are, as the folds other than ``without`` have them."""
    made = {}
    for r in units:
        n, toxic = sum(r["n"]), sum(r["toxic"])
        if without is not None:
            n, toxic = n - r["n"][without], toxic - r["toxic"][without]
        if toxic >= STRONG_DOCUMENTS and toxic - 1 >= STRONG * n:
            made[r["unit"]] = 2
        elif toxic >= WEAK_DOCUMENTS and toxic - 1 >= WEAK * n:
            made[r["unit"]] = 1
    return made


def _units(sample: DataFrame) -> list[Row]:
    """Counts by fold of what may be an entry in ``sample`` (text, toxic, fold)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, toxic = Counter(), Counter()
        for batch in batches:
            columns = (batch[c].to_pylist() for c in ("text", "toxic", "fold"))
            for text, label, fold in zip(*columns, strict=True):
                units = [(u, fold) for u in units_of(words_of(text))]
                total.update(units)
                if label:
                    toxic.update(units)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([u for u, _ in total], pa.string()),
                pa.array([f for _, f in total], pa.int32()),
                pa.array(list(total.values()), pa.int64()),
                pa.array([toxic[k] for k in total], pa.int64()),
            ],
            ["unit", "fold", "n", "toxic"],
        )

    by_fold = sample.select("text", "toxic", "fold").mapInArrow(
        count, "unit string, fold int, n long, toxic long"
    )
    sums = {
        c: F.array(*[F.sum(F.when(F.col("fold") == k, F.col(c)).otherwise(0)) for k in range(FOLDS)])
        for c in ("n", "toxic")
    }
    all_n, all_toxic = F.sum("n").alias("all_n"), F.sum("toxic").alias("all_toxic")
    units = by_fold.groupBy("unit").agg(
        *[v.alias(c) for c, v in sums.items()], all_n, all_toxic
    )
    units = units.where(F.col("all_toxic") >= STRONG_DOCUMENTS).where(
        F.col("all_toxic") >= WEAK * F.col("all_n")
    )
    return units.orderBy(F.col("all_toxic").desc(), "unit").limit(ENTRIES).collect()


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> Scorer | None:
    """Fit on at most LABELLED_ROWS labelled documents that are not held out.

    ``labels`` has doc_id and toxic (0 or 1); other values and nulls are passed over, a
    document labelled both ways counts as toxic. None if a class has too few rows.
    """
    small_batches(docs.sparkSession)
    known = (
        labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL")
        .where(~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("label_id"))
        .agg(F.max("toxic").alias("toxic"))
    )
    fold = F.pmod(F.xxhash64("label_id", F.lit("fold")), F.lit(FOLDS)).cast("int")
    sample = hashed_sample(known, "label_id", LABELLED_ROWS).withColumn("fold", fold)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    rows = texts.join(F.broadcast(sample), F.col("doc_id") == F.col("label_id"))
    rows = stage(rows.select("text", "toxic", "fold"), "labelled")
    units = _units(rows)
    by_fold = [_entries(units, k) for k in range(FOLDS)]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicons = [Lexicon(e) for e in by_fold]
        for batch in batches:
            pairs = zip(batch["text"], batch["fold"].to_pylist(), strict=True)
            x = [features(t.as_py(), lexicons[f]) for t, f in pairs]
            yield pa.RecordBatch.from_arrays(
                [batch["toxic"], batch["fold"], pa.array(x, pa.list_(pa.float64()))],
                ["toxic", "fold", "x"],
            )

    made = rows.mapInArrow(measure, "toxic int, fold int, x array<double>")
    made = made.orderBy("x", "toxic").limit(2 * LABELLED_ROWS).toArrow()
    y = made["toxic"].to_numpy().astype(float)
    fits = made["fold"].to_numpy() < TREE_FOLDS
    enough = [(y[part] == v).sum() >= 2 for part in (fits, ~fits) for v in (0, 1)]
    if not len(y) or not all(enough):
        return None
    x = made["x"].combine_chunks().flatten().to_numpy().reshape(len(y), -1)
    trees = BoostedTrees().fit(x[fits], y[fits])
    steps = Isotonic().fit(trees.margin(x[~fits]), y[~fits])
    return Scorer(_entries(units), trees, steps)


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_PARTS == HELD_OUT


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``.

    The score is the calibrated probability of label 1. A null text counts as empty, an empty
    one is scored like any other; a null id is not held out. Without enough labels every score
    is 0. Repeated rows score alike.
    """
    model = fit_toxicity(docs, labels, id_col, text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.entries if model else {})
        for batch in batches:
            made = np.zeros(batch.num_rows)
            if model and batch.num_rows:
                made = model(batch["text"].to_pylist(), lexicon)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(made)], ["doc_id", "score"]
            )

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return texts.mapInArrow(score, "doc_id long, score double").select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
