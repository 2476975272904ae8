"""A quality classifier by co-training of two views.

One logistic classifier sees what the text is like, the other what the page's columns say
(language, source, length). Over rounds each gives the other the rows of an unlabelled pool
that it is confident of. The calibrated views are then combined and score every document.
Fitting uses bounded samples of labelled and unlabelled rows; scoring reads every whole text.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample, small_batches, text_of
from .learning import Logistic, logit, sigmoid

#: Bounds of the samples that the classifiers are fitted on.
LABELLED_ROWS = 20_000
POOL_ROWS = 10_000
ROUNDS = 4
#: What a view must be sure of to hand a row to the other, and how many rows of a class a round.
CONFIDENT = 0.97
EXCHANGED = 500
#: Share of the labelled sample that calibrates instead of fitting.
CALIBRATION_SHARE = 0.3
SOURCE_BUCKETS = 64
LANG_BUCKETS = 16
#: Documents that score less are rejected.
THRESHOLD = 0.5


def text_features(text: str) -> list[float]:
    """What a text is like; all rates, so that any length gives finite numbers."""
    raw = text.encode("utf-8", "surrogatepass")
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = max(len(raw), 1)
    upper, lower = seen[65:91].sum(), seen[97:123].sum()
    digits = seen[48:58].sum()
    usual = seen[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]].sum()  # ! " ' ( ) , - . : ; ?
    marks = seen[33:48].sum() + seen[58:65].sum() + seen[91:97].sum() + seen[123:127].sum()
    words = text.split()
    n = max(len(words), 1)
    counts = Counter(words)
    lines = text.split("\n")
    repeats = sum(map(eq, words, words[1:]))
    top = max(counts.values(), default=0)
    total = sum(map(len, words))
    return [
        np.log1p(len(words)),
        total / n,
        upper / max(upper + lower, 1),
        digits / size,
        usual / size,
        (marks - usual) / size,
        seen[33] / size,
        seen[124] / size,
        seen[128:].sum() / size,
        len(counts) / n,
        np.log1p(len(counts)) / np.log1p(n),
        top / n,
        repeats / n,
        sum(map(str.isupper, words)) / n,
        sum(not w[-1].isalnum() for w in words) / n,
        1 - len(set(lines)) / max(len(lines), 1),
        np.log1p(size / len(lines)),
        float(not words),
    ]


def metadata_features(lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
    """Hashed indicators of language and source (null is a value of its own) and the length."""
    source, lang = (c if c is None else str(c) for c in (source, lang))
    row = [0.0] * (SOURCE_BUCKETS + LANG_BUCKETS)
    row[zlib.crc32(repr(source).encode()) % SOURCE_BUCKETS] = 1.0
    row[SOURCE_BUCKETS + zlib.crc32(repr(lang).encode()) % LANG_BUCKETS] = 1.0
    size = np.log1p(max(n_chars or 0, 0))
    return [*row, size, size * size, float(n_chars is None)]


def _metadata(table: pa.RecordBatch | pa.Table) -> np.ndarray:
    columns = (table[c].to_pylist() for c in ("lang", "source", "n_chars"))
    out = np.zeros((table.num_rows, SOURCE_BUCKETS + LANG_BUCKETS + 3))
    for k, row in enumerate(zip(*columns, strict=True)):
        out[k] = metadata_features(*row)
    return out


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    text = [text_features(t.as_py() or "") for t in batch["text"]]
    return np.array(text, float), _metadata(batch)


@dataclass
class CoTrained:
    """Both views, what calibrates each of them and their combination."""

    text: Logistic
    meta: Logistic
    text_scale: Logistic
    meta_scale: Logistic
    both_scale: Logistic
    prior: float

    def margins(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = self.text_scale.margin(self.text.margin(text)[:, None])
        b = self.meta_scale.margin(self.meta.margin(meta)[:, None])
        return a, b

    def scores(
        self, text: np.ndarray, meta: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of good quality by text, by metadata and by both."""
        a, b = self.margins(text, meta)
        both = self.both_scale.margin((a + b - self.prior)[:, None])
        return sigmoid(a), sigmoid(b), sigmoid(both)


def _confident(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the pool that a view is sure of, the surest first, and their pseudo-labels."""
    order = np.argsort(-p, kind="stable")
    yes = order[p[order] >= CONFIDENT][:EXCHANGED]
    no = order[::-1][p[order[::-1]] <= 1 - CONFIDENT][:EXCHANGED]
    return np.concatenate([yes, no]), np.concatenate([np.ones(len(yes)), np.zeros(len(no))])


def co_train(
    text: np.ndarray,
    meta: np.ndarray,
    label: np.ndarray,
    calibrates: np.ndarray,
    pool_text: np.ndarray,
    pool_meta: np.ndarray,
    rounds: int = ROUNDS,
) -> CoTrained:
    """Fit on labelled rows outside ``calibrates`` and what the views hand to each other."""
    fits = ~calibrates
    ta, tb, ya, yb = text[fits], meta[fits], label[fits], label[fits]
    left = np.ones(len(pool_text), bool)
    for turn in range(rounds + 1):
        a, b = Logistic().fit(ta, ya), Logistic().fit(tb, yb)
        scale_a = Logistic(1e-3).fit(a.margin(text[calibrates])[:, None], label[calibrates])
        scale_b = Logistic(1e-3).fit(b.margin(meta[calibrates])[:, None], label[calibrates])
        at = np.flatnonzero(left)
        if turn == rounds or not len(at):
            break
        sure_a, said_a = _confident(sigmoid(scale_a.margin(a.margin(pool_text[at])[:, None])))
        sure_b, said_b = _confident(sigmoid(scale_b.margin(b.margin(pool_meta[at])[:, None])))
        tb, yb = np.concatenate([tb, pool_meta[at[sure_a]]]), np.concatenate([yb, said_a])
        ta, ya = np.concatenate([ta, pool_text[at[sure_b]]]), np.concatenate([ya, said_b])
        left[at[sure_a]] = left[at[sure_b]] = False
    prior = float(logit(np.array([label.mean()]), 1e-3)[0])
    made = CoTrained(a, b, scale_a, scale_b, Logistic(1e-3), prior)
    x, y = made.margins(text[calibrates], meta[calibrates])
    made.both_scale.fit((x + y - prior)[:, None], label[calibrates])
    return made


def _inputs(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """doc_id, text, lang, source and n_chars; a missing column reads as null."""
    columns = [
        F.col(c).cast(t) if c in docs.columns else F.lit(None).cast(t)
        for c, t in (("lang", "string"), ("source", "string"), ("n_chars", "long"))
    ]
    return [
        F.col(id_col).cast("long").alias("doc_id"),
        text_of(text_col).alias("text"),
        *[c.alias(n) for c, n in zip(columns, ("lang", "source", "n_chars"), strict=True)],
    ]


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> CoTrained | None:
    """Co-train on at most LABELLED_ROWS labelled and POOL_ROWS unlabelled documents.

    ``labels`` has doc_id and quality (0 or 1); other values and nulls are passed over, and a
    document labelled both ways counts as bad. None if a class has too few rows to fit.
    """
    small_batches(docs.sparkSession)
    known = (
        labels.where("quality IN (0, 1) AND doc_id IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("label_id"))
        .agg(F.min("quality").cast("double").alias("label"))
    )
    labelled = hashed_sample(known, "label_id", LABELLED_ROWS)
    rows = docs.select(*_inputs(docs, id_col, text_col))
    unlabelled = (
        rows.select(F.col("doc_id").alias("label_id"))
        .where("label_id IS NOT NULL")
        .join(known, "label_id", "left_anti")
        .withColumn("label", F.lit(None).cast("double"))
    )
    pool = hashed_sample(unlabelled, "label_id", POOL_ROWS).distinct()

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [text_features(t.as_py()) for t in batch["text"]]
            columns = [batch[c] for c in ("doc_id", "label", "lang", "source", "n_chars")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(made, pa.list_(pa.float64()))],
                ["doc_id", "label", "lang", "source", "n_chars", "text"],
            )

    chosen = labelled.union(pool)  # at most LABELLED_ROWS + POOL_ROWS ids
    made = (
        rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
        .select("doc_id", "text", "lang", "source", "n_chars", "label")
        .mapInArrow(
            features,
            "doc_id long, label double, lang string, source string, n_chars long, "
            "text array<double>",
        )
        .orderBy("doc_id")
        .limit(2 * (LABELLED_ROWS + POOL_ROWS))
        .toArrow()
    )
    if not made.num_rows:
        return None
    label = made["label"].to_numpy(zero_copy_only=False).astype(float)
    text = made["text"].combine_chunks().flatten().to_numpy().reshape(len(label), -1)
    meta = _metadata(made)
    has = ~np.isnan(label)
    part = np.array([zlib.crc32(b"%d" % d) % 1000 for d in made["doc_id"].to_pylist()])
    calibrates = (part < 1000 * CALIBRATION_SHARE)[has]
    y = label[has]
    enough = [(y[part] == v).sum() >= 2 for part in (calibrates, ~calibrates) for v in (0, 1)]
    if not len(y) or not all(enough):
        return None
    return co_train(text[has], meta[has], y, calibrates, text[~has], meta[~has])


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """doc_id, text_score, metadata_score, score and accepted for every row of ``docs``.

    Scores are probabilities of good quality. A null text counts as empty, null columns are
    values of their own, missing ones null. Without enough labels every score is 1 and every
    document accepted.
    """
    model = fit_quality(docs, labels, id_col, text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ones = np.ones(batch.num_rows)
            made = (ones, ones, ones)
            if model and batch.num_rows:
                made = model.scores(*_views(batch))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *map(pa.array, made), pa.array(made[2] >= threshold)],
                ["doc_id", "text_score", "metadata_score", "score", "accepted"],
            )

    return docs.select(*_inputs(docs, id_col, text_col)).mapInArrow(
        score,
        "doc_id long, text_score double, metadata_score double, score double, accepted boolean",
    )


def keep_good_documents(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The accepted rows of ``docs``, with all their columns; nothing is shuffled."""
    model = fit_quality(docs, labels, id_col, text_col)
    if model is None:
        return docs
    names = [c for c in ("lang", "source", "n_chars") if c in docs.columns]
    columns = {c: k for k, c in enumerate(docs.columns)}

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = {c: batch.column(columns[c]) for c in names}
                for c in ("lang", "source", "n_chars"):
                    made.setdefault(c, pa.nulls(batch.num_rows))
                views = pa.RecordBatch.from_pydict({"text": batch.column(columns[text_col]), **made})
                score = model.scores(*_views(views))[2]
                yield batch.filter(pa.array(score >= threshold))

    return docs.mapInArrow(pick, docs.schema)
