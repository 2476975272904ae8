"""Ranked lexical search: term at a time, with a limited number of accumulators.

Only the terms of the items are indexed. Documents stay where they lie: each task reads its
postings in blocks and ranks every item over a block. Terms are taken rarest first, and a
document gets an accumulator with the first term that finds it. Once the terms that remain
cannot together reach the k-th best partial score, no new accumulators are made; those there
are go on being updated exactly. What a task has found raises the bar for its later blocks, and
the best of all tasks meet in a window.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stage

K = 10
#: Characters of items that are asked in one pass over the documents; more take several passes.
CHUNK_CHARS = 1 << 22
#: Postings of a block, about.
BLOCK_POSTINGS = 1 << 20
#: Bytes of terms, A-Z in lower case, all others a space.
TERM_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)
FOUND = "item int, doc_id long, score long"


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text in their order: runs of ASCII letters, digits and all else."""
    return text.translate(TERM_BYTES).split()


def term_weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def postings(texts: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, number of terms n, and the numbers and counts of the terms in ``vocabulary``.

    One row per row of ``texts`` (doc_id, text as bytes) that has a term.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, terms, counts = [], [], []
            for text in batch["text"]:
                words = terms_of(text.as_py())
                known = [t for t in map(vocabulary.get, words) if t is not None]
                term, count = np.unique(np.array(known, np.int32), return_counts=True)
                sizes.append(len(words))
                terms.append(term)
                counts.append(count)
            out = pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array(sizes, pa.int64()),
                    pa.array(terms, pa.list_(pa.int32())),
                    pa.array(counts, pa.list_(pa.int64())),
                ],
                ["doc_id", "n", "terms", "counts"],
            )
            yield out.filter(pa.array([s > 0 for s in sizes], pa.bool_()))

    return texts.mapInArrow(read, "doc_id long, n long, terms array<int>, counts array<long>")


class Best:
    """The k best documents of an item so far: scores, ids, and whether the id is null."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.scores = self.ids = np.empty(0, np.int64)
        self.nulls = np.empty(0, bool)

    def bar(self) -> int:
        """Less than this is not among the best; 1 while there are fewer than k."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        scores = np.concatenate([self.scores, scores])
        ids = np.concatenate([self.ids, ids])
        nulls = np.concatenate([self.nulls, nulls])
        order = np.lexsort((ids, nulls, -scores))[: self.k]
        self.scores, self.ids, self.nulls = scores[order], ids[order], nulls[order]


class Block:
    """Postings of some documents by term, with the greatest impact of each term."""

    def __init__(self, rows: pa.Table, documents: int, length: int) -> None:
        ids = rows["doc_id"].combine_chunks()
        self.nulls = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy()
        lists, counts = rows["terms"].combine_chunks(), rows["counts"].combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        at = np.repeat(np.arange(len(sizes)), sizes)
        term = lists.flatten().to_numpy()
        tf = counts.flatten().to_numpy()
        m = 25 + 75 * rows["n"].to_numpy() * documents // length
        impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[at])
        order = np.argsort(term, kind="stable")
        self.at, self.impact = at[order], impact[order]
        names, starts = np.unique(term[order], return_index=True)
        stops = np.append(starts, len(order))[1:]
        most = np.maximum.reduceat(self.impact, starts) if len(starts) else starts
        spans = zip(starts.tolist(), stops.tolist(), most.tolist(), strict=True)
        self.spans = dict(zip(names.tolist(), spans, strict=True))

    def rank(self, wanted: list[tuple[int, int]], best: Best) -> None:
        """Add this block's documents to ``best``; ``wanted`` holds terms, rarest first, and
        what their impact counts."""
        here = [(*self.spans[t], w) for t, w in wanted if t in self.spans]
        rest = np.cumsum([most * w for _, _, most, w in here][::-1])[::-1].tolist()
        partial = np.zeros(len(self.ids), np.int64)
        bar = best.bar()
        taken = 0
        for start, stop, _, w in here:
            if taken and partial.max() > rest[taken] and len(partial) >= best.k:
                bar = max(bar, int(np.partition(partial, -best.k)[-best.k]))
            if rest[taken] < bar:
                break
            partial[self.at[start:stop]] += w * self.impact[start:stop]
            taken += 1
        survivors = np.flatnonzero(partial)
        scores = partial[survivors]
        for start, stop, _, w in here[taken:]:
            if not len(survivors):
                break
            at = self.at[start:stop]
            place = np.minimum(np.searchsorted(at, survivors), len(at) - 1)
            hit = at[place] == survivors
            scores[hit] += w * self.impact[start:stop][place[hit]]
        high = scores >= bar
        found = survivors[high]
        best.add(scores[high], self.ids[found], self.nulls[found])


def _ranked(
    indexed: DataFrame, wanted: list[list[tuple[int, int]]], documents: int, length: int,
    k: int, block_postings: int,
) -> DataFrame:
    """The k best of every item in every task, items by their number in ``wanted``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in wanted]

        def rank(held: list[pa.RecordBatch]) -> None:
            block = Block(pa.Table.from_batches(held), documents, length)
            for terms, found in zip(wanted, best, strict=True):
                block.rank(terms, found)

        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += len(batch["terms"].flatten()) + batch.num_rows
            if size >= block_postings:
                rank(held)
                held, size = [], 0
        if held:
            rank(held)
        for number, found in enumerate(best):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(found.ids), number, np.int32)),
                    pa.array(found.ids, mask=found.nulls),
                    pa.array(found.scores),
                ],
                ["item", "doc_id", "score"],
            )

    return indexed.mapInArrow(read, FOUND)


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    k: int = K,
    chunk_chars: int = CHUNK_CHARS,
    block_postings: int = BLOCK_POSTINGS,
) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the ``k`` best documents of every item.

    Scores are whole numbers above 0, ties go to the smaller id, null ids after all others.
    Every row of ``docs`` is a document, also where ids repeat; null and empty texts have no
    terms and count nowhere. An item id that repeats is asked once, with its least text; null
    is an id like others. Items without terms, and an empty table on either side, give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    asked = stage(
        items.groupBy(F.col(item_col).cast("long").alias("item_id"))
        .agg(F.min(F.col(item_text_col).cast("string")).alias("text"))
        .where("text IS NOT NULL"),
        "search-items",
    )
    chars = asked.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    chunks = max(1, -(-chars // chunk_chars))
    texts = docs.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").cast("binary").alias("text"),
    )
    out = None
    for chunk in range(chunks):
        part = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) == chunk)
        counted = [(r["item_id"], Counter(terms_of(r["text"].encode()))) for r in part.collect()]
        vocabulary: dict[bytes, int] = {}
        for _, terms in counted:
            for term in terms:
                vocabulary.setdefault(term, len(vocabulary))
        indexed = stage(postings(texts, vocabulary), "search-postings")
        total = indexed.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("length")).first()
        holding = dict(
            indexed.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
        )
        wanted = []
        for _, terms in counted:
            known = ((holding[t], t, q) for w, q in terms.items() if (t := vocabulary[w]) in holding)
            weighed = [(t, q * term_weight(total["n"], df)) for df, t, q in sorted(known)]
            wanted.append([(t, w) for t, w in weighed if w])
        names = spark.createDataFrame(
            [(number, item_id) for number, (item_id, _) in enumerate(counted)],
            "item int, item_id long",
        )
        found = _ranked(indexed, wanted, total["n"], total["length"] or 1, k, block_postings)
        order = Window.partitionBy("item").orderBy(
            F.col("score").desc(), F.col("doc_id").asc_nulls_last()
        )
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        best = best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        if chunks > 1:
            best = stage(best, "search-best")
        out = best if out is None else out.union(best)
    return out
