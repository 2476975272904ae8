"""Hard negatives by a vertical scan of vectors, one dimension after the other.

Rows are dealt to slices and anchors to groups; every group meets every slice. A slice holds
its dimensions as columns. For an anchor they are read in descending order of its components'
magnitude, and the partial scores of the candidates are bounded by what the dimensions that
remain add at least and at most, by the least and greatest value of each column. The bounds
shrink the bitmap of candidates until those left are scored in full. A first scan finds the
positives of each anchor; their scores are the windows of the second scan.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage
from .topk import SCALE, matrix

ANCHOR_STEP = 100
POSITIVES = 5
NEGATIVES = 5
#: A negative scores from this many hundredths of the positive's score up to all of it.
LEAST_PERCENT = 80
#: Anchors of a group and rows of a slice, about.
GROUP_ANCHORS = 1024
SLICE_ROWS = 16_384
#: Dimensions between two looks at the bounds.
STRIDE = 8
#: Scores beyond a long are held at its ends.
LONG = (-(1 << 63), (1 << 63) - 1)


class Columns:
    """A slice of vectors by dimension, with the least and greatest value of each."""

    def __init__(self, x: np.ndarray) -> None:
        self.x = np.ascontiguousarray(x.T)
        self.least, self.greatest = self.x.min(axis=1), self.x.max(axis=1)


def _kth(values: np.ndarray, k: int) -> int | None:
    """The k-th greatest, or None if there are fewer."""
    return int(np.partition(values, -k)[-k]) if len(values) >= k else None


def scan(
    slice_: Columns, anchor: np.ndarray, rows: np.ndarray, windows: list[tuple[int | None, int | None]],
    k: int, stride: int = STRIDE,
) -> tuple[np.ndarray, np.ndarray]:
    """Rows among ``rows``, with their scores, that hold the k best of every window.

    A window is a least and a greatest score, None for none. Ties with the k-th best stay.
    """
    order = np.argsort(-np.abs(anchor), kind="stable")
    q = anchor[order]
    low, high = q * slice_.least[order], q * slice_.greatest[order]
    low, high = np.minimum(low, high), np.maximum(low, high)
    # What the dimensions from d on add at least and at most.
    at_least = np.append(np.cumsum(low[::-1])[::-1], 0)
    at_most = np.append(np.cumsum(high[::-1])[::-1], 0)
    partial = np.zeros(len(rows), anchor.dtype)
    whole = len(rows) == slice_.x.shape[1]
    for d in range(len(q)):
        if q[d]:
            column = slice_.x[order[d]]
            partial += q[d] * (column if whole else column[rows])
        if (d + 1) % stride and d + 1 < len(q):
            continue
        worst, best = partial + at_least[d + 1], partial + at_most[d + 1]
        alive = np.zeros(len(rows), bool)
        for floor, ceiling in windows:
            inside = np.ones(len(rows), bool) if ceiling is None else worst <= ceiling
            if floor is not None:
                inside &= best >= floor
            # Rows that are in the window for certain set its k-th best.
            certain = inside if ceiling is None else inside & (best <= ceiling)
            if floor is not None:
                certain = certain & (worst >= floor)
            bar = _kth(worst[certain], k)
            alive |= inside if bar is None else inside & (best >= bar)
        if not alive.all():
            rows, partial, whole = rows[alive], partial[alive], False
            if not len(rows):
                break
    return rows, np.clip(partial, *LONG).astype(np.int64)


def least_negative(positive: int, percent: int = LEAST_PERCENT) -> int:
    """The least whole score that is at least ``percent`` hundredths of ``positive``."""
    return -(-percent * positive // 100)


def _take_part(
    table: DataFrame, id_col: str, vector_col: str, label_col: str, anchor_step: int, sizes: tuple
) -> tuple[DataFrame, DataFrame, int, type]:
    """Rows with their slice, anchors with their group (each repeated for all of the other)."""
    group_anchors, slice_rows = sizes
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = table.where(
        F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.coalesce(finite, F.lit(False))
    ).select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(label_col).cast("long").alias("label"),
        F.transform(x, lambda c: F.floor(c * SCALE).cast("long")).alias("v"),
    )
    rows = stage(whole, "labelled-vectors")
    length = F.aggregate("v", F.lit(0).cast("double"), lambda s, x: s + x.cast("double") * x)
    sums = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.size("v")).alias("width"),
        F.max(length).alias("limit"),
        F.count_if(F.col("vec_id") % anchor_step == 0).alias("anchors"),
    ).first()
    slices = max(1, -(-sums["n"] // slice_rows))
    groups = max(1, -(-sums["anchors"] // group_anchors))
    # An id that repeats is asked once, with the least of its labels and vectors.
    anchors = rows.where(F.col("vec_id") % anchor_step == 0).groupBy("vec_id").agg(
        F.min(F.struct("label", "v")).alias("row")
    )
    anchors = stage(anchors.select("vec_id", "row.label", "row.v"), "anchors").withColumn(
        "part", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")
    )
    place = F.monotonically_increasing_id()
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("vec_id", place), F.lit(slices)).cast("int"))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    anchors = anchors.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    # With squared lengths up to here all sums and bounds fit into 64 bits; Python's whole numbers
    # stand for larger ones.
    kind = np.int64 if (sums["limit"] or 0) < 1 << 50 else object
    return rows, anchors, sums["width"] or 0, kind


def hard_negatives(
    table: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    anchor_step: int = ANCHOR_STEP,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least_percent: int = LEAST_PERCENT,
    group_anchors: int = GROUP_ANCHORS,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score and negative_score.

    Anchors are the rows whose id is divisible by ``anchor_step``; an id that repeats is asked
    once. The positives of an anchor are the best other rows of its label, its negatives for
    each the best rows of other labels that score between ``least_percent`` hundredths of the
    positive and all of it; ties go to the smaller id. Rows of the anchor's own id take no part
    in its answers; other ids that repeat are answers each. Rows with a null id, label or
    vector, or a component that is null or not finite, are passed over, and shorter vectors are
    filled with zeros. Anchors without positives or negatives, and an empty table, give no rows.
    """
    spark = table.sparkSession
    rows, anchors, width, kind = _take_part(
        table, id_col, vector_col, label_col, anchor_step, (group_anchors, slice_rows)
    )
    if not width:
        return spark.createDataFrame(
            [],
            "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, "
            "negative_score long",
        )

    def arrays(part: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return part["vec_id"].to_numpy(), part["label"].to_numpy(), matrix(part["v"], width, kind)

    def table_of(names: tuple[str, ...], found: list[tuple]) -> pa.Table:
        columns = zip(*found, strict=True) if found else [[]] * len(names)
        joined = [np.concatenate([np.asarray(x, np.int64) for x in c] or [[]]) for c in columns]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, joined, strict=True)})

    def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        return np.lexsort((ids, -scores))[:k]

    def find_positives(asked: pa.Table, held: pa.Table) -> pa.Table:
        found = []
        if asked.num_rows and held.num_rows:
            ids, labels, x = arrays(held)
            slice_ = Columns(x)
            for anchor, label, q in zip(*arrays(asked), strict=True):
                same = np.flatnonzero((labels == label) & (ids != anchor))
                at, scores = scan(slice_, q, same, [(None, None)], positives)
                top = best(ids[at], scores, positives)
                found.append((np.full(len(top), anchor), ids[at][top], scores[top]))
        return table_of(("anchor_id", "positive_id", "positive_score"), found)

    meet = ["part", "slice"]
    scored = (
        anchors.groupBy(*meet)
        .cogroup(rows.groupBy(*meet))
        .applyInArrow(find_positives, "anchor_id long, positive_id long, positive_score long")
    )
    order = Window.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id")
    scored = scored.withColumn("place", F.row_number().over(order).cast("long"))
    scored = stage(scored.where(F.col("place") <= positives), "positives")
    windows = scored.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("w")
    )
    asking = anchors.join(windows, "vec_id").select(
        "vec_id", "label", "v", *meet, F.col("w.place").alias("places"),
        F.col("w.positive_id").alias("positive_ids"), F.col("w.positive_score").alias("scores"),
    )
    names = (
        "anchor_id", "positive_id", "place", "negative_id", "positive_score", "negative_score"
    )

    def find_negatives(asked: pa.Table, held: pa.Table) -> pa.Table:
        found = []
        if asked.num_rows and held.num_rows:
            ids, labels, x = arrays(held)
            slice_ = Columns(x)
            told = zip(*(asked[c].to_pylist() for c in ("places", "positive_ids", "scores")), strict=True)
            for anchor, label, q, (places, named, tops) in zip(*arrays(asked), told, strict=True):
                bounds = [(least_negative(p, least_percent), p) for p in tops]
                open_ = [b for b in set(bounds) if b[0] <= b[1]]
                if not open_:
                    continue
                other = np.flatnonzero((labels != label) & (ids != anchor))
                at, scores = scan(slice_, q, other, open_, negatives)
                for place, positive, (floor, top) in zip(places, named, bounds, strict=True):
                    inside = np.flatnonzero((scores >= floor) & (scores <= top))
                    kept = inside[best(ids[at[inside]], scores[inside], negatives)]
                    same = [np.full(len(kept), c) for c in (anchor, positive, place, top)]
                    found.append((*same[:3], ids[at[kept]], same[3], scores[kept]))
        return table_of(names, found)

    mined = (
        asking.groupBy(*meet)
        .cogroup(rows.groupBy(*meet))
        .applyInArrow(find_negatives, ", ".join(f"{n} long" for n in names))
    )
    order = Window.partitionBy("anchor_id", "place").orderBy(
        F.col("negative_score").desc(), "negative_id"
    )
    return (
        mined.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= negatives)
        .select(
            "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
        )
    )
