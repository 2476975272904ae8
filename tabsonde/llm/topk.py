"""Exact top-k by inner product, as a Voronoi join of queries and data.

Components are whole numbers, floor(256 x). Pivots from a bounded sample cut the space into
cells. Of each cell only a summary is gathered: rows and the least distances to its pivot. A
row at distance d from pivot p scores between q.p - |q| d and q.p + |q| d with query q. The
summaries therefore bound the k-th best score of every query from below, and so tell from which
distance on a row of a cell can be among the best; a row of data goes to the groups of queries
that need it. Groups are solved in slices of bounded size, and the best of the slices are
merged by a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hashed_sample, small_batches, stage

K = 5
SCALE = 256
QUERY_STEP = 50
#: Rows that the pivots are drawn from: each is one.
PIVOTS = 64
#: Queries of a group and rows of data of a slice, about.
GROUP_QUERIES = 4096
SLICE_ROWS = 16_384
#: Numbers of a block of scores.
BLOCK_SCORES = 1 << 22
SLACK = 1e-9
#: Rows of one query's own id that the bounds allow for; with more, all data is needed.
OWN_ROWS = 64


def whole_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and the components as whole numbers, of the rows that take part.

    Null ids, null vectors and vectors with null or non-finite components do not.
    """
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    )
    return table.where(F.col(id_col).isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.transform(x, lambda v: F.floor(v * SCALE).cast("long")).alias("v"),
    )


def matrix(vectors: pa.Array, width: int, kind: type) -> np.ndarray:
    """Rows of a list column, short ones filled with zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width).astype(kind)
    out = np.zeros((len(sizes), width), kind)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[rows, at] = flat
    return out


def nearest_pivot(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell and distance to its pivot."""
    square = (pivots * pivots).sum(axis=1)[None, :] - 2 * x @ pivots.T
    cell = square.argmin(axis=1)
    gap = x - pivots[cell]
    return cell, np.sqrt((gap * gap).sum(axis=1))


def needed_from(
    x: np.ndarray, pivots: np.ndarray, near_cell: np.ndarray, near: np.ndarray, rank: int
) -> np.ndarray:
    """For each query and cell: the distance to the pivot from which on a row can be needed.

    ``near`` holds distances of rows to the pivots of ``near_cell``; the query's ``rank``-th
    best row scores no less than the ``rank``-th best of what these rows score at least.
    """
    length = np.sqrt((x * x).sum(axis=1))
    at_pivot = x @ pivots.T
    least = at_pivot[:, near_cell] - length[:, None] * near[None, :]
    if least.shape[1] < rank:
        return np.full(at_pivot.shape, -np.inf)
    bound = np.partition(least, -rank, axis=1)[:, -rank]
    bound -= SLACK * (1 + np.abs(bound))
    lacking = bound[:, None] - at_pivot - SLACK * (1 + np.abs(at_pivot))
    with np.errstate(divide="ignore", invalid="ignore"):
        from_here = lacking / length[:, None]
    return np.where(length[:, None] > 0, from_here, -np.inf)


def best_of(
    queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, vec_id, score) of the k best rows of ``data`` for each query, ties to the
    smaller id; rows of the query's own id are passed over."""
    order = np.argsort(data_ids, kind="stable")
    data, data_ids = data[order], data_ids[order]
    out: list[tuple] = []
    step = max(1, BLOCK_SCORES // max(len(data), 1))
    for low in range(0, len(queries), step):
        block, ids = queries[low : low + step], query_ids[low : low + step]
        scores = np.rint(block @ data.T).astype(np.int64) if block.dtype == float else block @ data.T
        own = ids[:, None] == data_ids[None, :]
        # Later columns have larger ids, so that a score and its column make one rising key.
        key = scores * len(data) + (len(data) - 1 - np.arange(len(data)))[None, :]
        key[own] = np.iinfo(np.int64).min
        cut = len(data) - min(k, len(data))
        at = np.argpartition(key, cut, axis=1)[:, cut:] if cut else np.argsort(key, axis=1)
        rows = np.arange(len(block))[:, None]
        keep = ~own[rows, at]
        names = np.broadcast_to(ids[:, None], at.shape)
        out.append((names[keep], data_ids[at][keep], scores[rows, at][keep]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def top_k(
    table: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = K,
    query_step: int = QUERY_STEP,
    pivots: int = PIVOTS,
    group_queries: int = GROUP_QUERIES,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's ``k`` best rows.

    Queries are the rows whose id is divisible by ``query_step``; an id that repeats is asked
    once, with its least vector. Rows with a query's own id are no answers to it; other
    repeated rows are answers each. Shorter vectors are filled with zeros. Fewer rows than
    ``k`` give fewer ranks; an empty table gives no rows.
    """
    spark = table.sparkSession
    small_batches(spark)
    rows = stage(whole_vectors(table, id_col, vector_col), "vectors")
    length = F.aggregate("v", F.lit(0).cast("double"), lambda s, x: s + x.cast("double") * x)
    sums = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.size("v")).alias("width"),
        F.max(length).alias("limit"),
    ).first()
    empty = "query_id long, rank int, vec_id long, score long"
    if not sums["n"] or not sums["width"]:
        return spark.createDataFrame([], empty)
    width = sums["width"]
    # Inner products are exact as doubles up to 2**53; beyond, whole numbers are multiplied.
    kind = float if sums["limit"] < 1 << 52 else np.int64
    drawn = hashed_sample(rows, "vec_id", pivots).toArrow()
    centres = matrix(drawn["v"], width, float)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, distance = nearest_pivot(matrix(batch["v"], width, float), centres)
                yield pa.RecordBatch.from_arrays(
                    [batch["vec_id"], batch["v"], pa.array(cell.astype(np.int32)), pa.array(distance)],
                    ["vec_id", "v", "cell", "distance"],
                )

    placed = "vec_id long, v array<long>, cell int, distance double"
    data = stage(rows.mapInArrow(place, placed), "data-cells")
    named = rows.where(F.col("vec_id") % query_step == 0)
    asked = named.groupBy("vec_id").agg(F.min("v").alias("v"), F.count(F.lit(1)).alias("own"))
    own = asked.agg(F.max("own").alias("own")).first()["own"]
    if own is None:
        return spark.createDataFrame([], empty)
    asked = stage(asked.select("vec_id", "v").mapInArrow(place, placed), "query-cells")

    # Summaries: as many distances per cell as can be asked for, rows with the query's own id
    # besides the k best.
    rank = k + min(own, OWN_ROWS)
    closest = F.row_number().over(Window.partitionBy("cell").orderBy("distance"))
    near = data.select("cell", "distance", closest.alias("p")).where(F.col("p") <= rank).toArrow()
    near_cell, near_distance = near["cell"].to_numpy(), near["distance"].to_numpy()

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch["v"], width, float)
                least = np.full((len(x), len(centres)), -np.inf)
                if own <= OWN_ROWS:
                    least = needed_from(x, centres, near_cell, near_distance, rank)
                cell = batch["cell"].to_numpy()
                for c in np.unique(cell):
                    mine = least[cell == c]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(centres), c, np.int32)),
                            pa.array(np.arange(len(centres), dtype=np.int32)),
                            pa.array(mine.min(axis=0)),
                            pa.array(np.full(len(centres), len(mine), np.int64)),
                        ],
                        ["cell", "other", "least", "n"],
                    )

    # At most pivots * pivots rows.
    bounds = (
        asked.mapInArrow(reach, "cell int, other int, least double, n long")
        .groupBy("cell", "other")
        .agg(F.min("least").alias("least"), F.sum("n").alias("n"))
        .collect()
    )
    low: dict[int, np.ndarray] = {}
    queries_of: dict[int, int] = {}
    for r in bounds:
        low.setdefault(r["cell"], np.full(len(centres), np.inf))[r["other"]] = r["least"]
        queries_of[r["cell"]] = r["n"]

    # Query cells of near pivots share a group; a large cell is split over several.
    groups: list[np.ndarray] = []
    of_cell: dict[int, tuple[int, int]] = {}  # first group, groups
    filled = group_queries
    for cell in sorted(queries_of, key=lambda c: (centres[c] @ centres[0], c)):
        n = queries_of[cell]
        if n > group_queries:
            parts = -(-n // group_queries)
            of_cell[cell] = (len(groups), parts)
            groups += [low[cell]] * parts
            filled = group_queries
            continue
        if filled + n > group_queries:
            groups.append(low[cell])
            filled = 0
        else:
            groups[-1] = np.minimum(groups[-1], low[cell])
        of_cell[cell] = (len(groups) - 1, 1)
        filled += n
    lows = np.array(groups)
    slices = max(1, -(-sums["n"] // slice_rows))

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, distance = batch["cell"].to_numpy(), batch["distance"].to_numpy()
            needed = lows[:, cell] <= distance
            group, row = np.nonzero(needed)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(group.astype(np.int32)),
                    batch["vec_id"].take(pa.array(row)),
                    batch["v"].take(pa.array(row)),
                ],
                ["group", "vec_id", "v"],
            )

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["vec_id"].to_pylist()
            places = [of_cell[c] for c in batch["cell"].to_pylist()]
            group = [f + (q // query_step) % n for q, (f, n) in zip(ids, places, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(group, pa.int32()), batch["vec_id"], batch["v"]],
                ["group", "vec_id", "v"],
            )

    kinds = "group int, vec_id long, v array<long>"
    sent = data.mapInArrow(replicate, kinds).withColumn(
        "slice", F.pmod(F.xxhash64("vec_id"), F.lit(slices)).cast("int")
    )
    asking = asked.mapInArrow(deal, kinds).withColumn(
        "slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
    )

    def solve(queries: pa.Table, near: pa.Table) -> pa.Table:
        names = ("query_id", "vec_id", "score")
        if not queries.num_rows or not near.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        found = best_of(
            matrix(queries["v"], width, kind),
            queries["vec_id"].to_numpy(),
            matrix(near["v"], width, kind),
            near["vec_id"].to_numpy(),
            k,
        )
        return pa.table(dict(zip(names, found, strict=True)))

    found = (
        asking.groupBy("group", "slice")
        .cogroup(sent.groupBy("group", "slice"))
        .applyInArrow(solve, "query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
