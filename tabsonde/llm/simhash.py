"""SimHash near-duplicates: every pair of fingerprints within the radius, by tiles.

A document becomes a 64-bit fingerprint of its word shingles; equal fingerprints become one.
Fingerprints are tiled by the population counts of their four 16-bit quarters. Two fingerprints
within the radius differ by no more than the radius in the sum of those counts, so only tiles
that near meet; all others are skipped. Meeting tiles are compared in full with exclusive-or
and bit counts. A comparison returns links that span what it found, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, small_batches, stage, text_of
from .components import components

SHINGLE_WORDS = 3
RADIUS = 3
SEED = 42
QUARTERS = 4
QUARTER_BITS = 16
#: Fingerprints of a tile: two tiles meet in one array of its square.
TILE = 1024
#: Shingles of a text that are hashed at a time.
BLOCK = 1 << 16


def fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    """The fingerprint as an unsigned number; zero without words."""
    import xxhash

    tokens = text.encode("utf-8", "surrogatepass").lower().split()  # A-Z and ASCII spaces only
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    shingles = max(len(tokens) - words + 1, 1)
    starts = np.append(0, ends)[:shingles]
    stops = ends[-shingles:] - 1
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for low in range(0, shingles, BLOCK):
        spans = zip(starts[low : low + BLOCK].tolist(), stops[low : low + BLOCK].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > shingles).tobytes(), "big")


def fingerprints(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = SHINGLE_WORDS,
) -> DataFrame:
    """doc_id and its fingerprint as a (signed) long, one row per row of ``docs``."""
    small_batches(docs.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py(), words) for t in batch["text"]]
            values = np.array(prints, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(values)], ["doc_id", "fp"]
            )

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return texts.mapInArrow(read, "doc_id long, fp long")


def _nearby(radius: int) -> list[int]:
    """Offsets between cells whose counts differ by the radius at most, each pair one way."""
    steps = product(range(-radius, radius + 1), repeat=QUARTERS)
    near = [s for s in steps if sum(map(abs, s)) <= radius and s >= (0,) * QUARTERS]
    return [list(s) for s in near]


def _spanning(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever pairs of left and right are within the radius.

    Each node goes to the smallest node of what it is connected to here, so there is at most
    one link per node.
    """
    near = np.bitwise_count(left[:, None] ^ right[None, :]) <= radius
    i, j = np.nonzero(near)
    a, b = left[i], right[j]
    apart = a != b
    a, b = a[apart], b[apart]
    if not len(a):
        return a, b
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = where[: len(a)], where[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        after = label.copy()
        np.minimum.at(after, x, low)
        np.minimum.at(after, y, low)
        after = after[after]
        if np.array_equal(after, label):
            break
        label = after
    linked = label != np.arange(len(nodes))
    return nodes[label[linked]], nodes[linked]


def links_within(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that connect every pair within ``radius``.

    Not every pair is a row: what two tiles connect comes back as links that span it.
    """
    small_batches(prints.sparkSession)
    masks = [((1 << QUARTER_BITS) - 1) << (QUARTER_BITS * q) for q in range(QUARTERS)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    base = QUARTER_BITS + 1
    counts = [F.bit_count(F.col("fp").bitwiseAND(F.lit(m))) for m in signed]
    cell = counts[0].cast("int")
    for c in counts[1:]:
        cell = cell * base + c
    celled = prints.select("fp", cell.alias("cell"))
    # At most 17**4 = 83,521 rows, however many fingerprints.
    tiles_of = celled.groupBy("cell").agg(
        F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles")
    )
    tiles_of = stage(tiles_of, "simhash-cells")
    tiles = (
        celled.join(F.broadcast(tiles_of), "cell")
        .withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
        .groupBy("cell", "tile")
        .agg(F.collect_list("fp").alias("fps"))
    )
    tiles = stage(tiles, "simhash-tiles")

    near = F.array(*[F.array(*[F.lit(x) for x in s]) for s in _nearby(radius)])
    digits = [F.expr(f"cell div {base ** (QUARTERS - 1 - q)} % {base}") for q in range(QUARTERS)]
    visits = tiles.select(
        F.col("cell").alias("from_cell"),
        F.col("tile").alias("from_tile"),
        F.col("fps").alias("visitors"),
        F.array(*digits).alias("at"),
        F.explode(near).alias("step"),
    )
    moved = [F.col("at")[q] + F.col("step")[q] for q in range(QUARTERS)]
    inside = F.lit(True)
    target = F.lit(0)
    for m in moved:
        inside = inside & m.between(0, QUARTER_BITS)
        target = target * base + m
    visits = visits.where(inside).select(
        "from_cell", "from_tile", "visitors", target.cast("int").alias("cell")
    )
    visits = visits.join(F.broadcast(tiles_of), "cell").select(
        "from_cell",
        "from_tile",
        "visitors",
        "cell",
        F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"),
    )
    pairs = (
        visits.where("from_cell != cell OR from_tile <= tile")
        .join(tiles, ["cell", "tile"])
        .select("visitors", "fps")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for k in range(batch.num_rows):
                left, right = (
                    batch[n][k].values.to_numpy(zero_copy_only=False).view(np.uint64)
                    for n in ("visitors", "fps")
                )
                found.append(_spanning(left, right, radius))
            a = np.concatenate([x for x, _ in found] or [np.empty(0, np.uint64)])
            b = np.concatenate([x for _, x in found] or [np.empty(0, np.uint64)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(x.view(np.int64)) for x in (a, b)], ["a", "b"]
            )

    return pairs.mapInArrow(compare, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS
) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id for every row of ``docs``.

    Null and empty texts have fingerprint zero and are linked like any other. The component is
    named by the smallest id reachable; null ids are passed over, unless there is no other.
    Repeated rows are returned as often as they come. An empty table gives no rows.
    """
    marked = stage(fingerprints(docs, id_col, text_col), "fingerprints")
    prints = stage(
        marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct-fingerprints"
    )
    roots = stage(components(links_within(prints, radius)), "roots")
    rooted = prints.join(roots, prints["fp"] == roots["node"], "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_print = rooted.join(least, "root").select(F.col("fp").alias("print"), "component_id")
    return marked.join(of_print, F.col("fp") == F.col("print")).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS
) -> DataFrame:
    """The rows of ``docs`` that name their component, with all their columns.

    Ids are taken to be unique; rows that repeat an id go or stay together.
    """
    found = near_duplicates(docs, id_col, text_col, radius)
    kept = found.where("doc_id <=> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    return keep_rows(docs, kept, [id_col])
