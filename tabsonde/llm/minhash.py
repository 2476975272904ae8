"""MinHash near-duplicates by circulant permutations, banded and checked on whole sets.

Two permutations of the 64-bit numbers make a signature of any length: the first scatters the
shingles, the second ranks them, shifted by one more step of the ring for every coordinate.
Equal sets become one class. Classes that agree in a band meet:

1. Each class is checked against one pivot, the class that leads most of its bands. Groups of
   near copies become one component here, at a cost that grows with their rows.
2. Bands that still hold several components are compared in full, in tiles of bounded size;
   pairs that are in one component already are passed over, and a pair that shares several
   bands is checked in the first.

Both checks use whole sets; links come back as spanning ones, never as all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_spread, keep_rows, small_batches, stage, text_of
from .components import components

SHINGLE_WORDS = 2
PERCENT = 80
SEED = 42
#: A pair at 0.8 shares no band in 49 of a million cases: (1 - 0.8**5)**25.
BANDS = 25
BAND_ROWS = 5
#: Shingles that are ranked at a time, and bytes of sets in a batch of rows.
BLOCK = 512
BATCH_BYTES = 4 << 20
#: Words whose hashes a task keeps.
KEPT_WORDS = 1 << 18
#: Shingles of a tile, and classes of one, about.
TILE_SHINGLES = 1 << 19
TILE_CLASSES = 512
#: Up to so many ids of classes go to the sets, beyond it the sets are shuffled to the ids.
BROADCAST_IDS = 1 << 22
#: What a row does in a group: it is held there, it visits those held.
HELD, VISITS = 1, 2
#: Odd numbers that the permutations multiply and shift by.
STEP, FOLD, LENGTH, TIMES = (
    np.uint64(0x9E3779B97F4A7C15),
    np.uint64(0xD6E8FEB86659FD93),
    np.uint64(0xC2B2AE3D27D4EB4F),
    (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)),
)


def scatter(x: np.ndarray) -> np.ndarray:
    """The first permutation."""
    x = (x ^ (x >> np.uint64(30))) * TIMES[0]
    x = (x ^ (x >> np.uint64(27))) * TIMES[1]
    return x ^ (x >> np.uint64(31))


def rank(x: np.ndarray) -> np.ndarray:
    """The second permutation, in place."""
    x ^= x >> np.uint64(32)
    x *= TIMES[1]
    x ^= x >> np.uint64(29)
    x *= TIMES[0]
    return x


class WordHashes(dict):
    """64-bit hashes of words, kept as they come."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return value


def shingle_set(text: str, words: int, kept: WordHashes) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles, scattered and sorted.

    A text of fewer words is one shingle, one without words has none.
    """
    tokens = text.encode("utf-8", "surrogatepass").lower().split()  # A-Z and ASCII spaces only
    if not tokens:
        return np.empty(0, np.uint64)
    if len(kept) > KEPT_WORDS:
        kept.clear()
    hashes = np.fromiter(map(kept.__getitem__, tokens), np.uint64, len(tokens))
    taken = min(words, len(tokens))
    count = len(tokens) - taken + 1
    mixed = np.full(count, taken, np.uint64) * LENGTH
    for k in range(taken):
        mixed = mixed * FOLD + hashes[k : k + count]
    return np.unique(scatter(mixed))


def signature(hashes: np.ndarray, size: int) -> np.ndarray:
    """For every shift of the ring the least rank among the scattered ``hashes``."""
    shifts = (np.arange(size, dtype=np.uint64) * STEP)[:, None]
    least = np.full(size, np.iinfo(np.uint64).max)
    for low in range(0, len(hashes), BLOCK):
        ranks = rank(hashes[None, low : low + BLOCK] + shifts)
        np.minimum(least, ranks.min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray, bands: int) -> np.ndarray:
    """One number a band, of its coordinates and its place."""
    parts = least.reshape(bands, -1)
    key = np.arange(bands, dtype=np.uint64)
    for k in range(parts.shape[1]):
        key = scatter(key * FOLD + parts[:, k])
    return key


def shingle_sets(
    docs: DataFrame, id_col: str, text_col: str, words: int, bands: int, band_rows: int
) -> DataFrame:
    """doc_id, set size n, a 128-bit digest, the set and its band keys, a row per row of ``docs``."""
    small_batches(docs.sparkSession)
    names = ["doc_id", "n", "high", "low", "shingles", "keys"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        kept = WordHashes()

        def packed(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
            digests = [divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 1 << 64) for s in sets]
            halves = np.array(digests, np.uint64).reshape(-1, 2).view(np.int64)
            keys = [
                band_keys(signature(s, bands * band_rows), bands).view(np.int64) if len(s) else None
                for s in sets
            ]
            columns = [
                ids,
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(halves[:, 0]),
                pa.array(halves[:, 1]),
                pa.array([s.tobytes() for s in sets], pa.binary()),
                pa.array(keys, pa.list_(pa.int64())),
            ]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            sets, size, done = [], 0, 0
            for text in batch["text"]:
                sets.append(shingle_set(text.as_py(), words, kept))
                size += sets[-1].nbytes
                if size >= BATCH_BYTES:
                    yield packed(batch["doc_id"][done : done + len(sets)], sets)
                    sets, size, done = [], 0, done + len(sets)
            yield packed(batch["doc_id"][done:], sets)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return texts.mapInArrow(
        read, "doc_id long, n long, high long, low long, shingles binary, keys array<long>"
    )


class Tile:
    """Rows of one group: their sets in common numbers, and what they are connected to."""

    def __init__(self, rows: pa.Table, percent: int) -> None:
        self.percent = percent
        column = {n: rows[n].combine_chunks() for n in rows.column_names}
        self.name = column["class"].to_numpy()
        self.label = column["root"].to_numpy().copy()
        self.size = column["n"].to_numpy()
        self.role = column["role"].to_numpy()
        self.rest = column["rest"].to_numpy(zero_copy_only=False)
        self.band = column["band"][0].as_py()
        if self.band > 0:
            self.keys = column["keys"].flatten().to_numpy().reshape(len(self.name), -1)
        packed = np.frombuffer(b"".join(column["shingles"].to_pylist()), np.uint64)
        values, self.codes = np.unique(packed, return_inverse=True)
        self.mark = np.zeros(len(values), bool)
        self.stops = np.cumsum(self.size)
        self.starts = self.stops - self.size

    def common(self, one: int, others: np.ndarray) -> np.ndarray:
        """How many shingles row ``one`` shares with each of the ``others``."""
        own = self.codes[self.starts[one] : self.stops[one]]
        self.mark[own] = True
        if 4 * self.size[others].sum() > len(self.codes):
            shared = np.add.reduceat(self.mark[self.codes], self.starts, dtype=np.int64)[others]
        else:
            spans = zip(self.starts[others], self.stops[others], strict=True)
            shared = np.array([np.count_nonzero(self.mark[self.codes[a:b]]) for a, b in spans])
        self.mark[own] = False
        return shared

    def links(self) -> list[tuple[int, int]]:
        """Links between visiting rows and held ones, as many as it takes to connect them."""
        found = []
        held = (self.role & HELD) > 0
        for one in np.flatnonzero(self.role & VISITS):
            near = held & (self.label != self.label[one])
            near &= (100 * self.size >= self.percent * self.size[one]) & (
                100 * self.size[one] >= self.percent * self.size
            )
            # Two rows of the rest visit each other; the smaller one's visit counts.
            near &= ~self.rest | (self.name > self.name[one])
            if self.band > 0:
                near[near] = ~(self.keys[near, : self.band] == self.keys[one, : self.band]).any(axis=1)
            others = np.flatnonzero(near)
            if not len(others):
                continue
            shared = self.common(one, others)
            union = self.size[one] + self.size[others] - shared
            for other in others[100 * shared >= self.percent * union]:
                old, new = self.label[other], self.label[one]
                if old != new:
                    self.label[self.label == old] = new
                    found.append((int(self.name[one]), int(self.name[other])))
        return found


GROUP = ["g1", "g2", "g3"]


def links_in_groups(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of the groups g1, g2, g3 of ``rows``, checked on their whole sets."""
    small_batches(rows.sparkSession)
    used = [*GROUP, "class", "root", "n", "role", "rest", "band", "keys", "shingles"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def solve() -> list[tuple[int, int]]:
            count = sum(h.num_rows for h in held)
            return Tile(pa.Table.from_batches(held), percent).links() if count > 1 else []

        for batch in batches:
            if not batch.num_rows:
                continue
            found = []
            keys = np.stack([batch[g].to_numpy() for g in GROUP])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for low, high in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                group = tuple(keys[:, low])
                if group != last:
                    found += solve()
                    held, last = [], group
                held.append(batch.slice(low, high - low))
            pairs = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])
        pairs = np.array(solve(), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    dealt = rows.select(used).repartition(*GROUP).sortWithinPartitions(*GROUP)
    return dealt.mapInArrow(read, "a long, b long")


def _tiles(classes: Column, shingles: Column) -> Column:
    by_rows = F.ceil(classes / TILE_CLASSES)
    return F.greatest(by_rows, F.ceil(shingles / TILE_SHINGLES), F.lit(1)).cast("int")


def _part(column: str, parts: Column) -> Column:
    return F.pmod(F.xxhash64(column, F.lit("part")), parts).cast("int")


def _to_pivots(members: DataFrame, buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between classes and the pivot of most of their bands, where they reach ``percent``."""
    led = join_spread(
        members.select("key", "class", "n"), buckets.select("key", "pivot", "size", "pivot_n"), ["key"]
    )
    like = (100 * F.col("n") >= percent * F.col("pivot_n")) & (
        100 * F.col("pivot_n") >= percent * F.col("n")
    )
    pairs = (
        led.where((F.col("class") != F.col("pivot")) & like)
        .groupBy("class", "n", "pivot")
        .agg(F.count(F.lit(1)).alias("bands"))
        .groupBy("class", "n")
        .agg(F.max(F.struct("bands", (-F.col("pivot")).alias("minus"))).alias("most"))
        .select("class", "n", (-F.col("most.minus")).alias("pivot"))
    )
    pairs = stage(pairs, "pivot-pairs")
    pivots = stage(
        pairs.groupBy("pivot").agg(
            F.count(F.lit(1)).alias("size"),
            _tiles(F.count(F.lit(1)), F.sum("n")).alias("tiles"),
        ),
        "pivots",
    )
    followers = join_spread(pairs, pivots, ["pivot"]).select(
        "class", "pivot", _part("class", F.col("tiles")).alias("g2"), F.lit(HELD).alias("role")
    )
    leaders = pivots.select(
        F.col("pivot").alias("class"),
        "pivot",
        F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("g2"),
        F.lit(VISITS).alias("role"),
    )
    rows = followers.union(leaders).join(sets.select("class", "n", "shingles"), "class")
    return links_in_groups(
        rows.select(
            F.col("pivot").alias("g1"), "g2", F.lit(0).alias("g3"), "class",
            F.col("class").alias("root"), "n", "role", F.lit(False).alias("rest"),
            F.lit(0).alias("band"), F.lit(None).cast("array<long>").alias("keys"), "shingles",
        ),
        percent,
    )


def _to_each_other(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between classes of different components that share a band.

    The rows of a band's largest component are held; those of all others visit them and each
    other, in tiles.
    """
    parts = members.groupBy("key", "root").agg(
        F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles")
    )
    first = F.max(F.struct("size", "root", "shingles"))
    mixed = parts.groupBy("key").agg(
        first.alias("first"),
        F.sum("size").alias("size"),
        F.sum("shingles").alias("shingles"),
        F.count(F.lit(1)).alias("roots"),
    )
    mixed = mixed.where("roots > 1").select(
        "key",
        "size",
        F.col("first.root").alias("main"),
        _tiles(F.col("size"), F.col("shingles")).alias("held"),
        _tiles(
            F.col("size") - F.col("first.size"), F.col("shingles") - F.col("first.shingles")
        ).alias("visits"),
    )
    rows = join_spread(members, stage(mixed, "mixed-bands"), ["key"]).withColumn(
        "rest", F.col("root") != F.col("main")
    )
    own_held, own_visit = _part("class", F.col("held")), _part("class", F.col("visits"))

    def spot(g2: Column, g3: Column, role: int) -> Column:
        return F.struct(g2.alias("g2"), g3.alias("g3"), F.lit(role).alias("role"))

    as_held = F.transform(
        F.sequence(F.lit(0), F.col("visits") - 1), lambda g3: spot(own_held, g3, HELD)
    )
    as_visit = F.transform(
        F.sequence(F.lit(0), F.col("held") - 1), lambda g2: spot(g2, own_visit, VISITS)
    )
    one = F.array(spot(F.lit(0), F.lit(0), HELD + VISITS))
    single = (F.col("held") == 1) & (F.col("visits") == 1)
    spots = (
        F.when(~F.col("rest"), as_held).when(single, one).otherwise(F.concat(as_held, as_visit))
    )
    rows = rows.withColumn("spot", F.explode(spots)).select(
        F.col("key").alias("g1"), "spot.g2", "spot.g3", "class", "root", "spot.role", "rest", "band"
    )
    rows = rows.join(sets.select("class", "n", "keys", "shingles"), "class")
    return links_in_groups(rows, percent)


def minhash_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = SHINGLE_WORDS,
    percent: int = PERCENT,
    bands: int = BANDS,
    band_rows: int = BAND_ROWS,
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``.

    Rows whose sets of ``words``-word shingles reach ``percent`` hundredths of Jaccard
    similarity are linked. The component is named by the smallest id reachable; null ids are
    passed over, unless there is no other. Null, empty and blank texts have no shingles and are
    linked with nothing; texts of fewer words are one shingle. Repeated rows are returned as
    often as they come. An empty table gives no rows.
    """
    rows = shingle_sets(docs, id_col, text_col, words, bands, band_rows)
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "shingle-sets")
    equal = ["high", "low"]
    classes = stage(
        rows.where("n > 0")
        .groupBy(*equal)
        .agg(
            F.min("row").alias("class"),
            F.min("doc_id").alias("least_id"),
            F.count(F.lit(1)).alias("size"),
        ),
        "classes",
    )
    firsts = rows.join(classes.select("class"), rows["row"] == F.col("class"))
    firsts = stage(firsts.select("class", "n", "keys"), "class-keys").select(
        "class", "n", F.posexplode("keys").alias("band", "key")
    )
    buckets = (
        firsts.groupBy("key")
        .agg(F.min(F.struct("class", "n")).alias("pivot"), F.count(F.lit(1)).alias("size"))
        .where("size > 1")
        .select("key", "pivot.class", F.col("pivot.n").alias("pivot_n"), "size")
        .withColumnRenamed("class", "pivot")
    )
    buckets = stage(buckets, "bands")
    members = join_spread(
        firsts.select("key", "band", "class", "n"), buckets.select("key", "size"), ["key"]
    )
    members = stage(members.select("key", "band", "class", "n"), "band-members")
    wanted = stage(members.select("class").distinct(), "wanted-sets")
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    sets = rows.join(wanted, rows["row"] == F.col("class"))
    sets = stage(sets.select("class", "n", "keys", "shingles"), "band-sets")
    near = stage(_to_pivots(members, buckets, sets, percent), "pivot-links")
    roots = stage(components(near), "pivot-roots")
    rooted = members.join(
        roots.select(F.col("node").alias("class"), "root"), "class", "left"
    ).withColumn("root", F.coalesce("root", "class"))
    more = _to_each_other(stage(rooted, "rooted-members"), sets, percent)
    roots = stage(components(near.union(stage(more, "band-links"))), "roots")

    named = classes.join(
        roots.select(F.col("node").alias("class"), "root"), "class", "left"
    ).withColumn("root", F.coalesce("root", "class"))
    named = stage(named, "rooted-classes")
    least = named.groupBy("root").agg(
        F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("size")
    )
    named = join_spread(named.drop("size"), least, ["root"]).select("class", "component_id")
    named = stage(classes.join(named, "class"), "named-classes")
    linked = join_spread(
        rows.where("n > 0").select("doc_id", "n", *equal),
        named.select(*equal, "component_id", "size"),
        equal,
    ).select("doc_id", "n", "component_id")
    alone = rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.union(alone).select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that name their component, with all their columns.

    Ids are taken to be unique; rows that repeat an id go or stay together.
    """
    kept = minhash_components(docs, id_col, text_col).where("kept")
    return keep_rows(docs, kept.select(F.col("doc_id").alias(id_col)).distinct(), [id_col])
