"""Language-model scores by context-tree weighting over bytes.

A text is read as its lower-cased words with one space between and an end. Every byte is eight
yes/no decisions; each decision is made at a node for every depth of context, from none to
``depth`` bytes. A node counts zeros and ones over the training texts (Krichevsky-Trofimov) and
is mixed with its children by the weights that context-tree weighting gives them. The counts of
all depths follow from the counts of (depth + 1)-byte strings, so that these are all that is
gathered. Contexts that share their nearest bytes form a subtree, and tasks weight the subtrees
side by side; the few levels above them are Spark aggregations, joined from the root down. What
results is one logarithm per string that occurs; scoring looks them up: frequent strings and
words in tables of bounded size held by every task, all others by a join.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import chain
from math import log, log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stage, text_of

DEPTH = 6
#: Depth from which on a subtree is weighted in one task, and bytes of text to a task's subtrees.
TOP = 3
SUBTREE_BYTES = 1 << 23
HELD_OUT_PARTS, HELD_OUT = 7, 2
END = b"\n"
#: Most strings and words that every task holds; all others are joined.
HELD_STRINGS = 1_300_000
HELD_WORDS = 150_000
#: Bytes and distinct words that a task works on at a time.
PORTION_BYTES = 1 << 20
#: Strings that are counted at a time, and bytes that are looked up at a time.
WAITING_STRINGS = 1 << 21
LOOK_UP_BYTES = 1 << 17
FLUSH_WORDS = 200_000
PORTION_KEYS = 1 << 17
#: Rows of a batch of packed strings.
PACKED_ROWS = 8

LN_PI = log(np.pi)
LN_HALF = log(0.5)


def words_of(text: str) -> list[bytes]:
    """Words with A-Z in lower case; only ASCII white space separates."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def is_held_out(doc_id: int | None) -> bool:
    if doc_id is None:
        return False
    return zlib.crc32(str(doc_id).encode()) % HELD_OUT_PARTS == HELD_OUT


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about PORTION_BYTES of text each, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy().astype(np.int64)
        upto = np.cumsum(sizes) // PORTION_BYTES
        edges = np.flatnonzero(np.append(True, upto[1:] != upto[:-1])) if len(upto) else []
        for low, high in zip(edges, [*edges[1:], len(upto)], strict=True):
            yield batch.slice(low, high - low)


def strings_of(
    texts: list[list[bytes]], depth: int, block: int = PORTION_BYTES
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, string) for the bytes of the texts, ``block`` at a time.

    A string is the byte (lowest) under its context, the nearest byte highest. Before a text
    stand ends.
    """
    pad = END * depth
    written = [b" ".join(words) + END for words in texts]
    data = b"".join([*(pad + t for t in written), bytes(8)])
    sizes = np.array([len(t) + depth for t in written], np.int64)
    owner = np.repeat(np.arange(len(written)), sizes)
    real = np.ones(len(owner), bool)
    starts = np.cumsum(sizes) - sizes
    real[(starts[:, None] + np.arange(depth)[None, :]).ravel()] = False
    context, above = np.uint64((1 << (8 * depth)) - 1), np.uint64(8 * depth)
    for low in range(depth, len(owner), block):
        high = min(low + block, len(owner))
        # Eight bytes from every place on, the context's farthest byte lowest.
        seen = np.ndarray((high - low,), "<u8", data, low - depth, (1,))
        made = (seen & context) << np.uint64(8)
        made |= (seen >> above) & np.uint64(255)
        kept = real[low:high]
        yield owner[low:high][kept], made[kept]


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    order = np.argsort(keys)
    keys, counts = keys[order], np.concatenate([n for _, n in parts])[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over the training texts of ``texts`` (doc_id, text), the end among the words."""

    def made(words: Counter) -> pa.RecordBatch:
        values = pa.array(list(words.values()), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(list(words), pa.binary()), values], ["word", "n"]
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Counter()
        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                if not is_held_out(doc):
                    words.update(words_of(text.as_py()))
                    words[END] += 1
                if len(words) >= FLUSH_WORDS:
                    yield made(words)
                    words = Counter()
        yield made(words)

    counted = texts.mapInArrow(count, "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


#: Spread contexts of TOP bytes over parts, within what a long holds.
SPREAD, SPREAD_END = 2_654_435_761, 1 << 32


def part_of(context: np.ndarray, parts: int) -> np.ndarray:
    spread = context.astype(np.uint64) * np.uint64(SPREAD) % np.uint64(SPREAD_END)
    return (spread >> np.uint64(8)) % np.uint64(parts)


def part_column(context: str, parts: int) -> Column:
    spread = F.shiftright(F.col(context) * F.lit(SPREAD) % F.lit(SPREAD_END), 8)
    return (spread % F.lit(parts)).cast("int")


def string_counts(texts: DataFrame, depth: int, parts: int) -> DataFrame:
    """(part, strings, counts): a row per part, its strings sorted, as packed numbers.

    Counted are the training texts of ``texts`` (doc_id, text); strings that only held-out
    texts have come with 0. All strings whose contexts agree in TOP bytes are in one part.
    """

    kinds = "part int, strings binary, counts binary"

    def packed(
        strings: np.ndarray, n: np.ndarray, part: np.ndarray
    ) -> Iterator[pa.RecordBatch]:
        """A row per part, its strings in order; few rows to a batch, for they are long."""
        order = np.argsort(part, kind="stable")
        part, strings, n = part[order], strings[order], n[order]
        edges = np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)])
        cut = list(zip(edges, np.append(edges[1:], len(part)), strict=True)) if len(part) else []
        for low in range(0, len(cut), PACKED_ROWS):
            here = cut[low : low + PACKED_ROWS]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(part[a]) for a, _ in here], pa.int32()),
                    pa.array([strings[a:b].tobytes() for a, b in here], pa.binary()),
                    pa.array([n[a:b].tobytes() for a, b in here], pa.binary()),
                ],
                ["part", "strings", "counts"],
            )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, waiting = [], ([], [])

        def settle() -> None:
            """Count the strings that wait; what is counted is added up when it has doubled."""
            learnt, unseen = (np.concatenate(w) if w else np.empty(0, np.uint64) for w in waiting)
            unseen = np.unique(unseen)
            found.append(np.unique(learnt, return_counts=True))
            found.append((unseen, np.zeros(len(unseen), np.int64)))
            for w in waiting:
                w.clear()
            if sum(len(k) for k, _ in found[1:]) > len(found[0][0]):
                found[:] = [_summed(found)]

        for batch in portions(batches):
            split = [words_of(t.as_py()) for t in batch["text"]]
            trains = np.array([not is_held_out(d) for d in batch["doc_id"].to_pylist()], bool)
            for owner, made in strings_of(split, depth):
                learns = trains[owner]
                waiting[0].append(made[learns])
                waiting[1].append(made[~learns])
                if sum(map(len, chain(*waiting))) >= WAITING_STRINGS:
                    settle()
        settle()
        if found:
            strings, n = _summed(found)
            del found
            yield from packed(strings, n, part_of(strings ^ (strings >> np.uint64(29)), parts))

    def unpacked(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
        return [
            (np.frombuffer(s.as_py(), np.uint64), np.frombuffer(n.as_py(), np.int64))
            for s, n in zip(table["strings"], table["counts"], strict=True)
        ]

    def add_up(table: pa.Table) -> pa.Table:
        strings, n = _summed(unpacked(table))
        near = part_of(strings >> np.uint64(8 * (depth - TOP + 1)), parts)
        return pa.Table.from_batches(packed(strings, n, near))

    def gather(table: pa.Table) -> pa.Table:
        strings, n = _summed(unpacked(table))
        return pa.table(
            {
                "part": pa.array([table["part"][0].as_py()], pa.int32()),
                "strings": pa.array([strings.tobytes()], pa.binary()),
                "counts": pa.array([n.tobytes()], pa.binary()),
            }
        )

    # What the tasks found is added up evenly by string first, so that no task gets a frequent
    # context as often as there are tasks; then each string goes to its context once.
    even = texts.mapInArrow(count, kinds).groupBy("part").applyInArrow(add_up, kinds)
    return even.groupBy("part").applyInArrow(gather, kinds)


def ln_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0: Stirling's series eight further up."""
    y = x + 8
    product = reduce(lambda p, k: p * (x + k), range(1, 8), x)
    series = 1 / (12 * y) - 1 / (360 * y * y * y)
    return (y - 0.5) * F.log(y) - y + 0.5 * log(2 * np.pi) + series - F.log(product)


def ln_kt(a: Column, b: Column) -> Column:
    """ln of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return ln_gamma(a + 0.5) + ln_gamma(b + 0.5) - ln_gamma(a + b + 1.0) - LN_PI


def ln_mixed(own: Column, children: Column) -> Column:
    high = F.greatest(own, children)
    return LN_HALF + high + F.log1p(F.exp(-F.abs(own - children)))


def ln_gamma_array(x: np.ndarray) -> np.ndarray:
    y = x + 8
    product = reduce(lambda p, k: p * (x + k), range(1, 8), x)
    series = 1 / (12 * y) - 1 / (360 * y**3)
    return (y - 0.5) * np.log(y) - y + 0.5 * log(2 * np.pi) + series - np.log(product)


class Subtree:
    """Nodes from depth ``top`` to ``depth`` over strings whose contexts agree in ``top`` bytes.

    ``strings`` is sorted, so at every depth the strings under one node stand together once
    they are ordered by context and byte; nodes are runs of rows, and nothing is searched.
    """

    def __init__(self, strings: np.ndarray, counts: np.ndarray, top: int, depth: int):
        self.top, self.depth = top, depth
        self.keys, self.counts = {depth: strings}, {depth: counts}
        self.up = {}  # rows of the level above, by row
        for d in range(depth - 1, top - 1, -1):
            below = self.keys[d + 1]
            shorter = ((below >> np.uint64(16)) << np.uint64(8)) | (below & np.uint64(255))
            self.keys[d], self.up[d + 1] = np.unique(shorter, return_inverse=True)
            self.counts[d] = np.bincount(self.up[d + 1], self.counts[d + 1], len(self.keys[d]))
        self.a, self.b, self.ln_p, self.own, self.runs, self.starts = {}, {}, {}, {}, {}, {}
        for d in range(depth, top - 1, -1):
            for k in range(8):
                self._weigh(d, k)

    def _weigh(self, d: int, k: int) -> None:
        keys, n, at = self.keys[d], self.counts[d], (d, k)
        node = keys >> np.uint64(8 - k)
        starts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        bit = (keys >> np.uint64(7 - k)) & np.uint64(1)
        self.starts[at] = starts.astype(np.int32)
        sizes = np.diff(np.append(starts, len(keys)))
        self.runs[at] = np.repeat(np.arange(len(starts), dtype=np.int32), sizes)
        b = np.add.reduceat(n * (bit == 1), starts)
        a = np.add.reduceat(n, starts) - b
        kt = ln_gamma_array(a + 0.5) + ln_gamma_array(b + 0.5) - ln_gamma_array(a + b + 1) - LN_PI
        self.a[at], self.b[at] = a, b
        if d == self.depth:
            self.ln_p[at], self.own[at] = kt, np.ones(len(kt))
        else:
            below = self.ln_p.pop((d + 1, k))
            children = np.bincount(self.parents(d + 1, k), below, len(starts))
            self.ln_p[at] = LN_HALF + np.logaddexp(kt, children)
            self.own[at] = np.exp(LN_HALF + kt - self.ln_p[at])

    def parents(self, d: int, k: int) -> np.ndarray:
        """The node of depth d - 1 above each node of depth d."""
        return self.runs[d - 1, k][self.up[d][self.starts[d, k]]]

    def top_nodes(self) -> tuple[np.ndarray, ...]:
        """context, node, a, b and ln_p at depth ``top``, bit after bit."""
        out = []
        for k in range(8):
            at, keys = (self.top, k), self.keys[self.top][self.starts[self.top, k]]
            out.append((keys >> np.uint64(8), self._node(keys, k), self.a[at], self.b[at], self.ln_p[at]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    @staticmethod
    def _node(keys: np.ndarray, k: int) -> np.ndarray:
        return (keys >> np.uint64(8 - k)) & np.uint64((1 << k) - 1) | np.uint64(1 << k)

    def logs(self, fixed: np.ndarray, factor: np.ndarray) -> np.ndarray:
        """log10 of each string's last byte, given what reaches the nodes of ``top_nodes``."""
        total = np.zeros(len(self.keys[self.depth]))
        low = 0
        for k in range(8):
            high = low + len(self.starts[self.top, k])
            x, y = fixed[low:high], factor[low:high]
            low = high
            for d in range(self.top, self.depth + 1):
                at = (d, k)
                if d > self.top:
                    above = self.parents(d, k)
                    x, y = x[above], y[above]
                one = (self.b[at] + 0.5) / (self.a[at] + self.b[at] + 1)
                x, y = x + y * self.own[at] * one, y * (1 - self.own[at])
            bit = (self.keys[self.depth] >> np.uint64(7 - k)) & np.uint64(1)
            one = x[self.runs[self.depth, k]]
            total += np.log10(np.where(bit == 1, one, 1 - one))
        return total


def _unpacked(strings: pa.Scalar, counts: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    n = np.frombuffer(counts.as_py(), np.int64)
    return np.frombuffer(strings.as_py(), np.uint64), n.astype(float)


def tree_logs(counted: DataFrame, depth: int, parts: int) -> DataFrame:
    """(string, log10p, n): the weighted tree's probability of the last byte after its context.

    ``counted`` is what ``string_counts`` returns, staged. A task weights the subtrees of one
    part; the nodes of the levels above are rows.
    """

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in zip(batch["strings"], batch["counts"], strict=True):
                tree = Subtree(*_unpacked(*packed), TOP, depth)
                context, node, a, b, ln_p = tree.top_nodes()
                columns = [context.view(np.int64), node.astype(np.int32), a, b, ln_p]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in columns], ["context", "node", "a", "b", "ln_p"]
                )

    level = counted.select("strings", "counts").mapInArrow(
        weigh, "context long, node int, a double, b double, ln_p double"
    )
    levels = [stage(level, f"level-{TOP}")]
    kt = ln_kt(F.col("a"), F.col("b"))
    for d in range(TOP - 1, -1, -1):
        level = (
            levels[0]
            .groupBy(F.shiftright("context", 8).alias("context"), "node")
            .agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("ln_p").alias("below"))
            .withColumn("kt", kt)
            .withColumn("ln_p", ln_mixed(F.col("kt"), F.col("below")))
            .withColumn("own", F.exp(LN_HALF + F.col("kt") - F.col("ln_p")))
            .select("context", "node", "a", "b", "ln_p", "own")
        )
        levels.insert(0, stage(level, f"level-{d}"))

    # The mixture at the root is linear in what a node says: fixed + factor * P(node).
    one = (F.col("b") + 0.5) / (F.col("a") + F.col("b") + 1.0)
    fixed = F.col("fixed") + F.col("factor") * F.col("own") * one
    factor = F.col("factor") * (1 - F.col("own"))
    above = levels[0].withColumns({"fixed": F.lit(0.0), "factor": F.lit(1.0)})
    for level in levels[1:]:
        passed = above.select(
            F.col("context").alias("parent"),
            F.col("node").alias("parent_node"),
            fixed.alias("fixed"),
            factor.alias("factor"),
        )
        is_parent = (F.shiftright("context", 8) == F.col("parent")) & (
            F.col("node") == F.col("parent_node")
        )
        above = level.join(passed, is_parent).drop("parent", "parent_node")
    reaching = above.select(
        "context", "node", "fixed", "factor", part_column("context", parts).alias("part")
    )

    def descend(strings: pa.Table, nodes: pa.Table) -> pa.Table:
        keys, n = _unpacked(strings["strings"][0], strings["counts"][0])
        tree = Subtree(keys, n, TOP, depth)
        context, node, *_ = tree.top_nodes()
        reached = (nodes["context"].to_numpy().view(np.uint64) << np.uint64(8)) | nodes[
            "node"
        ].to_numpy().astype(np.uint64)
        order = np.argsort(reached)
        at = order[np.searchsorted(reached[order], (context << np.uint64(8)) | node)]
        logs = tree.logs(nodes["fixed"].to_numpy()[at], nodes["factor"].to_numpy()[at])
        return pa.table({"string": keys.view(np.int64), "log10p": logs, "n": n.astype(np.int64)})

    return (
        counted.groupBy("part")
        .cogroup(reaching.groupBy("part"))
        .applyInArrow(descend, "string long, log10p double, n long")
    )


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows of ``counts`` (n) that are frequent enough for there to be at most ``most``."""
    step = F.floor(F.log2("n") * 16).cast("int")
    sizes = counts.where("n > 0").groupBy(step.alias("step")).count().collect()  # under 1,024
    least, total = None, 0
    for r in sorted(sizes, key=lambda r: -r["step"]):
        total += r["count"]
        if total > most:
            break
        least = r["step"]
    return counts.where("n > 0").where(step >= least) if least is not None else counts.limit(0)


class Held:
    """A bounded table from strings to logarithms, searched for whole arrays at once."""

    TRIES = 24

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 1.6))))
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        # A key and its value stand side by side, so that a look-up reads one place.
        self.pairs = np.full((1 << bits, 2), -1, np.int64)
        for low in range(0, len(keys), PORTION_KEYS):
            self._put(keys[low : low + PORTION_KEYS], values[low : low + PORTION_KEYS])

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        here, todo = self.pairs[:, 0], np.arange(len(keys))
        values = values.astype(float).view(np.int64)
        place = self._first(keys)
        for _ in range(self.TRIES):
            free = todo[here[place[todo]] == -1]
            at, first = np.unique(place[free], return_index=True)
            self.pairs[at, 0], self.pairs[at, 1] = keys[free[first]], values[free[first]]
            todo = todo[here[place[todo]] != keys[todo]]
            place[todo] = (place[todo] + 1) & self.mask

    def _first(self, keys: np.ndarray) -> np.ndarray:
        spread = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (spread >> self.shift).astype(np.int64)

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where a key is not held) and which keys are not held."""
        place = self._first(keys)
        seen = np.take(self.pairs, place, axis=0)
        hit = seen[:, 0] == keys
        out = np.where(hit, seen[:, 1].view(float), 0.0)
        missing = np.zeros(len(keys), bool)
        todo = np.flatnonzero(~hit)
        seen = seen[todo]
        for _ in range(self.TRIES):
            free = seen[:, 0] == -1
            missing[todo[free]] = True
            todo = todo[~free]
            if not len(todo):
                break
            place[todo] = (place[todo] + 1) & self.mask
            seen = self.pairs[place[todo]]
            hit = seen[:, 0] == keys[todo]
            out[todo[hit]] = seen[hit, 1].view(float)
            todo, seen = todo[~hit], seen[~hit]
        missing[todo] = True
        return out, missing


def language_scores(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes and
    bits_per_byte for every row of ``docs``.

    ``depth`` is at most 7. Rows whose crc32(id) mod 7 is 2 are held out of training; a null id
    is not. A null text counts as empty: its only token is the end. Repeated rows count and are
    scored as often as they come. An empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    small_batches(docs.sparkSession)
    words = stage(word_counts(texts), "lm-words")
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = max(16, size // SUBTREE_BYTES)
    counted = stage(string_counts(texts, depth, parts), "lm-strings")
    logs = stage(tree_logs(counted, depth, parts), "lm-logs")

    sums = words.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    train_tokens, vocabulary = sums["n"] or 0, sums["v"]
    log_total = log10(train_tokens + vocabulary + 1)

    held = frequent(logs, HELD_STRINGS)
    held = held.select("string", "log10p", "n").toArrow()
    # The most frequent first: these get their places in the table, others go further.
    order = np.argsort(-held["n"].to_numpy(), kind="stable")
    held_strings = held["string"].to_numpy()[order], held["log10p"].to_numpy()[order]
    held = frequent(words, HELD_WORDS).toArrow()
    held_words, held_counts = held["word"].combine_chunks(), held["n"].to_numpy()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Held(*held_strings)
        known = dict(
            zip(held_words.to_pylist(), np.log10(held_counts + 1.0).tolist(), strict=True)
        )
        for batch in portions(batches):
            split = [words_of(t.as_py()) for t in batch["text"]]
            n = len(split)
            base, n_known = np.zeros(n), np.zeros(n, np.int64)
            rare_words = []
            for k, text in enumerate(split):
                found = list(map(known.get, chain(text, [END])))
                lacking = found.count(None)
                n_known[k] = len(found) - lacking
                base[k] = sum(filter(None, found))
                both = zip(chain(text, [END]), found, strict=True) if lacking else ()
                rare_words.append([w for w, v in both if v is None])
            sizes, total = np.zeros(n, np.int64), np.zeros(n)
            rare_strings, owners = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for owner, made in strings_of(split, depth, LOOK_UP_BYTES):
                keys = made.view(np.int64)
                values, missing = table.look_up(keys)
                sizes += np.bincount(owner, minlength=n)
                total += np.bincount(owner, values, n)
                rare_strings.append(keys[missing])
                owners.append(owner[missing])
            edges = np.searchsorted(np.concatenate(owners), np.arange(n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array([len(w) + 1 for w in split], pa.int64()),
                    pa.array(n_known),
                    pa.array(base),
                    pa.array(sizes),
                    pa.array(total),
                    pa.array(rare_words, pa.list_(pa.binary())),
                    pa.ListArray.from_arrays(
                        pa.array(edges), pa.array(np.concatenate(rare_strings))
                    ),
                ],
                ["doc_id", "n_tokens", "known", "base", "n_bytes", "sum", "words", "strings"],
            )

    partly = texts.mapInArrow(
        score,
        "doc_id long, n_tokens long, known long, base double, n_bytes long, sum double, "
        "words array<binary>, strings array<long>",
    )
    # The row number is written with the row, so it is the same whoever reads it.
    partly = stage(partly.withColumn("row", F.monotonically_increasing_id()), "lm-partly")

    rare_words = (
        partly.select("row", F.explode("words").alias("word"))
        .join(words, "word", "left")
        .groupBy(F.col("row").alias("word_row"))
        .agg(
            F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(1.0))).alias("rare_base"),
            F.count("n").alias("rare_known"),
        )
    )
    rare_strings = (
        partly.select("row", F.explode("strings").alias("string"))
        .join(logs, "string")
        .groupBy(F.col("row").alias("string_row"))
        .agg(F.sum("log10p").alias("rare_sum"))
    )
    total = F.col("sum") + F.coalesce("rare_sum", F.lit(0.0))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT_PARTS == HELD_OUT
    return (
        partly.join(rare_words, F.col("row") == F.col("word_row"), "left")
        .join(rare_strings, F.col("row") == F.col("string_row"), "left")
        .select(
            "doc_id",
            F.coalesce(held_out, F.lit(False)).alias("held_out"),
            "n_tokens",
            (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
            F.lit(train_tokens).cast("long").alias("train_tokens"),
            (
                F.col("base")
                + F.coalesce("rare_base", F.lit(0.0))
                - F.col("n_tokens") * F.lit(log_total)
            ).alias("base_score"),
            total.alias("score"),
            "n_bytes",
            (-total / F.lit(log10(2)) / F.col("n_bytes")).alias("bits_per_byte"),
        )
    )
