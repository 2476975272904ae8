"""Best-fit packing of tokenised documents into sequences of one length.

Documents are tokenised where they lie. Lengths are whole numbers up to the sequence length, so
all documents are described by one count per length, a table of bounded size. A best-fit plan of
those counts is the incumbent: around the largest length left, the filling of least waste is used
as often as the counts allow. Where the plan is above the lower bound, bin completion takes its
most wasteful sequences together: around the largest length it branches over the undominated
fillings, and cuts what cannot beat the incumbent by a bound on the waste of all that is left.
Spark then deals the pieces to the places of this short plan by their rank inside their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, stage, text_of

SEQUENCE_TOKENS = 2048
#: Steps that the search of one filling may take before its incumbent is used.
SEARCH_STEPS = 4000
#: Steps that bin completion may take for one set of sequences, and for all sets of a plan.
SET_STEPS, PLAN_STEPS = 100_000, 1_000_000
#: Sequences that bin completion takes together, at most.
SET_SEQUENCES = 128
#: Pieces that one window partition ranks, about.
RANKED_TOGETHER = 200_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def gpt_tokenizer(json_path: str, ranks_path: str):
    """A function from text to token ids, equal to the tokenizer in ``json_path``.

    The fast encoder reads the same vocabulary as ranks. A text that spells out a special token
    goes to the tokenizer itself.
    """
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(json_path)
    special = [t.content for t in slow.get_added_tokens_decoder().values()]
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )

    def encode(text: str) -> list[int]:
        if any(t in text for t in special):
            return slow.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def tokenised_pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokens: int = SEQUENCE_TOKENS,
    end_id: int = 0,
    tokenizer: str = "byte_bpe_50k",
) -> DataFrame:
    """Pieces of at most ``tokens`` ids: doc_id, piece, start, length, ids_crc32.

    ``tokenizer`` names the pair of vocabulary files; they are read on the executors. Only a
    document longer than a sequence is cut, and then only its first piece may be shorter.
    """

    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encode = gpt_tokenizer(
            public_tokenizers.path(f"{tokenizer}.json"),
            public_tokenizers.path(f"{tokenizer}.tiktoken"),
        )
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = np.array([*encode(text.as_py()), end_id], "<u4")
                first = (len(ids) - 1) % tokens + 1
                edges = [0, *range(first, len(ids) + 1, tokens)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):  # noqa: B905
                    row = (doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                arrays, ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return texts.mapInArrow(cut, PIECES)


@dataclass
class Pattern:
    """``times`` sequences that each hold ``counts`` pieces of every length in it."""

    counts: list[tuple[int, int]]
    times: int


def best_filling(
    room: int, sizes: list[int], left: np.ndarray, steps: int = SEARCH_STEPS
) -> list[tuple[int, int]]:
    """(length, how often) of the filling of ``room`` that wastes least.

    ``sizes`` are the lengths that are left, descending. The first descent takes the largest
    that fits again and again: best fit, the incumbent. Branches with fewer of the current
    length follow, smaller lengths in its place. A branch whose lengths together cannot leave
    less waste than the incumbent is cut.
    """
    below = np.zeros(len(sizes) + 1, np.int64)
    for k in range(len(sizes) - 1, -1, -1):
        below[k] = below[k + 1] + sizes[k] * int(left[sizes[k]])
    best_waste, best, budget = room, [], steps
    first_fit = np.searchsorted(-np.array(sizes), -np.arange(room + 1))
    stack: list[tuple[int, int, tuple]] = [(room, 0, ())]
    while stack and best_waste and budget:
        budget -= 1
        rest, at, taken = stack.pop()
        if rest < best_waste:
            best_waste, best = rest, list(taken)
        at = max(at, int(first_fit[rest]))
        if not rest or at >= len(sizes) or rest - min(rest, int(below[at])) >= best_waste:
            continue
        size = sizes[at]
        most = min(rest // size, int(left[size]))
        stack.append((rest, at + 1, taken))
        for n in range(1, most + 1):
            stack.append((rest - n * size, at + 1, (*taken, (size, n))))
    return best


def best_fit_patterns(counts: dict[int, int], tokens: int = SEQUENCE_TOKENS) -> list[Pattern]:
    """Patterns that place ``counts[length]`` pieces of every length, largest lengths first.

    Each pattern at least halves what is left of one length, so patterns number at most
    tokens * log2(largest count), and none holds more than sqrt(2 * tokens) different lengths.
    """
    left = np.zeros(tokens + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    patterns = []
    for size in range(tokens, 0, -1):
        while left[size]:
            left[size] -= 1
            sizes = [int(s) for s in np.flatnonzero(left[: tokens - size + 1])[::-1]]
            found = dict(best_filling(tokens - size, sizes, left))
            left[size] += 1
            found[size] = found.get(size, 0) + 1
            times = min(int(left[s]) // n for s, n in found.items())
            for s, n in found.items():
                left[s] -= n * times
            patterns.append(Pattern(sorted(found.items(), reverse=True), times))
    return patterns


def least_sequences(left: np.ndarray, tokens: int) -> int:
    """A lower bound on the sequences that hold ``left[length]`` pieces of every length.

    For every limit k: lengths above tokens - k stand alone, those above half a sequence need one
    each, and what their room cannot take of the lengths from k to a half needs more.
    """
    size = np.arange(tokens + 1)
    number = np.concatenate([np.cumsum(left[::-1])[::-1], [0]])
    total = np.concatenate([np.cumsum((left * size)[::-1])[::-1], [0]])
    half = tokens // 2 + 1
    k = np.arange(half)
    alone = tokens - k + 1
    room = (number[half] - number[alone]) * tokens - (total[half] - total[alone])
    over = np.maximum(total[k] - total[half] - room, 0)
    return int((number[half] + -(-over // tokens)).max())


def is_dominated(filling: list[tuple[int, int]], waste: int, free: int) -> bool:
    """Whether a piece outside the filling could stand for some of its pieces.

    ``free`` has a bit for every length with a piece outside. A piece dominates if it is longer
    than one or more pieces by at most ``waste``, or as long as two or more. (No pieces at all
    count as well: then something still fits.)
    """
    sums, of_two = 1, 0
    for size, n in filling:
        for _ in range(n):
            of_two |= of_two << size | (sums & ~1) << size
            sums |= sums << size
    reach, width = sums, 1
    while width < waste:
        step = min(width, waste - width)
        reach |= reach << step
        width += step
    return bool(of_two & free or waste and reach << 1 & free)


def undominated_fillings(
    room: int, left: np.ndarray, slack: int, steps: int = SEARCH_STEPS
) -> tuple[list[list[tuple[int, int]]], int]:
    """The undominated fillings of ``room`` that waste at most ``slack``, least waste first, and
    the steps taken. After ``steps`` of them, those found."""
    sizes = [int(s) for s in np.flatnonzero(left[: room + 1])[::-1]]
    below = [0] * (len(sizes) + 1)
    for k in range(len(sizes) - 1, -1, -1):
        below[k] = below[k + 1] + sizes[k] * int(left[sizes[k]])
    every = sum(1 << size for size in sizes)
    found, taken_steps = [], 0
    stack: list[tuple[int, int, tuple]] = [(room, 0, ())]
    while stack and taken_steps < steps:
        taken_steps += 1
        rest, at, taken = stack.pop()
        while at < len(sizes) and sizes[at] > rest:
            at += 1
        if rest - min(rest, below[at]) > slack:
            continue
        if at == len(sizes):
            free = every
            for size, n in taken:
                if n == left[size]:
                    free &= ~(1 << size)
            if not is_dominated(taken, rest, free):
                found.append((rest, len(found), list(taken)))
            continue
        size = sizes[at]
        for n in range(min(rest // size, int(left[size])) + 1):
            stack.append((rest - n * size, at + 1, (*taken, (size, n)) if n else taken))
    return [filling for _, _, filling in sorted(found)], taken_steps


def complete_bins(
    counts: dict[int, int], tokens: int, fewer_than: int, steps: int = SET_STEPS
) -> tuple[list[list[tuple[int, int]]] | None, int]:
    """Fillings that hold all pieces in fewer than ``fewer_than`` sequences, and the steps taken.

    The least number if the steps suffice; None if there are none (or none was found in time).
    """
    left = np.zeros(tokens + 1, np.int64)
    for size, n in counts.items():
        left[size] = n
    best: list[list[tuple[int, int]]] | None = None
    least, limit, used = least_sequences(left, tokens), fewer_than, 0
    seen: dict[bytes, int] = {}
    path: list[list[tuple[int, int]]] = []

    def descend() -> None:
        nonlocal best, limit, used
        sizes = np.flatnonzero(left)
        if not len(sizes):
            best, limit = [list(f) for f in path], len(path)
            return
        if len(path) + least_sequences(left, tokens) >= limit:
            return
        key = left.tobytes() if tokens < 64 else np.stack([sizes, left[sizes]]).tobytes()
        if seen.get(key, limit) <= len(path):
            return
        seen[key] = len(path)
        size = int(sizes[-1])
        left[size] -= 1
        slack = (limit - 1 - len(path)) * tokens - int(left[sizes] @ sizes) - size
        fillings, taken = undominated_fillings(tokens - size, left, slack)
        used += taken
        for filling in fillings:
            if limit <= least or used >= steps:
                break
            for s, n in filling:
                left[s] -= n
            path.append([(size, 1), *filling])
            descend()
            path.pop()
            for s, n in filling:
                left[s] += n
        left[size] += 1

    descend()
    return best, used


def as_pattern(filling: list[tuple[int, int]], times: int) -> Pattern:
    """A filling, in which a length may stand twice, as a pattern."""
    counts: dict[int, int] = {}
    for size, n in filling:
        counts[size] = counts.get(size, 0) + n
    return Pattern(sorted(counts.items(), reverse=True), times)


def plan_patterns(counts: dict[int, int], tokens: int = SEQUENCE_TOKENS) -> list[Pattern]:
    """Patterns that place ``counts[length]`` pieces of every length in few sequences.

    The best-fit plan, if it needs no more than the lower bound. Else bin completion takes ever
    more of its patterns, the most wasteful first, at most SET_SEQUENCES sequences together: as
    many of each as is its share of them, or one, two, four of each. A set that needs fewer sequences is replaced as often as the plan
    holds it. A plan of at most SET_SEQUENCES is searched whole: it is the least, if the steps
    suffice. Every replacement takes up a whole pattern or saves half the sequences it could, and
    the steps end, so the patterns stay few.
    """
    left = np.zeros(tokens + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    patterns, least = best_fit_patterns(counts, tokens), least_sequences(left, tokens)
    steps = PLAN_STEPS

    def improved() -> bool:
        nonlocal patterns, steps
        patterns.sort(key=lambda p: sum(s * n for s, n in p.counts))
        tried = set()
        for most in (0, 1, 2, 4, SET_SEQUENCES):
            width = 1
            while steps > 0:
                taken = [(p, min(p.times, most)) for p in patterns[:width]]
                if not most:
                    share = -(-sum(p.times for p in patterns[:width]) // SET_SEQUENCES)
                    taken = [(p, p.times // share) for p in patterns[:width] if p.times >= share]
                number = sum(n for _, n in taken)
                if number > SET_SEQUENCES:
                    break
                if (width, number) not in tried:
                    tried.add((width, number))
                    pieces: dict[int, int] = {}
                    for p, n in taken:
                        for s, m in p.counts:
                            pieces[s] = pieces.get(s, 0) + m * n
                    found, used = complete_bins(pieces, tokens, number, min(SET_STEPS, steps))
                    steps -= used
                    if found:
                        times = min(p.times // n for p, n in taken)
                        for p, n in taken:
                            p.times -= n * times
                        patterns = [p for p in patterns if p.times]
                        patterns += [as_pattern(f, times) for f in found]
                        return True
                if width >= len(patterns):
                    break
                width = min(2 * width, len(patterns))
        return False

    while steps > 0 and sum(p.times for p in patterns) > least and improved():
        pass
    return patterns


def places(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """For runs of ranks inside a length, where they go:
    (length, first rank, ranks, pieces per sequence, first sequence, offset of the first)."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for p in patterns:
        offset = 0
        for length, n in p.counts:
            first = used.get(length, 0)
            out.append((length, first, n * p.times, n, sequence, offset))
            used[length] = first + n * p.times
            offset += length * n
        sequence += p.times
    return out


def pack(pieces: DataFrame, tokens: int = SEQUENCE_TOKENS) -> DataFrame:
    """``pieces`` with sequence_id and offset.

    Needs doc_id, piece, start and length (1 to ``tokens``). Repeated rows are placed one by
    one. No piece is dropped; an empty table gives no rows.
    """
    pieces = stage(pieces, "pieces")
    spark = pieces.sparkSession
    # At most ``tokens`` rows.
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    buckets = max(16, sum(counts.values()) // RANKED_TOGETHER)
    # Bounded by ``tokens`` and the logarithm of the number of documents (plan_patterns).
    where = spark.createDataFrame(
        places(plan_patterns(counts, tokens)),
        "place_length long, first_rank long, ranks long, per_sequence long, "
        "first_sequence long, first_offset long",
    )
    dealt = pieces.withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int")
    )
    # Ranks inside a length without gathering a length: whole buckets first, then inside them.
    by_bucket = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    bases = by_bucket.select(
        "length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")
    ranked = (
        dealt.withColumn("place", F.row_number().over(inside) - 1)
        .join(bases, ["length", "bucket"])
        .withColumn("rank", F.col("base") + F.col("place"))
    )
    here = (
        (F.col("length") == F.col("place_length"))
        & (F.col("rank") >= F.col("first_rank"))
        & (F.col("rank") < F.col("first_rank") + F.col("ranks"))
    )
    step = F.col("rank") - F.col("first_rank")
    return (
        ranked.join(F.broadcast(where), here)
        .withColumn("step", step)
        .select(
            *[c for c in pieces.columns],
            (F.col("first_sequence") + F.expr("step div per_sequence")).alias("sequence_id"),
            (F.col("first_offset") + F.expr("step % per_sequence") * F.col("length")).alias(
                "offset"
            ),
        )
    )


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: int = SEQUENCE_TOKENS
) -> DataFrame:
    """Tokenise and pack: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text counts as empty (its only id is the end). Null ids stay null. Other columns
    are ignored, whatever their names.
    """
    return pack(tokenised_pieces(docs, id_col, text_col, tokens), tokens)
