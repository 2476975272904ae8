"""Distributed ranks, order statistics and exact quantiles.

A global ``orderBy`` window would pull every row into one task. Instead values are cut into
buckets at approximate quantiles; bucket totals give each bucket its starting rank, and only
rows of one bucket are sorted together. A value that is common enough to appear as two cuts
gets a bucket of its own ("solo"): all its rows tie, so their rank follows from the bucket
total and they need no sorting, and they are spread over salted partitions. No window
partition therefore holds more than about two buckets' share of the rows, whatever the skew.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values

ROWS_PER_BUCKET = 1_000_000
MIN_BUCKETS = 16
# Sketches of the map tasks are merged in so many groups first, then the groups.
SKETCH_GROUPS = 256
MIN_SKETCH, MAX_SKETCH = 2_048, 65_535
SALTS = 256
# Small side of a join that may be broadcast: rows are known from bucket and test counts.
BROADCAST_ROWS = 200_000
# Sorted rows get a partition per bucket where there are more buckets than this.
FEW_BUCKETS = 2 * MIN_BUCKETS
# How many quantiles are looked at to tell a column of few values, and how many different rows of
# such columns are worth counting before they are sorted.
LEVEL_PROBES = 1_000
FEW_LEVELS, FEW_ROWS = 400, 200_000


@dataclass(frozen=True)
class Cuts:
    """Bucket edges of one numeric column and the buckets that hold a single value.

    ``levels`` tells about how many values the column has, None if they are many or not known.
    """

    edges: tuple[float, ...]
    solo: tuple[int, ...]
    levels: int | None = None

    @property
    def buckets(self) -> int:
        return len(self.edges) - 1


def bucket_count(n_rows: int) -> int:
    return max(MIN_BUCKETS, n_rows // ROWS_PER_BUCKET)


def cuts_from(points: Iterable[float] | None) -> Cuts:
    points = [p + 0.0 for p in points or () if p is not None and not math.isinf(p)]
    repeated = {a for a, b in zip(points, points[1:], strict=False) if a == b}
    inner = set(points) | {math.nextafter(v, math.inf) for v in repeated}
    edges = (-math.inf, *sorted(inner), math.inf)
    solo = tuple(i for i, e in enumerate(edges) if e in repeated)
    return Cuts(edges, solo)


def repeating(columns: Iterable[Cuts]) -> bool:
    """Whether rows of these columns are few different ones, as far as the sketches tell."""
    levels = [c.levels for c in columns]
    return None not in levels and math.prod(levels) <= FEW_ROWS


def cut_points(
    df: DataFrame, columns: Mapping[str, Column], buckets: int
) -> dict[str, list[float] | None]:
    """Approximate quantiles of several columns, used as bucket edges; None without values."""
    at = [[i / buckets for i in range(1, buckets)]]
    return {name: found[0] for name, found in _quantiles(df, columns, buckets, at).items()}


def _quantiles(
    df: DataFrame, columns: Mapping[str, Column], buckets: int, probs: Sequence[Sequence[float]]
) -> dict[str, list[list[float] | None]]:
    """Approximate quantiles of several columns, one list for each of ``probs``.

    Sketches are merged in two levels, so no task merges more than a share of the map tasks'
    sketches. How good the edges are only decides how even the buckets are.
    """
    size = F.lit(min(MAX_SKETCH, max(MIN_SKETCH, 4 * buckets)))
    names = {name: f"p{i}" for i, name in enumerate(columns)}
    group = F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("sketch_group")
    wide = df.select(*[c.cast("double").alias(names[n]) for n, c in columns.items()], group)
    sketches = wide.groupBy("sketch_group").agg(
        *[F.call_function("kll_sketch_agg_double", F.col(p), size).alias(p) for p in names.values()]
    )
    merged = sketches.agg(
        *[F.call_function("kll_merge_agg_double", F.col(p)).alias(p) for p in names.values()]
    )
    at = [F.expr(f"array({', '.join(f'{p!r}D' for p in ps)})") for ps in probs]
    found = merged.select(
        *[
            F.when(
                F.call_function("kll_sketch_get_n_double", F.col(p)) > 0,
                F.call_function("kll_sketch_get_quantile_double", F.col(p), ps),
            ).alias(f"{p}_{k}")
            for p in names.values()
            for k, ps in enumerate(at)
        ]
    ).first()
    return {name: [found[f"{p}_{k}"] for k in range(len(at))] for name, p in names.items()}


def find_cuts(df: DataFrame, columns: Sequence[str], n_rows: int) -> dict[str, Cuts]:
    """Bucket edges of several double columns in one aggregation."""
    columns = list(columns)
    if not columns:
        return {}
    buckets = bucket_count(n_rows)
    edges = [i / buckets for i in range(1, buckets)]
    probes = [i / LEVEL_PROBES for i in range(LEVEL_PROBES + 1)]
    found = _quantiles(df, {c: values.col(c) for c in columns}, buckets, [edges, probes])
    out = {}
    for c in columns:
        points, seen = found[c]
        levels = len(set(seen or ()))
        out[c] = replace(cuts_from(points), levels=levels if levels <= FEW_LEVELS else None)
    return out


def bucket_name(column: str) -> str:
    return f"{column}__bucket"


def with_buckets(df: DataFrame, cuts: Mapping[str, Cuts]) -> DataFrame:
    """Adds ``<column>__bucket``; buckets of a single value are numbered below zero.

    Negative zero becomes zero first: the two are one value, but a search tells them apart.
    """
    df = df.withColumns({c: values.col(c) + F.lit(0.0) for c in cuts})
    cut = {c: k for c, k in cuts.items() if k.buckets > 1}
    if cut:
        df = Bucketizer(
            splitsArray=[list(k.edges) for k in cut.values()],
            inputCols=list(cut),
            outputCols=[bucket_name(c) for c in cut],
            handleInvalid="keep",
        ).transform(df)
    columns = {}
    for c, k in cuts.items():
        if k.buckets <= 1:
            columns[bucket_name(c)] = F.lit(0)
            continue
        bucket = values.col(bucket_name(c)).cast("int")
        columns[bucket_name(c)] = (
            F.when(bucket.isin(*k.solo), -bucket).otherwise(bucket) if k.solo else bucket
        )
    return df.withColumns(columns)


def maybe_broadcast(df: DataFrame, rows_bound: int) -> DataFrame:
    return F.broadcast(df) if rows_bound <= BROADCAST_ROWS else df


def bucket_offsets(
    rows: DataFrame, keys: Sequence[str], bucket: str, n: str, descending: bool = False
) -> DataFrame:
    """Rows per (keys, bucket), rows in lower buckets and rows per keys."""
    out = shared_offsets(rows, keys, bucket, [n], descending)
    return out.withColumnsRenamed({"bucket_n_0": "bucket_n", "offset_0": "offset", "total_0": "total"})


def shared_offsets(
    rows: DataFrame, keys: Sequence[str], bucket: str, ns: Sequence[str], descending: bool = False
) -> DataFrame:
    """The same for several counts of the rows at once: bucket_n_k, offset_k and total_k."""
    totals = rows.groupBy(*keys, bucket).agg(
        *[F.sum(n).alias(f"bucket_n_{k}") for k, n in enumerate(ns)]
    )
    position = F.abs(F.col(bucket))
    order = Window.partitionBy(*keys).orderBy(position.desc() if descending else position.asc())
    whole = Window.partitionBy(*keys)
    out = []
    for k in range(len(ns)):
        own = F.col(f"bucket_n_{k}")
        out += [
            own,
            (F.sum(own).over(order) - own).alias(f"offset_{k}"),
            F.sum(own).over(whole).alias(f"total_{k}"),
        ]
    return totals.select(*keys, bucket, *out)


def with_ranks(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    bucket: str,
    n: str = "n",
    salt_on: Sequence[str] = (),
    rows_bound: int = 0,
    descending: bool = False,
) -> DataFrame:
    """Adds ``before`` (rows ranked ahead), ``ties`` and ``total`` to pre-counted rows.

    The average rank is ``before + (ties + 1) / 2``.
    """
    out = with_shared_ranks(rows, keys, value, bucket, [n], salt_on, rows_bound, descending)
    return out.withColumnsRenamed({f"{c}_0": c for c in ("before", "ties", "total")})


def with_shared_ranks(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    bucket: str,
    ns: Sequence[str],
    salt_on: Sequence[str] = (),
    rows_bound: int = 0,
    descending: bool = False,
) -> DataFrame:
    """``before_k``, ``ties_k`` and ``total_k`` for several counts of the same rows.

    The rows are sorted once; the k-th ranks are those among the rows that ``ns[k]`` counts.
    """
    offsets = shared_offsets(rows, keys, bucket, ns, descending)
    solo = F.col(bucket) < 0
    salt = F.pmod(F.xxhash64(*salt_on), F.lit(SALTS)).cast("int") if salt_on else F.lit(0)
    salted = rows.withColumn("salt", F.when(solo, salt).otherwise(F.lit(0)))
    if FEW_BUCKETS < rows_bound <= BROADCAST_ROWS:
        # What a task sorts is then a bucket or a few, however many rows there are.
        salted = salted.repartition(rows_bound, *keys, bucket, "salt")
    order = Window.partitionBy(*keys, bucket, "salt").orderBy(
        F.col(value).desc() if descending else F.col(value).asc()
    )
    upto = order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    tied = order.rangeBetween(Window.currentRow, Window.currentRow)
    ranked = salted.withColumns(
        {f"upto_{k}": F.sum(n).over(upto) for k, n in enumerate(ns)}
        | {f"tied_{k}": F.sum(n).over(tied) for k, n in enumerate(ns)}
    )
    if rows_bound <= BROADCAST_ROWS:
        joined = ranked.join(F.broadcast(offsets), [*keys, bucket])
    else:
        # The salt of the rows is part of the key, so that they stay where the window put them.
        salts = F.sequence(F.lit(0), F.lit(SALTS - 1 if salt_on else 0))
        every = F.explode(F.when(solo, salts).otherwise(F.array(F.lit(0))))
        joined = ranked.join(offsets.withColumn("salt", every), [*keys, bucket, "salt"])
    out = joined.withColumns(
        {
            f"ties_{k}": F.when(solo, F.col(f"bucket_n_{k}")).otherwise(F.col(f"tied_{k}"))
            for k in range(len(ns))
        }
        | {
            f"before_{k}": F.col(f"offset_{k}")
            + F.when(solo, F.lit(0)).otherwise(F.col(f"upto_{k}") - F.col(f"tied_{k}"))
            for k in range(len(ns))
        }
    )
    used = ("upto", "tied", "bucket_n", "offset")
    return out.drop("salt", *[f"{c}_{k}" for c in used for k in range(len(ns))])


def average_rank(k: int | None = None) -> Column:
    end = "" if k is None else f"_{k}"
    return F.col(f"before{end}") + (F.col(f"ties{end}") + 1) / 2


def value_counts(
    df: DataFrame, keys: Sequence[str], value: str, bucket: str, n: str | None = None
) -> DataFrame:
    count = F.count("*") if n is None else F.sum(n)
    return df.groupBy(*keys, bucket, value).agg(count.alias("n"))


def avg_rank(df: DataFrame, value: str, n_rows: int, descending: bool = False) -> DataFrame:
    """(value, n, before, ties, avg_rank) for the distinct values of one double column."""
    cuts = find_cuts(df, [value], n_rows)
    cut = with_buckets(df.where(values.col(value).isNotNull()).select(values.col(value)), cuts)
    counts = value_counts(cut.withColumn("test", F.lit(0)), ["test"], value, bucket_name(value))
    ranked = with_ranks(
        counts, ["test"], value, bucket_name(value), "n", (), cuts[value].buckets, descending
    )
    return ranked.withColumn("avg_rank", average_rank()).drop("test", bucket_name(value))


def attach_by_value(
    df: DataFrame, key: str, lookup: DataFrame, lookup_key: str, cuts: Cuts
) -> DataFrame:
    """Left join on a number that may be missing or extremely common.

    Rows of a common value (those with a solo bucket) are spread over salts and the lookup
    row is repeated per salt; rows without a value get keys that match nothing.
    """
    hot = [cuts.edges[i] for i in cuts.solo]
    # A hash of the row, so that a task that runs again places its rows alike.
    spread = F.pmod(F.xxhash64(*[values.col(c) for c in df.columns]), F.lit(SALTS)).cast("int")
    is_hot = F.col(key).isin(*hot) if hot else F.lit(False)
    left = df.withColumn(
        "join_salt",
        F.when(F.col(key).isNull(), -1 - spread).when(is_hot, spread).otherwise(F.lit(0)),
    )
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    hot_lookup = F.col(lookup_key).isin(*hot) if hot else F.lit(False)
    right = lookup.withColumn(
        "lookup_salt", F.explode(F.when(hot_lookup, salts).otherwise(F.array(F.lit(0))))
    ).withColumnRenamed(lookup_key, "lookup_key")
    match = (F.col(key) == F.col("lookup_key")) & (F.col("join_salt") == F.col("lookup_salt"))
    return left.join(right, match, "left").drop("join_salt", "lookup_salt", "lookup_key")


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    bucket: str,
    probs: Sequence[float],
    rows_bound: int,
) -> DataFrame:
    """Linear-interpolation quantiles per key: one row (keys, n, q0, q1, ...).

    Bucket totals tell which buckets hold the wanted order statistics; only the rows of those
    buckets are counted and sorted, so the shuffle carries a few buckets' share of the data.
    """
    known = df.where(F.col(value).isNotNull()).withColumn("n", F.lit(1))
    offsets = bucket_offsets(known, keys, bucket, "n")
    low = [F.floor((F.col("total") - 1) * F.lit(p)) for p in probs]
    high = [F.ceil((F.col("total") - 1) * F.lit(p)) for p in probs]

    def holds(start: Column, end: Column, position: Column) -> Column:
        return (start <= position) & (position < end)

    start, end = F.col("offset"), F.col("offset") + F.col("bucket_n")
    wanted = F.lit(False)
    for position in (*low, *high):
        wanted = wanted | holds(start, end, position)
    chosen = maybe_broadcast(offsets.where(wanted), rows_bound)
    counts = value_counts(
        known.join(chosen.select(*keys, bucket), [*keys, bucket], "left_semi"), keys, value, bucket
    )
    order = Window.partitionBy(*keys, bucket).orderBy(value)
    upto = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = (
        counts.withColumn("upto", upto)
        .join(chosen, [*keys, bucket])
        .withColumn("end", F.col("offset") + F.col("upto"))
        .withColumn("start", F.col("end") - F.col("n"))
    )
    picked = placed.groupBy(*keys).agg(
        F.max("total").alias("total"),
        *[
            F.max(F.when(holds(F.col("start"), F.col("end"), k), F.col(value))).alias(f"{side}{i}")
            for side, positions in (("lo", low), ("hi", high))
            for i, k in enumerate(positions)
        ],
    )
    out = []
    for i, p in enumerate(probs):
        part = (F.col("total") - 1) * F.lit(p)
        part = part - F.floor(part)
        gap = F.when(part == 0, 0.0).otherwise(part * (F.col(f"hi{i}") - F.col(f"lo{i}")))
        out.append((F.col(f"lo{i}") + gap).alias(f"q{i}"))
    return picked.select(*keys, F.col("total").alias("n"), *out)
