"""Moments of all pairs of numeric columns from one scan.

Each task adds up masked Gram matrices: with missing values set to zero and a mask of what is
there, products of whole matrices give the counts, sums and products of every pair over the
rows where both are known. A task returns one row per pair, and these are summed; no row of the
table is repeated per pair. Correlations of the columns, and of sums, differences and products
of two columns with a target, follow from the sums by algebra.

Values are taken from a starting point of their column, so that large values with a small spread
lose no digits. A column that varies by less than the rounding of its sums counts as constant; a
formula whose terms nearly cancel is marked, for its caller to look at the rows themselves.
"""

from __future__ import annotations

import math
import operator
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Executors need not have this package installed: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Sums over the rows where both columns (and the target) are known; x and z are the columns.
PAIR_SUMS = ("n", "x", "z", "xx", "zz", "xz")
#: Further sums with a target y: of the target itself, and what products x * z need.
TARGET_SUMS = ("y", "yy", "xy", "zy", "xzy", "xxz", "xzz", "xxzz")
#: Variances below this share of their sums of squares are rounding.
ROUNDING = 1e-12
#: Sums and differences that keep less than this share of their terms' squares are not exact.
CANCELLED = 1e-6
#: Rows that the starting points are taken from.
FIRST_ROWS = 64
#: What joins two columns, and how many formulas are worked out on a batch at once.
OPERATIONS = {"minus": operator.sub, "plus": operator.add, "times": operator.mul}
FORMULAS_AT_ONCE = 128


@dataclass(frozen=True)
class Moments:
    """One row (target, i, j, sums) per target and pair i <= j of the columns."""

    table: DataFrame
    columns: tuple[str, ...]
    targets: tuple[str, ...]
    starts: tuple[float, ...]


def _starts(wide: DataFrame) -> list[float]:
    """The middle one of a column's first values, zero where none is seen."""
    rows = wide.limit(FIRST_ROWS).collect()
    seen = (
        sorted(r[k] for r in rows if r[k] is not None and math.isfinite(r[k]))
        for k in range(len(wide.columns))
    )
    return [values[len(values) // 2] if values else 0.0 for values in seen]


def pair_moments(wide: DataFrame, columns: Sequence[str], targets: Sequence[str] = ()) -> Moments:
    """Moments of all pairs of the double ``columns`` of ``wide``, with each of ``targets``.

    Infinite and NaN values are missing. With targets, only rows where the target is known count,
    and its sums are added. A task holds a few matrices with a cell per pair, whatever the number
    of rows.
    """
    columns, targets = tuple(columns), tuple(targets)
    used = list(dict.fromkeys([*columns, *targets]))
    wide = wide.select(*used)
    starts = dict(zip(used, _starts(wide), strict=True))
    names = (*PAIR_SUMS, *(TARGET_SUMS if targets else ()))
    every = list(range(len(targets))) or [-1]
    width, shift = len(columns), np.array([starts[c] for c in columns])
    upper = np.triu_indices(width)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {t: np.zeros((len(names), len(upper[0]))) for t in every}
        for batch in batches:
            if not batch.num_rows:
                continue
            found = {c: batch[c].to_numpy(zero_copy_only=False) for c in used}
            x = np.column_stack([found[c] for c in columns]) - shift
            for t in every:
                z, y = x, None
                if t >= 0:
                    y = found[targets[t]] - starts[targets[t]]
                    known = np.isfinite(y)
                    z, y = x[known], y[known][:, None]
                mask = np.isfinite(z)
                z, mask = np.where(mask, z, 0.0), mask.astype(float)
                square, single = z * z, z.T @ mask
                parts = [
                    mask.T @ mask, single, single.T, square.T @ mask, mask.T @ square, z.T @ z
                ]
                if y is not None:
                    with_y, cubed = (z * y).T @ mask, square.T @ z
                    parts += [
                        (mask * y).T @ mask, (mask * (y * y)).T @ mask, with_y, with_y.T,
                        (z * y).T @ z, cubed, cubed.T, square.T @ square,
                    ]
                for k, part in enumerate(parts):
                    sums[t][k] += part[upper]
        for t, table in sums.items():
            keys = [np.full(len(upper[0]), t), *upper]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(k.astype(np.int32)) for k in keys), *map(pa.array, table)],
                ["target", "i", "j", *names],
            )

    schema = "target int, i int, j int, " + ", ".join(f"{n} double" for n in names)
    table = wide.mapInArrow(read, schema).groupBy("target", "i", "j").agg(
        *[F.sum(n).alias(n) for n in names]
    )
    return Moments(table, columns, targets, tuple(starts[c] for c in columns))


def _centred(ab: str | Column, a: str | Column, b: str | Column) -> Column:
    """Sum of products about the means, from sums of n rows."""
    ab, a, b = (F.col(c) if isinstance(c, str) else c for c in (ab, a, b))
    return ab - F.try_divide(a * b, F.col("n"))


def _spread(total: Column, squares: Column) -> Column:
    """A sum of squares about the mean, null where it is nothing but rounding."""
    return F.when(total > ROUNDING * squares, total)


def _ratio(shared: Column, one: Column, other: Column) -> Column:
    r = F.try_divide(shared, F.sqrt(one) * F.sqrt(other))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)) + F.lit(0.0)


def correlations(moments: Moments) -> DataFrame:
    """(i, j, r, n) of every pair of different columns; r is null where one is constant."""
    x = _spread(_centred("xx", "x", "x"), F.col("xx"))
    z = _spread(_centred("zz", "z", "z"), F.col("zz"))
    r = F.when(x.isNotNull() & z.isNotNull(), _ratio(_centred("xz", "x", "z"), x, z))
    return moments.table.where("i < j").select(
        "i", "j", r.alias("r"), F.col("n").cast("long").alias("n")
    )


def formula_correlations(moments: Moments) -> DataFrame:
    """(target, i, j, operation, r, exact, n): targets against columns and formulas of two columns.

    Operations are ``same`` (j is null), ``minus``, ``plus`` and ``times``. What is not ``exact``
    lost digits, because its terms nearly cancel.
    """
    starts = numbered([float(s) for s in moments.starts])
    table = moments.table.withColumns({"a": starts[F.col("i")], "b": starts[F.col("j")]})
    y = _spread(_centred("yy", "y", "y"), F.col("yy"))
    vx, vz, vxz = _centred("xx", "x", "x"), _centred("zz", "z", "z"), _centred("xz", "x", "z")
    vxy, vzy = _centred("xy", "x", "y"), _centred("zy", "z", "y")
    a, b = F.col("a"), F.col("b")
    # x and z stand for (a + x) and (b + z): their product is a constant and p.
    p = a * F.col("z") + b * F.col("x") + F.col("xz")
    py = a * F.col("zy") + b * F.col("xy") + F.col("xzy")
    pp = (
        a * a * F.col("zz") + b * b * F.col("xx") + F.col("xxzz")
        + 2 * (a * b * F.col("xz") + a * F.col("xzz") + b * F.col("xxz"))
    )
    both = F.col("xx") + F.col("zz")

    def against(operation: str, spread: Column, squares: Column, shared: Column) -> Column:
        varies = _spread(spread, squares)
        r = F.when(varies.isNotNull() & y.isNotNull(), _ratio(shared, varies, y))
        exact = F.lit(True) if operation == "same" else spread > CANCELLED * squares
        return F.struct(
            F.lit(operation).alias("operation"),
            r.alias("r"),
            (F.coalesce(exact, F.lit(True)) | (squares == 0)).alias("exact"),
        )

    alone = F.array(against("same", vx, F.col("xx"), vxy))
    pairs = F.array(
        against("minus", vx + vz - 2 * vxz, both, vxy - vzy),
        against("plus", vx + vz + 2 * vxz, both, vxy + vzy),
        against("times", _centred(pp, p, p), pp, _centred(py, p, "y")),
    )
    return table.select(
        "target", "i", F.when(F.col("i") != F.col("j"), F.col("j")).alias("j"),
        F.inline(F.when(F.col("i") == F.col("j"), alone).otherwise(pairs)),
        F.col("n").cast("long").alias("n"),
    )


@dataclass(frozen=True)
class Formula:
    """A target and two columns that an operation joins."""

    target: str
    a: str
    b: str
    operation: str


def row_correlations(wide: DataFrame, formulas: Sequence[Formula]) -> DataFrame:
    """(formula, r, n): targets against formulas worked out row by row, all from one scan.

    Formulas go by their place. A task returns one row per formula: sums about the means of its own
    rows, taken from the first value it sees, so that values that hardly differ lose no digits. No
    row of the table is repeated per formula.
    """
    used = list(dict.fromkeys(c for f in formulas for c in (f.target, f.a, f.b)))
    names = ("n", "y0", "c0", "y", "c", "yy", "cc", "yc")
    chunks = [
        (start, formulas[start : start + FORMULAS_AT_ONCE])
        for start in range(0, len(formulas), FORMULAS_AT_ONCE)
    ]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(names), len(formulas)))
        sums[1:3] = np.nan
        for batch in batches:
            if not batch.num_rows:
                continue
            found = {c: batch[c].to_numpy(zero_copy_only=False) for c in used}
            finite = {c: np.isfinite(v) for c, v in found.items()}
            for start, chunk in chunks:
                known = np.column_stack([finite[f.target] & finite[f.a] & finite[f.b] for f in chunk])
                y = np.column_stack([found[f.target] for f in chunk])
                with np.errstate(all="ignore"):
                    c = np.column_stack(
                        [OPERATIONS[f.operation](found[f.a], found[f.b]) for f in chunk]
                    )
                    _add(sums[:, start : start + len(chunk)], known, y, c)
        sums[1:3] = np.nan_to_num(sums[1:3])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(formulas), dtype=np.int32)), *map(pa.array, sums)],
            ["formula", *names],
        )

    schema = "formula int, " + ", ".join(f"{n} double" for n in names)
    parts = wide.select(*used).mapInArrow(read, schema).where("n > 0")
    # One row per formula and task: their means are moved to a common start, then compared.
    whole = Window.partitionBy("formula")
    for c in ("y", "c"):
        parts = parts.withColumn(c, F.col(f"{c}0") - F.min(f"{c}0").over(whole) + F.col(c))
        mean = F.sum(F.col("n") * F.col(c)).over(whole) / F.sum("n").over(whole)
        parts = parts.withColumn(c, F.col(c) - mean)
    n, y, c = F.col("n"), F.col("y"), F.col("c")
    summed = parts.groupBy("formula").agg(
        F.sum(F.col("yy") + n * y * y).alias("yy"),
        F.sum(F.col("cc") + n * c * c).alias("cc"),
        F.sum(F.col("yc") + n * y * c).alias("yc"),
        F.sum("n").cast("long").alias("n"),
    )
    r = F.try_divide(F.col("yc"), F.sqrt("yy") * F.sqrt("cc"))
    every = wide.sparkSession.range(len(formulas)).select(F.col("id").cast("int").alias("formula"))
    return F.broadcast(every).join(summed, "formula", "left").select(
        "formula", r.alias("r"), F.coalesce("n", F.lit(0).cast("long")).alias("n")
    )


def _add(sums: np.ndarray, known: np.ndarray, y: np.ndarray, c: np.ndarray) -> None:
    """Add rows to sums about means (one column per formula), in place."""
    n, y0, c0, *_ = sums
    for start, values in ((y0, y), (c0, c)):
        first = values[known.argmax(axis=0), np.arange(values.shape[1])]
        new = np.isnan(start) & known.any(axis=0)
        start[new] = first[new]
    y, c = np.where(known, y - y0, 0.0), np.where(known, c - c0, 0.0)
    more = known.sum(axis=0).astype(float)
    safe = np.maximum(more, 1.0)
    mean_y, mean_c = y.sum(axis=0) / safe, c.sum(axis=0) / safe
    y, c = np.where(known, y - mean_y, 0.0), np.where(known, c - mean_c, 0.0)
    gap_y, gap_c = np.where(more, mean_y - sums[3], 0.0), np.where(more, mean_c - sums[4], 0.0)
    total = np.maximum(n + more, 1.0)
    weight = n * more / total
    sums[5] += (y * y).sum(axis=0) + weight * gap_y * gap_y
    sums[6] += (c * c).sum(axis=0) + weight * gap_c * gap_c
    sums[7] += (y * c).sum(axis=0) + weight * gap_y * gap_c
    sums[3] += gap_y * more / total
    sums[4] += gap_c * more / total
    sums[0] += more


def numbered(names: Sequence[str | float]) -> Column:
    """A map from the numbers of columns to their ``names``."""
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(n)) for k, n in enumerate(names)))
