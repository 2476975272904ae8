"""Tidying and sampling of whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InputError
from ..functions import values
from .frame import Frame, Where


#: Hexadecimal digits of a digest, those that a round looks at, and what sorts behind them all.
DIGEST_DIGITS, ROUND_DIGITS, DIGEST_END = 32, 4, "g"
#: A border of so many rows is ordered as it is.
BORDER_ROWS = 10_000


def drop_blank_rows(df: DataFrame) -> DataFrame:
    """Rows with at least one value (NaN counts as missing)."""
    present = " OR ".join(
        f"({values.known(values.quoted(f.name), f.dataType)}) IS NOT NULL" for f in df.schema.fields
    )
    return df.where(present) if present else df


def drop_blank_columns(df: DataFrame) -> DataFrame:
    """Columns with at least one value, found in one aggregate."""
    counts = df.selectExpr(
        *[
            f"count({values.known(values.quoted(f.name), f.dataType)}) AS c{i}"
            for i, f in enumerate(df.schema.fields)
        ]
    ).first()
    return df.select(*[values.col(c) for c, n in zip(df.columns, counts, strict=True) if n])


def trim_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def tidy(df: DataFrame) -> DataFrame:
    """Drop blank rows and columns, trim names; fails when nothing is left.

    One aggregate counts the blank rows and the values of each column. Rows are filtered only
    if there are blank ones: the filter reads every column, whatever is selected later.
    """
    present = {f.name: values.known(values.quoted(f.name), f.dataType) for f in df.schema.fields}
    if not present:
        raise InputError("EMPTY_DATASET", "The dataset has no rows or no columns.")
    blank = " AND ".join(f"({v}) IS NULL" for v in present.values())
    counts = df.selectExpr(
        f"count_if({blank}) AS blank", *[f"count({v}) AS c{i}" for i, v in enumerate(present.values())]
    ).first()
    filled = [values.col(c) for c, n in zip(present, counts[1:], strict=True) if n]
    if not filled:
        raise InputError("EMPTY_DATASET", "The dataset has no rows or no columns.")
    kept = drop_blank_rows(df) if counts["blank"] else df
    return trim_names(kept.select(*filled))


def _cut(digests: DataFrame, n: int) -> tuple[str, int]:
    """Up to which prefix of ``digest`` rows are among the n smallest: (prefix, rows of it).

    Rows before the prefix are, rows behind it are not, and of those that have it so many are.
    A round counts rows by the next few digits; only the prefix at the border is looked into.
    """
    prefix, wanted = "", n
    while len(prefix) < DIGEST_DIGITS:
        upto = len(prefix) + ROUND_DIGITS
        near = digests.where(F.col("digest").startswith(prefix)) if prefix else digests
        counts = near.groupBy(F.left("digest", F.lit(upto)).alias("head")).count().collect()
        for head, count in sorted(counts):
            if count >= wanted:
                break
            wanted -= count
        else:
            return prefix + DIGEST_END, 0  # all rows are wanted
        prefix = head
        if count <= BORDER_ROWS:
            break
    return prefix, wanted


def sample_rows(df: DataFrame, n: int, keys: Sequence[str], seed: int = 0) -> DataFrame:
    """At most n rows, the same ones however the table is partitioned, in the order of the keys.

    They have the smallest digests of seed and key. A histogram of the digests gives the limit,
    the rest is a filter; only the few rows whose digests begin like the limit are ordered.
    """
    named = [F.coalesce(values.col(k).cast("string"), F.lit("")) for k in keys]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *named))
    if n <= 0:
        return df.limit(0)
    prefix, rows = _cut(df.select(digest.alias("digest")), n)
    chosen = df.where(digest < prefix)
    if rows:
        border = df.where(digest.startswith(prefix))
        # Rows of one key go by their other columns, so that partitions have no say in it.
        others = [
            f.name for f in df.schema.fields
            if f.name not in keys and not isinstance(f.dataType, values.COMPLEX_TYPES)
        ]
        order = [values.col(k) for k in (*keys, *others)]
        chosen = chosen.union(border.orderBy(digest, *order).limit(rows))
    return chosen.orderBy(*[values.col(k) for k in keys])


def equality_filter(frame: Frame, column: str, value: str) -> DataFrame:
    """Rows whose column equals a value, ignoring case and blanks around the value."""
    return frame.subset(Where(column, value)).df


def yes_no_column(frame: Frame, column: str, output: str = "yes_no") -> DataFrame:
    name = frame.resolve(column)
    sql = values.yes_no(values.quoted(name), frame.dtype(name))
    return frame.df.withColumn(output, F.expr(sql))


def numeric_column(frame: Frame, column: str, output: str = "number") -> DataFrame:
    """The table with a numeric reading of a column; text that does not parse is missing."""
    name = frame.resolve(column)
    return frame.df.withColumn(output, frame.measure(name))
