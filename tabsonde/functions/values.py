"""Column expressions that turn raw columns into measures, yes/no values and labels."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spellings read as yes and no.
YES = ("true", "yes", "1", "1.0", "y", "t")
NO = ("false", "no", "0", "0.0", "n", "f")
# Spellings that make a text column a yes/no column.
YES_NO_WORDS = ("true", "false", "yes", "no", "y", "n", "t", "f")
MISSING = "(missing)"
OTHER = "Other"

INTEGER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)
NUMERIC_TYPES = (*INTEGER_TYPES, *FLOAT_TYPES, T.DecimalType)
TIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)
COMPLEX_TYPES = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)


def quoted(name: str) -> str:
    """A top-level column by its exact name, dots and spaces included."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literals(texts: Iterable[str]) -> str:
    return ", ".join(literal(t) for t in texts)


# The readers below take and return SQL text: a wide table needs hundreds of them, and one
# parsed expression is far cheaper to build than a tree of Column calls.


def known(sql: str, dtype: T.DataType) -> str:
    """The value with NaN treated as missing."""
    if isinstance(dtype, FLOAT_TYPES):
        return f"nullif({sql}, CAST('NaN' AS {dtype.simpleString()}))"
    return sql


def number(sql: str, dtype: T.DataType) -> str:
    """Numeric reading of a column; text that does not parse is missing."""
    if isinstance(dtype, (T.BooleanType, *NUMERIC_TYPES)):
        return known(f"CAST({sql} AS DOUBLE)", T.DoubleType())
    if isinstance(dtype, T.StringType):
        return known(f"TRY_CAST({sql} AS DOUBLE)", T.DoubleType())
    return "CAST(NULL AS DOUBLE)"


def finite(sql: str) -> str:
    """A double with infinities masked."""
    return f"CASE WHEN abs({sql}) < CAST('Infinity' AS DOUBLE) THEN {sql} END"


def yes_no(sql: str, dtype: T.DataType) -> str:
    """1.0 / 0.0 for the accepted spellings, missing for anything else."""
    if isinstance(dtype, T.BooleanType):
        return f"CAST({sql} AS DOUBLE)"
    word = f"lower(trim(CAST({sql} AS STRING)))"
    return f"CASE WHEN {word} IN ({literals(YES)}) THEN 1D WHEN {word} IN ({literals(NO)}) THEN 0D END"


def text(sql: str, dtype: T.DataType) -> str:
    """Display text of a value; yes/no columns read True / False."""
    if isinstance(dtype, T.BooleanType):
        return f"CASE WHEN {sql} THEN 'True' WHEN NOT {sql} THEN 'False' END"
    if isinstance(dtype, COMPLEX_TYPES):
        return f"to_json(named_struct('v', {sql}))"
    return f"CAST({known(sql, dtype)} AS STRING)"


def label(sql: str, dtype: T.DataType) -> str:
    """Group label of a value, with missing values as their own group."""
    return f"coalesce({text(sql, dtype)}, {literal(MISSING)})"


def correlation(a: str, b: str) -> str:
    """Pearson correlation over complete pairs, missing when either side is constant."""
    x, y = f"if({b} IS NOT NULL, {a}, NULL)", f"if({a} IS NOT NULL, {b}, NULL)"
    return f"try_divide(covar_pop({x}, {y}), stddev_pop({x}) * stddev_pop({y}))"
