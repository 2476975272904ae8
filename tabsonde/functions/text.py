"""Numbers as display text, all as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# ``format_number`` rounds a double by its exact value, a half to even, as printf does;
# ``format_string`` rounds the shortest digits that name it, so that 0.15, which is less than it
# says, becomes 0.2.


def three_digits(value: Column) -> Column:
    """A number rounded to three significant digits (the built-in round needs a fixed scale)."""
    value = value.cast("double")
    shown = F.call_function("format_number", value, F.lit("0.00E0"))
    return F.when(F.abs(value) < float("inf"), shown.cast("double")).otherwise(value)


def _fixed(value: Column, pattern: str) -> Column:
    return F.call_function("format_number", value.cast("double"), F.lit(pattern))


def number_sql(v: str) -> str:
    """SQL text of a compact number: B / M / K from 10,000, at most two decimals, three digits
    below one."""
    digits = f"CAST(format_number({v}, '0.00E0') AS DOUBLE)"
    trimmed = r"regexp_replace({}, '[.]?0+$', '')"
    plain = trimmed.format(f"CAST(CAST({digits} AS DECIMAL(12, 7)) AS STRING)")
    tiny = f"regexp_replace(format_string('%.2e', {digits}), '[.]?0*e', 'e')"
    return (
        f"CASE WHEN {v} IS NULL THEN NULL "
        f"WHEN abs({v}) >= 1e9 THEN concat(format_number({v} / 1e9D, '0.0'), 'B') "
        f"WHEN abs({v}) >= 1e6 THEN concat(format_number({v} / 1e6D, '0.0'), 'M') "
        f"WHEN abs({v}) >= 1e4 THEN concat(format_number({v} / 1e3D, '0.0'), 'K') "
        f"WHEN {v} = floor({v}) THEN format_string('%,d', CAST({v} AS BIGINT)) "
        f"WHEN abs({v}) >= 100 THEN format_string('%,.0f', {v}) "
        f"WHEN abs({v}) >= 1 THEN {trimmed.format(f"format_number({v}, '0.00')")} "
        f"WHEN abs({digits}) >= 1e-4 THEN {plain} ELSE {tiny} END"
    )


def percent_sql(v: str) -> str:
    return f"replace(concat(format_number({v}, '0.0'), '%'), '.0%', '%')"


def value_sql(v: str, kind: str) -> str:
    """SQL text of a value shown as kind (a column of percent | correlation | number)."""
    return (
        f"CASE WHEN {kind} = 'percent' THEN {percent_sql(v)} "
        f"WHEN {kind} = 'correlation' THEN format_number({v}, '0.00') ELSE {number_sql(v)} END"
    )


def with_text(df: DataFrame, shown: dict[str, str], kind: str) -> DataFrame:
    """Adds display text columns (output name -> double column) for values of one kind column."""
    return df.withColumns({k: F.expr(value_sql(v, kind)) for k, v in shown.items()})


def format_percent(value: Column) -> Column:
    return F.replace(F.concat(_fixed(value, "0.0"), F.lit("%")), F.lit(".0%"), F.lit("%"))


def ratio_text(ratio: Column) -> Column:
    return F.concat(_fixed(ratio, "0.0"), F.lit("×"))


def pct_change(new: Column, old: Column) -> Column:
    change = (F.try_divide(new.cast("double"), old.cast("double")) - 1) * 100
    return F.when(old == 0, F.lit("n/a")).otherwise(F.concat(_fixed(change, "+0;-0"), F.lit("%")))
