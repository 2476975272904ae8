"""Reading dates from text, calendar periods and their labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .values import TIME_TYPES

# Accepted date spellings besides ISO 8601, by the shape that all such texts have.
# Trying a format costs far more than a look at the shape, and most texts are no dates.
_DAY = r"[+-]?\d+"
_SLASHES = f"{_DAY}/{_DAY}/{_DAY}"
_CLOCK = f" {_DAY}:{_DAY}"
DATE_FORMATS = {
    "yyyy/M/d": _SLASHES,
    "M/d/yyyy": _SLASHES,
    "d/M/yyyy": _SLASHES,
    "M/d/yyyy H:mm": f"{_SLASHES}{_CLOCK}",
    "M/d/yyyy H:mm:ss": f"{_SLASHES}{_CLOCK}:{_DAY}",
    "d.M.yyyy": rf"{_DAY}\.{_DAY}\.{_DAY}",
    "d-MMM-yyyy": rf"{_DAY}-\D{{1,9}}-{_DAY}",
    "d MMM yyyy": rf"{_DAY} \D{{1,9}} {_DAY}",
    "MMM d, yyyy": rf"\D{{1,9}} {_DAY}, {_DAY}",
    "yyyyMMdd": _DAY,
}
#: No text in these spellings is longer: a number of them has at most 19 digits.
LONGEST_DATE = 128
ISO_START = r"^\s*\d{4}-\d{1,2}(-\d{1,2})?([T ].*)?\s*$"
# Month names and the period length limits in days.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
QUARTER_SPAN_DAYS = 1095
MONTH_SPAN_DAYS = 120


def parse_date(column: Column) -> Column:
    """Timestamp of a text value, missing where no accepted format fits."""
    value = F.trim(column)
    iso = F.when(value.rlike(ISO_START), F.try_to_timestamp(value))
    others = [
        F.when(value.rlike(f"^{shape}$"), F.try_to_timestamp(value, F.lit(f)))
        for f, shape in DATE_FORMATS.items()
    ]
    spelled = F.when(F.length(value) <= LONGEST_DATE, F.coalesce(*others))
    return F.when(value.rlike(r"\d"), F.coalesce(iso, spelled))


def as_time(column: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, TIME_TYPES):
        return column.cast("timestamp_ntz")
    return parse_date(column.cast("string")).cast("timestamp_ntz")


def period_label_date(when: Column, freq: str) -> Column:
    """Date that names the period: its first day, or the closing Monday of a Tue-Mon week."""
    if freq == "week":
        return F.next_day(F.date_sub(when.cast("date"), 1), "Mon")
    return F.trunc(when.cast("date"), freq)


def period_start(label: Column, freq: str) -> Column:
    return F.date_sub(label, 6) if freq == "week" else label


def period_end(label: Column, freq: str) -> Column:
    """First day after the period."""
    if freq == "week":
        return F.date_add(label, 1)
    return F.add_months(label, 1 if freq == "month" else 3)


def period_text(label: Column, freq: str) -> Column:
    if freq == "quarter":
        return F.concat(F.year(label).cast("string"), F.lit(" Q"), F.quarter(label).cast("string"))
    return F.date_format(label, "yyyy-MM" if freq == "month" else "yyyy-MM-dd")


def pick_freq(span_days: int) -> str:
    if span_days > QUARTER_SPAN_DAYS:
        return "quarter"
    return "month" if span_days > MONTH_SPAN_DAYS else "week"


def month_name(month: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MONTHS]), month.cast("int"))


def month_span(first: Column, second: Column) -> Column:
    """Two months as text: a dash for neighbours (December and January too), else '&'."""
    low, high = F.least(first, second), F.greatest(first, second)
    return (
        F.when(high - low == 1, F.concat(month_name(low), F.lit("–"), month_name(high)))
        .when((low == 1) & (high == 12), F.lit("Dec–Jan"))
        .otherwise(F.concat(month_name(low), F.lit(" & "), month_name(high)))
    )
