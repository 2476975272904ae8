"""The table under analysis together with the facts every analysis needs about it."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import AnalysisError
from ..functions import dates, values

ROWS = "__rows__"  # pseudo-metric: number of records
# Level folding and minimum group size.
MAX_GROUPS = 12
MIN_GROUP_ROWS = 20
MIN_GROUP_SHARE = 0.01
SUGGESTED_VALUES = 8


@dataclass(frozen=True)
class Where:
    """Keep the rows whose column equals a value, ignoring case."""

    column: str
    value: str


@dataclass(frozen=True)
class Frame:
    """A DataFrame, its yes/no columns, its time column and its unfiltered row count.

    ``n_rows`` stays that of the whole table when a filter is applied, so that the minimum
    group size does not shrink with the subset.
    """

    df: DataFrame
    n_rows: int
    binaries: frozenset[str] = frozenset()
    time: str | None = None
    sampled_from: int | None = None
    filter: str | None = None

    @classmethod
    def of(
        cls,
        df: DataFrame,
        binaries: Iterable[str] = (),
        time: str | None = None,
        n_rows: int | None = None,
        sampled_from: int | None = None,
    ) -> Frame:
        rows = df.count() if n_rows is None else n_rows
        return cls(df, rows, frozenset(binaries), time, sampled_from)

    @property
    def min_group(self) -> int:
        return max(MIN_GROUP_ROWS, round(MIN_GROUP_SHARE * self.n_rows))

    def resolve(self, name: str | None, what: str = "column") -> str:
        found = resolve_column(self.df.columns, name)
        if found is None:
            raise AnalysisError(f"Unknown {what} column {name!r}. Use a name from the profile.")
        return found

    def dtype(self, name: str) -> T.DataType:
        return self.df.schema[name].dataType

    def is_binary(self, name: str) -> bool:
        return name in self.binaries

    def measure(self, name: str) -> Column:
        """Numeric reading of a column; 1.0 for the record-count pseudo-metric."""
        return F.expr(self.measure_sql(name))

    def measure_sql(self, name: str) -> str:
        if name == ROWS:
            return "1D"
        reader = values.yes_no if self.is_binary(name) else values.number
        return reader(values.quoted(name), self.dtype(name))

    def need_numbers(self, name: str) -> None:
        """Fails for a column without a single number; stops at the first one it finds."""
        if self.df.where(self.measure(name).isNotNull()).limit(1).isEmpty():
            raise AnalysisError(f"{name!r} has no numbers to work with.")

    def raw_label(self, name: str) -> Column:
        return F.expr(self.raw_label_sql(name))

    def raw_label_sql(self, name: str) -> str:
        return values.text(values.quoted(name), self.dtype(name))

    def label(self, name: str) -> Column:
        return F.expr(self.label_sql(name))

    def label_sql(self, name: str) -> str:
        return values.label(values.quoted(name), self.dtype(name))

    def when(self) -> Column:
        if self.time is None:
            raise AnalysisError("The dataset has no date column, so trends can't be computed.")
        return dates.as_time(values.col(self.time), self.dtype(self.time))

    def subset(self, where: Where | None) -> Frame:
        """The frame restricted to a filter; fails with the frequent values if nothing matches."""
        if where is None:
            return self
        column = self.resolve(where.column, "filter")
        wanted = where.value.strip()
        spelled = self.raw_label(column)
        match = F.lower(spelled) == wanted.lower()
        found = self.df.where(match).agg(F.min(spelled).alias("v")).first()["v"]
        if found is None:
            frequent = (
                self.df.where(spelled.isNotNull())
                .groupBy(spelled.alias("v"))
                .count()
                .orderBy(F.desc("count"), "v")
                .limit(SUGGESTED_VALUES)
            )
            options = ", ".join(r["v"] for r in frequent.collect())
            raise AnalysisError(
                f"No rows where {column} = {where.value!r}. Values include: {options}."
            )
        return replace(self, df=self.df.where(match), filter=f"{column} = {found}")


def resolve_column(names: Iterable[str], wanted: str | None) -> str | None:
    """Exact match first, then ignoring case and surrounding blanks."""
    if not wanted:
        return None
    names = list(names)
    if wanted in names:
        return wanted
    folded = wanted.strip().casefold()
    return next((n for n in names if n.casefold() == folded), None)


@dataclass(frozen=True)
class Fold:
    """Which labels of a dimension stay; the others become 'Other' or are left out."""

    column: str
    keep: tuple[str, ...]
    other: bool
    whole: bool = False  # no row is left out

    @property
    def groups(self) -> tuple[str, ...]:
        extra = (values.OTHER,) if self.other and values.OTHER not in self.keep else ()
        return (*self.keep, *extra)

    def apply(self, label: str) -> str:
        """SQL text of the folded label."""
        rest = values.literal(values.OTHER) if self.other else "CAST(NULL AS STRING)"
        if not self.keep:
            return rest
        return f"CASE WHEN {label} IN ({values.literals(self.keep)}) THEN {label} ELSE {rest} END"

    def code(self, label: str) -> str:
        """Small integer of the folded label, missing for rows that are left out."""
        return code_of(self.apply(label), self.groups)


def code_of(label: str, levels: tuple[str, ...]) -> str:
    if not levels:
        return "CAST(NULL AS SMALLINT)"
    position = f"array_position(array({values.literals(levels)}), {label})"
    return f"CAST(nullif({position}, 0) AS SMALLINT)"


def label_counts(frame: Frame, columns: list[str], drop_missing: bool = False) -> DataFrame:
    """(column, label, n) for several columns in one pass with map-side partial counts."""
    reader = frame.raw_label_sql if drop_missing else frame.label_sql
    wide = frame.df.selectExpr(*[f"{reader(c)} AS l{i}" for i, c in enumerate(columns)])
    long = wide.unpivot([], wide.columns, "slot", "label")
    names = F.create_map(*[F.lit(x) for i, c in enumerate(columns) for x in (f"l{i}", c)])
    counts = long.where("label IS NOT NULL").groupBy("slot", "label").agg(F.count("*").alias("n"))
    return counts.select(F.element_at(names, F.col("slot")).alias("column"), "label", "n")


def fold_plans(frame: Frame, columns: list[str]) -> dict[str, Fold]:
    """Level folding of every given dimension, decided in one aggregation.

    Only the at most twelve kept labels per dimension reach the driver; the window filter is
    pushed below the shuffle as a per-partition group limit.
    """
    columns = list(dict.fromkeys(columns))
    if not columns:
        return {}
    counts = label_counts(frame, columns)
    order = Window.partitionBy("column").orderBy(F.desc("n"), "label")
    top = counts.where(F.col("n") >= frame.min_group).withColumn("rank", F.row_number().over(order))
    kept: dict[str, list] = {c: [] for c in columns}
    for r in top.where(F.col("rank") <= MAX_GROUPS).orderBy("column", "rank").collect():
        kept[r["column"]].append((r["label"], r["n"]))
    rows = frame.n_rows if frame.filter is None else frame.df.count()
    plans = {}
    for c in columns:
        own_other = sum(n for v, n in kept[c] if v == values.OTHER)
        folded = rows - sum(n for _, n in kept[c]) + own_other
        other, all_kept = folded >= frame.min_group, folded == own_other
        plans[c] = Fold(c, tuple(v for v, _ in kept[c]), other, other or all_kept)
    return plans


def lump_levels(frame: Frame, column: str, output: str = "level") -> DataFrame:
    """The table with a folded copy of one dimension."""
    column = frame.resolve(column, "dimension")
    plan = fold_plans(frame, [column])[column]
    return frame.df.withColumn(output, F.expr(plan.apply(frame.label_sql(column))))
