"""One typed, folded, bucketed projection of a table on which many hypotheses run."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hypotheses
from .frame import Fold, Frame, code_of, fold_plans
from .hypotheses import Spec
from .ranks import Cuts, find_cuts, with_buckets


@dataclass(frozen=True)
class TestBed:
    __test__ = False  # not a pytest class

    frame: Frame
    base: DataFrame
    cuts: Mapping[str, Cuts]
    numbers: Mapping[str, str]  # column name -> double column of the base
    codes: Mapping[str, str]  # dimension name -> folded group code
    outcomes: Mapping[str, str]  # yes/no column name -> 0/1 code
    levels: Mapping[str, str]  # dimension name -> unfolded level code
    folds: Mapping[str, Fold] = field(default_factory=dict)

    @classmethod
    def build(
        cls,
        frame: Frame,
        measures: Sequence[str],
        dimensions: Sequence[str],
        folds: Mapping[str, Fold] | None = None,
        raw_levels: Mapping[str, tuple[str, ...]] | None = None,
    ) -> TestBed:
        measures = list(dict.fromkeys(measures))
        dimensions = list(dict.fromkeys(dimensions))
        folds = fold_plans(frame, dimensions) if folds is None else folds
        numbers = {m: f"n{i}" for i, m in enumerate(measures)}
        codes = {d: f"g{i}" for i, d in enumerate(dimensions)}
        outcomes = {m: f"b{i}" for i, m in enumerate(measures) if frame.is_binary(m)}
        levels = {d: f"s{i}" for i, d in enumerate(raw_levels or {})}
        base = frame.df.selectExpr(
            *[f"{frame.measure_sql(m)} AS {c}" for m, c in numbers.items()],
            *[f"CAST({frame.measure_sql(m)} AS SMALLINT) AS {c}" for m, c in outcomes.items()],
            *[f"{folds[d].code(frame.label_sql(d))} AS {c}" for d, c in codes.items()],
            *[f"{code_of(frame.raw_label_sql(d), raw_levels[d])} AS {c}" for d, c in levels.items()],
        )
        cuts = find_cuts(base, list(numbers.values()), frame.n_rows)
        return cls(
            frame, with_buckets(base, cuts), cuts, numbers, codes, outcomes, levels, dict(folds)
        )

    def group_spec(self, test: int, metric: str, dimension: str) -> Spec:
        if self.frame.is_binary(metric):
            return Spec(test, "rate", self.outcomes[metric], self.codes[dimension])
        return Spec(test, "kruskal", self.numbers[metric], self.codes[dimension])

    def number_spec(self, test: int, metric: str, driver: str) -> Spec:
        if self.frame.is_binary(metric):
            return Spec(test, "mann_whitney", self.outcomes[metric], self.numbers[driver])
        return Spec(test, "spearman", self.numbers[metric], self.numbers[driver])

    def pair_spec(self, test: int, a: str, b: str) -> Spec:
        return Spec(test, "cramers_v", self.codes[b], self.codes[a])

    def run(self, specs: Sequence[Spec]) -> DataFrame:
        whole = {c for d, c in self.codes.items() if self.folds[d].whole}
        return hypotheses.run_specs(self.base, specs, self.cuts, whole)


def single_test(frame: Frame, kind: str, y: str, x: str) -> DataFrame:
    """One hypothesis by column names: group (y by x), number (y over x) or pair (x, y)."""
    y, x = frame.resolve(y), frame.resolve(x)
    if kind == "number":
        bed = TestBed.build(frame, [y, x], [])
        return bed.run([bed.number_spec(0, y, x)]).drop("test")
    if kind == "group":
        bed = TestBed.build(frame, [y], [x])
        return bed.run([bed.group_spec(0, y, x)]).drop("test")
    bed = TestBed.build(frame, [], [x, y])
    return bed.run([bed.pair_spec(0, x, y)]).drop("test")


def named(results: DataFrame, names: Mapping[int, Mapping[str, str]]) -> DataFrame:
    """Attach the descriptive columns of each test number (one row per hypothesis)."""
    spark = results.sparkSession
    fields = list(next(iter(names.values())))
    rows = [(t, *[v[f] for f in fields]) for t, v in names.items()]
    schema = "test int, " + ", ".join(f"{f} string" for f in fields)
    return results.join(F.broadcast(spark.createDataFrame(rows, schema)), "test")
