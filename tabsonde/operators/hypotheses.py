"""Rank-based and chi-square tests, many at a time.

Every kernel takes *long* rows keyed by a test number and returns one row per test, so a
hundred hypotheses cost one scan with map-side partial counts instead of a hundred jobs.
Tests: Kruskal-Wallis, Mann-Whitney, Spearman, chi-square independence with rate ratio and
Cramér's V, chi-square against a uniform split, and Benjamini-Hochberg across a battery.
"""

from __future__ import annotations

from collections.abc import Collection, Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import effects, pvalues
from ..staging import stage
from .ranks import (
    Cuts,
    attach_by_value,
    average_rank,
    bucket_count,
    bucket_name,
    cut_points,
    cuts_from,
    maybe_broadcast,
    repeating,
    with_buckets,
    with_ranks,
    with_shared_ranks,
)

# Tests melted from one scan; more are unioned as further scans.
TESTS_PER_SCAN = 60
# Smallest samples that get a p-value.
MIN_SPEARMAN_ROWS = 5
MIN_KRUSKAL_ROWS = 3
MIN_SIDE_ROWS = 3
SMALLEST_RATE = 1e-9

RESULT_COLUMNS = ("test", "effect_name", "effect", "p_value", "n", "statistic")


@dataclass(frozen=True)
class Spec:
    """One hypothesis over columns of a prepared table.

    kind: kruskal (y number, x group code) | rate (y 0/1, x group code) |
    spearman (y, x numbers) | mann_whitney (y 0/1, x number) | cramers_v (y, x group codes).
    """

    test: int
    kind: str
    y: str
    x: str


def _chunks(items: Sequence, size: int) -> Iterable[Sequence]:
    for start in range(0, len(items), size):
        yield items[start : start + size]


def melt(base: DataFrame, entries: Sequence[Mapping[str, str]]) -> DataFrame:
    """One row per input row and entry; an entry maps output names to SQL text."""
    structs = [
        "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in e.items()) + ")" for e in entries
    ]
    parts = [
        base.selectExpr(f"inline(array({', '.join(c)}))") for c in _chunks(structs, TESTS_PER_SCAN)
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# ---------------------------------------------------------------- rank sums


@dataclass(frozen=True)
class Ranked:
    """A column that is ranked once for all its tests.

    ``tests`` holds a test number and its place in ``groups``, the codes that are compared.
    ``among`` tells whose rows are ranked: all (None), or those where a place in ``groups`` is
    known; tests of one pattern of missing rows share their ranks.
    """

    column: str
    tests: tuple[tuple[int, int], ...]
    groups: tuple[str, ...]
    among: tuple[int | None, ...]

    def pattern(self, place: int) -> int:
        return self.among.index(place if place in self.among else None)


def ranked_columns(
    tests: Sequence[tuple[int, str, str]], whole: Collection[str] = ()
) -> list[Ranked]:
    """(test, column, group code) by column; codes in ``whole`` have no missing rows."""
    by_column: dict[str, list[tuple[int, str]]] = {}
    for test, column, group in tests:
        by_column.setdefault(column, []).append((test, group))
    out = []
    for column, own in by_column.items():
        groups = tuple(dict.fromkeys(g for _, g in own))
        among = dict.fromkeys(None if g in whole else k for k, g in enumerate(groups))
        out.append(Ranked(column, tuple((t, groups.index(g)) for t, g in own), groups, tuple(among)))
    return out


def rank_sums(base: DataFrame, columns: Sequence[Ranked], rows_bound: int) -> DataFrame:
    """(test, g, n, rank_sum, ties, most_ties, total): each column is sorted once, whatever the
    number of its tests."""
    entries = [
        {
            "slot": str(i),
            "bucket": bucket_name(c.column),
            "value": c.column,
            "codes": f"array({', '.join(f'CAST({g} AS INT)' for g in c.groups)})",
        }
        for i, c in enumerate(columns)
    ]
    counts = (
        melt(base, entries)
        .where("value IS NOT NULL AND bucket IS NOT NULL AND exists(codes, c -> c IS NOT NULL)")
        .groupBy("slot", "bucket", "value", "codes")
        .agg(F.count("*").alias("n"))
    )

    def per_slot(what: Sequence[str]) -> str:
        pairs = ", ".join(f"{i}, {w}" for i, w in enumerate(what))
        return f"element_at(map({pairs}), slot)"

    most = max(len(c.among) for c in columns)
    weights = {}
    for k in range(most):
        # -1: the column has no such pattern, 0: all rows, else the place of what must be known.
        place = per_slot(
            ["-1" if k >= len(c.among) else str((-1 if c.among[k] is None else c.among[k]) + 1)
             for c in columns]
        )
        weights[f"n_{k}"] = F.expr(
            f"CASE {place} WHEN -1 THEN 0L WHEN 0 THEN n "
            f"ELSE if(element_at(codes, greatest({place}, 1)) IS NULL, 0L, n) END"
        )
    ranked = with_shared_ranks(
        counts.withColumns(weights), ["slot"], "value", "bucket", list(weights), ("slot", "codes"),
        rows_bound,
    )
    tests = per_slot(
        ["array(" + ", ".join(
            f"named_struct('test', {t}, 'place', {p + 1}, 'pattern', {c.pattern(p) + 1})"
            for t, p in c.tests
        ) + ")" for c in columns]
    )
    pattern = F.col("of.pattern")
    each = ranked.select(
        "n",
        "codes",
        F.array(*[average_rank(k) for k in range(most)]).alias("ranks"),
        F.array(*[F.col(f"ties_{k}").cast("double") for k in range(most)]).alias("tied"),
        F.array(*[F.col(f"total_{k}") for k in range(most)]).alias("totals"),
        F.explode(F.expr(tests)).alias("of"),
    ).select(
        "of.test",
        F.element_at("codes", F.col("of.place")).alias("g"),
        F.col("n").cast("double").alias("n"),
        F.element_at("ranks", pattern).alias("rank"),
        F.element_at("tied", pattern).alias("ties"),
        F.element_at("totals", pattern).alias("total"),
    )
    return _summed(each.where("g IS NOT NULL"))


def melted_rank_sums(rows: DataFrame, rows_bound: int) -> DataFrame:
    """The same for rows (test, bucket, value, g) that are long already."""
    counts = (
        rows.where("value IS NOT NULL AND g IS NOT NULL AND bucket IS NOT NULL")
        .groupBy("test", "bucket", "value", "g")
        .agg(F.count("*").alias("n"))
    )
    ranked = with_ranks(counts, ["test"], "value", "bucket", "n", ("test", "g"), rows_bound)
    rank = average_rank()
    each = ranked.select(
        "test", "g", F.col("n").cast("double").alias("n"), rank.alias("rank"),
        F.col("ties").cast("double").alias("ties"), "total",
    )
    return _summed(each)


def _summed(each: DataFrame) -> DataFrame:
    n, ties = F.col("n"), F.col("ties")
    return each.groupBy("test", "g").agg(
        F.sum("n").alias("n"),
        F.sum(n * F.col("rank")).alias("rank_sum"),
        F.sum(n * (ties * ties - 1)).alias("ties"),
        F.max("ties").alias("most_ties"),
        F.max("total").alias("total"),
    )


def _per_test(sums: DataFrame) -> DataFrame:
    size = F.col("n").cast("double")
    middle = (F.col("total") + 1) / 2
    spread = size * F.pow(F.col("rank_sum") / size - middle, F.lit(2))
    positive = F.col("g") == 1
    return sums.groupBy("test").agg(
        F.max("total").cast("double").alias("total"),
        F.count("*").alias("groups"),
        F.sum("ties").alias("ties"),
        F.max("most_ties").alias("most_ties"),
        F.sum(spread).alias("spread"),
        F.sum(F.when(positive, size)).alias("n1"),
        F.sum(F.when(~positive, size)).alias("n0"),
        F.sum(F.when(positive, F.col("rank_sum"))).alias("r1"),
    )


def kruskal(sums: DataFrame) -> DataFrame:
    """H with tie correction, chi-square tail, epsilon squared."""
    n = F.col("total")
    per = _per_test(sums).withColumn("correction", 1 - F.col("ties") / (n * n * n - n))
    valid = (F.col("groups") >= 2) & (n >= MIN_KRUSKAL_ROWS) & (F.col("most_ties") < n)
    h = F.when(valid, F.try_divide(F.col("spread") * 12, n * (n + 1)) / F.col("correction"))
    return per.select(
        "test",
        F.lit(effects.EPSILON_SQUARED).alias("effect_name"),
        F.when(valid, h / (n - 1)).otherwise(0.0).alias("effect"),
        F.when(valid, F.lit("chi2")).alias("law"),
        (F.col("groups") - 1).cast("double").alias("a"),
        F.lit(None).cast("double").alias("b"),
        h.alias("law_stat"),
        n.cast("bigint").alias("n"),
        h.alias("statistic"),
    )


def mann_whitney(sums: DataFrame) -> DataFrame:
    """U of the rows with outcome 1, rank-biserial r; exact p for a tiny side without ties."""
    per = _per_test(sums).fillna(0.0, ["n1", "n0", "r1"])
    n, n1, n0, ties = F.col("total"), F.col("n1"), F.col("n0"), F.col("ties")
    valid = (n1 >= MIN_SIDE_ROWS) & (n0 >= MIN_SIDE_ROWS)
    u = F.col("r1") - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n0 / 12 * (n + 1 - F.try_divide(ties, n * (n - 1))))
    z = F.try_divide(F.abs(u - n1 * n0 / 2) - 0.5, spread)
    exact = (F.least(n1, n0) <= pvalues.EXACT_SIDE) & (ties == 0)
    return per.select(
        "test",
        F.lit(effects.RANK_BISERIAL).alias("effect_name"),
        F.when(valid, F.try_divide(u * 2, n1 * n0) - 1).otherwise(0.0).alias("effect"),
        F.when(valid, F.when(exact, "exact_u").otherwise("normal")).alias("law"),
        n1.alias("a"),
        n0.alias("b"),
        F.when(exact, u).otherwise(F.greatest(z, F.lit(0.0))).alias("law_stat"),
        n.cast("bigint").alias("n"),
        F.when(valid, u).alias("statistic"),
    )


# ---------------------------------------------------------------- Spearman


def spearman(
    base: DataFrame,
    specs: Sequence[Spec],
    cuts: Mapping[str, Cuts],
    whole: Collection[str],
    rows_bound: int,
) -> DataFrame:
    """One rank correlation per test over complete pairs.

    Each outcome y is sorted once for all its tests. Of the rows with one value of x only their
    number and sums are needed, so these are what the ranks of the other side are joined to. Equal
    pairs of an outcome with one test are counted first, so that they are sorted as one row; so
    are equal rows of all its tests where the columns have few values.
    """
    by_y: dict[str, list[Spec]] = {}
    for s in specs:
        by_y.setdefault(s.y, []).append(s)
    sides = []
    for y, own in by_y.items():
        xs = list(dict.fromkeys(s.x for s in own))
        among = list(dict.fromkeys(None if x in whole else x for x in xs))
        names = [f"w{k}" for k in range(len(among))]
        weights = {
            name: F.col("n") if x is None else F.expr(f"if({x} IS NOT NULL, n, 0L)")
            for name, x in zip(names, among, strict=True)
        }
        columns = [c for x in xs for c in (x, bucket_name(x)) if x != y]
        rows = base.where(f"{y} IS NOT NULL AND {bucket_name(y)} IS NOT NULL")
        rows = rows.select(y, bucket_name(y), *columns)
        if len(xs) == 1 or repeating([cuts[c] for c in (y, *xs)]):
            rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
        else:
            rows = rows.withColumn("n", F.lit(1).cast("bigint"))
        rows = rows.withColumns({"of": F.lit(0)} | weights)
        ranked = with_shared_ranks(
            rows, ["of"], y, bucket_name(y), names, [y, *columns], rows_bound
        )
        # Ranks from their middle, so that the sums stay as small as they can be.
        ranked = ranked.withColumns(
            {
                f"d{k}": average_rank(k) - (F.col(f"total_{k}") + 1) / 2
                for k in range(len(among))
            }
        )
        sides.append(
            melt(
                ranked,
                [
                    {
                        "test": str(s.test),
                        "xb": bucket_name(s.x),
                        "x": s.x,
                        "dy": f"d{among.index(s.x if s.x in among else None)}",
                        "n": "n",
                    }
                    for s in own
                ],
            )
        )
    rows = sides[0]
    for side in sides[1:]:
        rows = rows.unionByName(side)
    size, dy = F.col("n").cast("double"), F.col("dy")
    levels = (
        rows.where("x IS NOT NULL AND xb IS NOT NULL")
        .groupBy("test", "xb", "x")
        .agg(
            F.sum("n").alias("n"),
            F.sum(size * dy).alias("y"),
            F.sum(size * dy * dy).alias("yy"),
        )
    )
    # Read twice, for the rows of a bucket and for their ranks.
    both = with_ranks(stage(levels), ["test"], "x", "xb", "n", (), rows_bound)
    dx = average_rank() - (F.col("total") + 1) / 2
    per = both.groupBy("test").agg(
        F.max("total").cast("double").alias("total"),
        F.sum(F.col("y") * dx).alias("xy"),
        F.sum(size * dx * dx).alias("xx"),
        F.sum("yy").alias("yy"),
    )
    size = F.col("total")
    valid = (size >= MIN_SPEARMAN_ROWS) & (F.col("xx") > 0) & (F.col("yy") > 0)
    rho = F.try_divide(F.col("xy"), F.sqrt("xx") * F.sqrt("yy"))
    rho = F.greatest(F.least(rho, F.lit(1.0)), F.lit(-1.0))
    return per.select(
        "test",
        F.lit(effects.SPEARMAN).alias("effect_name"),
        F.when(valid, rho).otherwise(0.0).alias("effect"),
        F.when(valid, F.lit("student")).alias("law"),
        (size - 2).alias("a"),
        F.lit(None).cast("double").alias("b"),
        F.when(valid, pvalues.spearman_t(rho, size)).alias("law_stat"),
        size.cast("bigint").alias("n"),
        F.when(valid, rho).alias("statistic"),
    )


# ---------------------------------------------------------------- contingency


def contingency(rows: DataFrame) -> DataFrame:
    """(test, a, b) rows to cell counts."""
    return (
        rows.where(F.col("a").isNotNull() & F.col("b").isNotNull())
        .groupBy("test", "a", "b")
        .agg(F.count("*").alias("n"))
    )


def chi_square(cells: DataFrame) -> DataFrame:
    """Cell counts to one row of chi-square results per test.

    ``b`` may be a 0/1 outcome, in which case the group rates are meaningful too. Both sides
    have at most a few dozen levels, so all cells of one test fit in one task and a single
    exchange serves every margin.
    """
    whole = Window.partitionBy("test")
    size = F.col("n").cast("double")
    wide = cells.repartition("test").select(
        "test",
        size.alias("n"),
        F.sum(size).over(Window.partitionBy("test", "a")).alias("row_n"),
        F.sum(size).over(Window.partitionBy("test", "b")).alias("col_n"),
        F.sum(size).over(whole).alias("total"),
        F.sum(size * F.col("b").cast("double"))
        .over(Window.partitionBy("test", "a"))
        .alias("positive"),
    )
    expected = F.col("row_n") * F.col("col_n") / F.col("total")
    per = wide.groupBy("test").agg(
        F.max("total").alias("total"),
        F.count("*").alias("cells"),
        F.round(F.sum(F.col("n") / F.col("row_n"))).alias("rows"),
        F.round(F.sum(F.col("n") / F.col("col_n"))).alias("cols"),
        F.sum(F.pow(F.col("n") - expected, F.lit(2)) / expected).alias("seen"),
        F.sum(expected).alias("expected_seen"),
        (F.min("row_n") * F.max("row_n")).alias("row_product"),
        (F.min("col_n") * F.max("col_n")).alias("col_product"),
        F.max(F.col("positive") / F.col("row_n")).alias("max_rate"),
        F.min(F.col("positive") / F.col("row_n")).alias("min_rate"),
    )
    n = F.col("total")
    empty = F.when(F.col("cells") == F.col("rows") * F.col("cols"), 0.0).otherwise(
        n - F.col("expected_seen")
    )
    inverse_expected = n * n * n / (F.col("row_product") * F.col("col_product"))
    gap = F.sqrt(F.col("chi2") / inverse_expected)
    yates = F.pow(F.greatest(gap - 0.5, F.lit(0.0)), F.lit(2)) * inverse_expected
    two_by_two = (F.col("rows") == 2) & (F.col("cols") == 2)
    smaller = F.least("rows", "cols")
    valid = smaller >= 2
    ratio = F.when(F.col("min_rate") > 0, F.col("max_rate") / F.col("min_rate")).otherwise(
        F.col("max_rate") / F.greatest(1 / n, F.lit(SMALLEST_RATE))
    )
    return (
        per.withColumn("chi2", F.col("seen") + empty)
        .withColumn("corrected", F.when(two_by_two, yates).otherwise(F.col("chi2")))
        .select(
            "test",
            n.cast("bigint").alias("n"),
            F.when(valid, F.col("chi2")).alias("chi2"),
            F.when(valid, F.col("corrected")).alias("corrected"),
            ((F.col("rows") - 1) * (F.col("cols") - 1)).alias("df"),
            F.when(valid, F.sqrt(F.col("chi2") / (n * (smaller - 1))))
            .otherwise(0.0)
            .alias("cramers_v"),
            F.when(valid, ratio).otherwise(1.0).alias("rate_ratio"),
            "min_rate",
            "max_rate",
        )
    )


def _chi_result(table: DataFrame, name: str, effect: str) -> DataFrame:
    return table.select(
        "test",
        F.lit(name).alias("effect_name"),
        F.col(effect).alias("effect"),
        F.when(F.col("corrected").isNotNull(), F.lit("chi2")).alias("law"),
        F.col("df").alias("a"),
        F.lit(None).cast("double").alias("b"),
        F.col("corrected").alias("law_stat"),
        "n",
        F.col("corrected").alias("statistic"),
        "cramers_v",
        "min_rate",
        "max_rate",
    )


def chi2_uniform(counts: DataFrame, categories: int) -> DataFrame:
    """(test, n) rows, one per category, against equal shares; absent categories count as 0."""
    total = F.sum("n").cast("double")
    squares = F.sum(F.col("n").cast("double") * F.col("n"))
    stat = squares * categories / total - total
    return counts.groupBy("test").agg(stat.alias("statistic"), F.sum("n").alias("n")).select(
        "test",
        "statistic",
        F.lit(float(categories - 1)).alias("df"),
        pvalues.chi2_p(F.col("statistic"), F.lit(categories - 1)).alias("p_value"),
        "n",
    )


# ---------------------------------------------------------------- many tests


def _cell_rows(base: DataFrame, specs: Sequence[Spec]) -> DataFrame:
    return melt(base, [{"test": str(s.test), "a": s.x, "b": s.y} for s in specs])


def run_specs(
    base: DataFrame, specs: Sequence[Spec], cuts: Mapping[str, Cuts], whole: Collection[str] = ()
) -> DataFrame:
    """All given hypotheses over one prepared table: one row per test (RESULT_COLUMNS plus
    cramers_v, min_rate and max_rate for the contingency tests).

    Columns of the table in ``whole`` have no missing values.
    """
    by_kind: dict[str, list[Spec]] = {}
    for s in specs:
        by_kind.setdefault(s.kind, []).append(s)

    def bound(chosen: Sequence[Spec], side) -> int:
        return sum(cuts[side(s)].buckets for s in chosen)

    parts: list[DataFrame] = []
    empty = {c: F.lit(None).cast("double") for c in ("cramers_v", "min_rate", "max_rate")}
    # Both tests read the ranks of a number column, so each column is ranked once for them.
    grouped = [(s.test, s.y, s.x) for s in by_kind.get("kruskal", ())]
    sided = [(s.test, s.x, s.y) for s in by_kind.get("mann_whitney", ())]
    if grouped or sided:
        columns = ranked_columns([*grouped, *sided], whole)
        sums = rank_sums(base, columns, sum(cuts[c.column].buckets for c in columns))
        for rows, test in ((grouped, kruskal), (sided, mann_whitney)):
            if rows:
                own = sums.where(F.col("test").isin([t for t, *_ in rows])) if grouped and sided else sums
                parts.append(test(own).withColumns(empty))
    if chosen := by_kind.get("spearman"):
        limit = max(bound(chosen, lambda s: s.x), bound(chosen, lambda s: s.y))
        parts.append(spearman(base, chosen, cuts, whole, limit).withColumns(empty))
    for kind, name, effect in (
        ("rate", effects.RATE_RATIO, "rate_ratio"),
        ("cramers_v", effects.CRAMERS_V, "cramers_v"),
    ):
        if chosen := by_kind.get(kind):
            table = chi_square(contingency(_cell_rows(base, chosen)))
            parts.append(_chi_result(table, name, effect))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    law = (F.col("law"), F.col("law_stat"), F.col("a"), F.col("b"))
    p = pvalues.tail_p(*law, exact="mann_whitney" in by_kind)
    return out.withColumn("p_value", p).select(
        *RESULT_COLUMNS, "cramers_v", "min_rate", "max_rate"
    )


# ---------------------------------------------------------------- false discoveries


def benjamini_hochberg(df: DataFrame, p: str, n_tests: int, output: str = "q_value") -> DataFrame:
    """Adds FDR-adjusted q-values; missing p stays missing and is not counted.

    Equal p share one q, so only distinct p-values are ordered: they are bucketed, summed to
    cumulative counts, and the running minimum from the top is taken per bucket and then
    across buckets. Works the same for forty tests and for a table of billions.
    """
    df = stage(df)
    source = df.where(F.col(p).isNotNull()).select(F.col(p).alias("p"))
    m = source.count()
    cuts = cuts_from(cut_points(source, {"p": F.col("p")}, bucket_count(n_tests))["p"])
    counts = (
        with_buckets(source, {"p": cuts})
        .select(F.lit(0).alias("test"), F.col(bucket_name("p")).alias("bucket"), F.col("p"))
        .groupBy("test", "bucket", "p")
        .agg(F.count("*").alias("n"))
    )
    ranked = with_ranks(counts, ["test"], "p", "bucket", "n", (), cuts.buckets)
    raw = ranked.withColumn("raw", F.col("p") * m / (F.col("before") + F.col("ties")))
    position = F.abs(F.col("bucket"))
    per_bucket = raw.groupBy("bucket").agg(F.min("raw").alias("low"))
    above = Window.partitionBy(F.lit(0)).orderBy(position).rowsBetween(1, Window.unboundedFollowing)
    later = per_bucket.select("bucket", F.min("low").over(above).alias("later"))
    down = (
        Window.partitionBy("bucket").orderBy(F.col("p").desc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    q = (
        raw.withColumn("run", F.min("raw").over(down))
        .join(maybe_broadcast(later, cuts.buckets), "bucket")
        .select("p", F.least("run", "later", F.lit(1.0)).alias(output))
    )
    return attach_by_value(df, p, q, "p", cuts)
