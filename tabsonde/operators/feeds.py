"""Summary queries over the profile and findings tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

# How many entries each feed shows.
MAX_BARS = 8
MAX_CORRELATION_BARS = 6
# Metrics that exist for numeric columns only, and those of every column.
NUMERIC_STATS = ("mean", "median", "min", "max", "std")
DATASET_METRICS = ("rows", "columns", "missing_cells_pct", "duplicate_rows")


def metric_table(columns: DataFrame, dataset: DataFrame) -> DataFrame:
    """(metric, column, number, value, caption): everything a reference can resolve to."""
    whole = _entries(
        dataset.selectExpr("CAST(NULL AS STRING) AS column", "*"),
        [
            ("rows", "n_rows", "number", "'rows in the dataset'"),
            ("columns", "n_cols", "count", "'columns profiled'"),
            ("missing_cells_pct", "missing_pct_total", "percent", "'of all cells are missing'"),
            ("duplicate_rows", "duplicate_rows", "number", "'fully duplicated rows'"),
        ],
    )
    base = dataset.select(F.coalesce("sample_rows", "n_rows").alias("rows")).first()["rows"]
    present = f"({base} - missing_count)"
    top = "element_at(top_values, 1)"
    share = f"if({present} > 0 AND size(top_values) > 0, 100D * {top}.count / {present}, NULL)"
    per_column = _entries(
        columns.withColumn("column", F.col("name")),
        [
            *[
                (s, f"if(inferred_type = 'numeric', {s}, NULL)", "number", f"concat('{s} of ', name)")
                for s in NUMERIC_STATS
            ],
            ("unique_count", "unique_count", "number", "concat('distinct values of ', name)"),
            ("missing_pct", "missing_pct", "percent", "concat('of ', name, ' is missing')"),
            ("top_value_share", share, "percent", f"concat('of ', name, ' is ', {top}.value)"),
        ],
    )
    out = whole.unionByName(per_column).where("number IS NOT NULL")
    plain = "CAST(CAST(number AS BIGINT) AS STRING)"
    value = f"if(kind = 'count', {plain}, {text.value_sql('number', 'kind')})"
    return out.selectExpr("metric", "column", "number", f"{value} AS value", "caption")


def _entries(df: DataFrame, entries: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """(column, metric, number, kind, caption) rows of SQL text entries."""
    structs = [
        f"named_struct('metric', '{metric}', 'number', CAST({number} AS DOUBLE), 'kind', '{kind}', "
        f"'caption', {caption})"
        for metric, number, kind, caption in entries
    ]
    return df.selectExpr("column", f"inline(array({', '.join(structs)}))")


def kpi_values(
    refs: DataFrame, columns: DataFrame, dataset: DataFrame, findings: DataFrame | None = None
) -> DataFrame:
    """Resolve (label, metric, column, finding_id) references; unresolvable ones drop out.

    Column names match exactly or, failing that, ignoring case and surrounding blanks.
    """
    table = metric_table(columns, dataset)
    for_whole = F.col("metric").isin(*DATASET_METRICS)
    wanted = refs.select(
        "label",
        "metric",
        F.col("column").alias("wanted"),
        "finding_id",
        F.when(for_whole, F.lit("")).otherwise(F.lower(F.trim("column"))).alias("folded"),
    )
    known = table.select(
        "metric",
        F.col("column").alias("name"),
        "number",
        "value",
        "caption",
        F.coalesce(F.lower("column"), F.lit("")).alias("folded"),
    )
    order = Window.partitionBy("label", "metric", "wanted").orderBy(
        F.desc(F.coalesce(F.col("name") == F.col("wanted"), F.lit(False))), "name"
    )
    # Both sides are control-sized: at most a few metrics per profiled column.
    hits = wanted.join(known, ["metric", "folded"]).withColumn("nth", F.row_number().over(order))
    out = hits.where("nth = 1").select("label", "value", "caption")
    if findings is None:
        return out
    stated = findings.select(
        F.col("id").alias("finding_id"),
        F.col("headline").alias("value"),
        finding_caption().alias("caption"),
    )
    from_findings = (
        wanted.where("metric = 'finding'")
        .join(stated, "finding_id")
        .select("label", "value", "caption")
    )
    return out.unionByName(from_findings)


def finding_caption() -> Column:
    """Short caption of a finding's headline."""
    kind, target, dimension = F.col("kind"), F.col("target"), F.col("dimension")

    def fact(name: str) -> Column:
        return F.coalesce(F.try_element_at("facts", F.lit(name)), F.lit("None"))

    return (
        F.when(
            (kind == "segment") & (F.col("agg") == "rate"),
            F.concat(dimension, F.lit(": "), fact("top"), F.lit(" vs "), fact("bottom")),
        )
        .when(
            kind == "segment", F.concat(dimension, F.lit(": "), fact("top"), F.lit(" vs overall"))
        )
        .when(
            kind == "bins",
            F.concat(
                dimension, F.lit(" "), fact("last_band"), F.lit(" vs "), fact("first_band")
            ),
        )
        .when(
            (kind == "trend") & (fact("peak_months") != ""), F.concat(target, F.lit(": seasonal peak"))
        )
        .when(kind == "trend", F.concat(target, F.lit(" change")))
        .when(
            kind == "concentration",
            F.concat(F.lit("of "), target, F.lit(" from the top 10% of "), dimension),
        )
        .when(kind == "drivers", F.concat(F.lit("strongest driver of "), target))
        .otherwise(F.col("title"))
    )


def top_value_share(columns: DataFrame, dataset: DataFrame) -> DataFrame:
    """(column, value, share): share of the most frequent value among the present rows."""
    table = metric_table(columns, dataset).where("metric = 'top_value_share'")
    tops = columns.select(
        F.col("name").alias("column"), F.element_at("top_values", 1)["value"].alias("value")
    )
    return table.drop("value").join(tops, "column").select(
        "column", "value", F.col("number").alias("share")
    )


def top_values_feed(columns: DataFrame, column: str, limit: int = MAX_BARS) -> DataFrame:
    """(rank, value, count) of the most frequent values of one column."""
    chosen = columns.where((F.col("name") == column) & F.col("top_values").isNotNull())
    rows = chosen.select(F.posexplode(F.slice("top_values", 1, limit)).alias("pos", "t"))
    return rows.select((F.col("pos") + 1).alias("rank"), "t.value", "t.count")


def missing_feed(columns: DataFrame, limit: int = MAX_BARS) -> DataFrame:
    """(column, missing_pct) of the columns with gaps, largest first."""
    gaps = columns.where("missing_count > 0").orderBy(F.desc("missing_pct"), "position")
    return gaps.limit(limit).select(F.col("name").alias("column"), "missing_pct")


def five_number_feed(columns: DataFrame) -> DataFrame:
    """(column, position, label, value): min, quartiles and max of every numeric column."""
    stats = (("Min", "min"), ("P25", "p25"), ("Median", "median"), ("P75", "p75"), ("Max", "max"))
    complete = columns.where("inferred_type = 'numeric' AND min IS NOT NULL AND p25 IS NOT NULL")
    return complete.select(
        F.col("name").alias("column"),
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i + 1).alias("position"),
                        F.lit(label).alias("label"),
                        F.col(c).alias("value"),
                    )
                    for i, (label, c) in enumerate(stats)
                ]
            )
        ),
    )


def correlation_feed(top_pairs: DataFrame, limit: int = MAX_CORRELATION_BARS) -> DataFrame:
    """(pair, r) of the strongest correlations."""
    strongest = top_pairs.orderBy(F.desc(F.abs("r")), "a", "b").limit(limit)
    return strongest.select(F.concat("a", F.lit(" × "), "b").alias("pair"), "r")
