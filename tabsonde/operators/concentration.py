"""How much of a measure a few entities hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import AnalysisError
from ..functions import effects, values
from ..staging import stage
from .findings import evidence
from .frame import Frame
from .ranks import (
    bucket_count,
    bucket_name,
    cut_points,
    cuts_from,
    value_counts,
    with_buckets,
    with_ranks,
)

MIN_ENTITIES = 10
# Reported top shares.
SHARES = (0.1, 0.2, 0.5)


def entity_totals(frame: Frame, metric: str, entity: str) -> DataFrame:
    """(entity, total, low) per entity with a value."""
    e = values.known(values.quoted(entity), frame.dtype(entity))
    rows = frame.df.selectExpr(f"{e} AS entity", f"{frame.measure_sql(metric)} AS y")
    rows = rows.where("entity IS NOT NULL AND y IS NOT NULL")
    return rows.groupBy("entity").agg(
        F.sum("y").alias("total"), F.min("y").alias("low"), F.count("*").alias("rows")
    )


def _ranked(totals: DataFrame, points) -> DataFrame:
    """Distinct totals with the number of entities above each, largest first."""
    cuts = cuts_from(points)
    cut = with_buckets(totals.select("total"), {"total": cuts}).withColumn("test", F.lit(0))
    counts = value_counts(cut, ["test"], "total", bucket_name("total"))
    named = counts.withColumnRenamed("total", "value")
    return with_ranks(
        named, ["test"], "value", bucket_name("total"), "n", (), cuts.buckets, descending=True
    )


def entity_ranks(frame: Frame, metric: str, entity: str) -> DataFrame:
    """Distinct entity totals with their average rank, largest first."""
    totals = stage(entity_totals(frame, metric, entity))
    points = cut_points(totals, {"total": F.col("total")}, bucket_count(frame.n_rows))
    ranked = _ranked(totals, points["total"])
    rank = F.col("before") + (F.col("ties") + 1) / 2
    return ranked.select("value", "n", rank.alias("avg_rank"))


def pareto(frame: Frame, metric: str, entity: str) -> DataFrame:
    """One row: entities, rows, grand total, top 10/20/50 % shares and Gini.

    Tied totals are interchangeable in a top-k sum, so ranking distinct totals with their
    counts is exact and needs no order among entities.
    """
    totals = stage(entity_totals(frame, metric, entity))
    points = cut_points(totals, {"total": F.col("total")}, bucket_count(frame.n_rows))
    head = totals.agg(
        F.count("*").alias("entities"),
        F.sum("total").alias("grand"),
        F.min("low").alias("low"),
        F.sum("rows").alias("rows"),
    ).first()
    if head["entities"] and head["low"] < 0:
        raise AnalysisError(
            f"{metric!r} has negative values; concentration needs a non-negative measure."
        )
    if head["entities"] < MIN_ENTITIES or head["grand"] <= 0:
        raise AnalysisError(f"Too few {entity} values to measure concentration.")
    size = head["entities"]
    n, before, value = F.col("n"), F.col("before"), F.col("value")

    def top(share: float) -> Column:
        # max(1, ceil(size * share)) entities, as many of a tied total as still fit.
        k = F.greatest(F.ceil(F.lit(float(size)) * F.lit(share)), F.lit(1))
        taken = F.greatest(F.least(n, k - before), F.lit(0))
        return F.sum(value * taken)

    grand = F.sum(value * n)
    # Ascending cumulative sums add each total once per entity at or above it; within ties of
    # n entities the count runs down by one, which averages to (n + 1) / 2.
    cumulative = F.sum(value * n * (before + (n + 1) / 2))
    shares = _ranked(totals, points["total"]).agg(
        grand.alias("grand"),
        *[(top(s) / grand).alias(f"top{int(s * 100)}_share") for s in SHARES],
        (1 - 2 * cumulative / (grand * size) + 1 / F.lit(float(size))).alias("gini"),
    )
    return shares.withColumns({"n": F.lit(head["rows"]), "entities": F.lit(size)})


def concentration(frame: Frame, metric: str, entity: str, key: int = 0) -> DataFrame:
    """One evidence row: share of a measure held by the top entities."""
    metric = frame.resolve(metric, "metric")
    entity = frame.resolve(entity, "entity")
    table = pareto(frame, metric, entity)
    s10, s20, s50 = (F.col(f"top{int(s * 100)}_share") for s in SHARES)
    entities = F.col("entities")
    top_count = F.greatest(F.ceil(entities * F.lit(0.1)), F.lit(1))

    def point(name: str, share: Column) -> Column:
        return F.struct(
            F.lit(name).alias("category"),
            F.round(share * 100, 2).alias("value"),
            F.lit(None).cast("bigint").alias("count"),
        )

    row = table.withColumns(
        {
            "key": F.lit(key),
            "target": F.lit(metric),
            "dimension": F.lit(entity),
            "agg": F.lit("sum"),
            "effect_name": F.lit(effects.TOP_SHARE),
            "effect": s20,
            "p_value": F.lit(None).cast("double"),
            "points": F.array(
                point("Top 10%", s10), point("Top 20%", s20), point("Top 50%", s50)
            ),
        }
    )
    # The wording of titles, summaries and headlines.
    summary = F.concat(
        F.format_string(f"The top 10%% of {_escaped(entity)} (%,d of %,d) ", top_count, entities),
        F.format_string(f"account for %.0f%% of {_escaped(metric)}; ", s10 * 100),
        F.format_string("the top 20%% for %.0f%% (Gini %.2f).", s20 * 100, F.col("gini")),
    )
    return evidence(
        row,
        kind=F.lit("concentration"),
        title=F.lit(f"A few {entity} values drive most of {metric}"),
        summary=summary,
        headline=F.format_string("%.0f%%", s10 * 100),
        chart_kind=F.lit("bars"),
        value_format=F.lit("percent"),
        caveats=F.array().cast("array<string>"),
        facts=F.create_map(
            F.lit("top10_share"), F.round(s10, 4).cast("string"),
            F.lit("top20_share"), F.round(s20, 4).cast("string"),
            F.lit("gini"), F.round("gini", 4).cast("string"),
        ),
    )


def _escaped(name: str) -> str:
    return name.replace("%", "%%")
