"""From tested results to findings: one row per statement, with its chart and its limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import effects, text

# Fixed value: significance level before and after the false-discovery adjustment.
SIGNIFICANCE = 0.05
SAMPLED_CAVEAT = "Computed on a sample of the rows."

FINDING_SCHEMA = (
    "id string, kind string, title string, summary string, headline string, target string, "
    "dimension string, agg string, effect struct<name:string,value:double,strength:string>, "
    "p_value double, q_value double, n bigint, significant boolean, "
    "chart struct<kind:string,points:array<struct<category:string,value:double,count:bigint>>,"
    "value_format:string,reference:double,reference_label:string>, caveats array<string>, "
    "filter string, source string, score double, facts map<string,string>"
)


def points(order: Column, category: Column, value: Column, count: Column) -> Column:
    """Aggregate to the ordered chart series of a group."""
    rows = F.sort_array(
        F.collect_list(
            F.struct(
                order.alias("o"), category.alias("category"), value.alias("value"),
                count.cast("bigint").alias("count"),
            )
        )
    )
    return F.transform(
        rows,
        lambda r: F.struct(
            r["category"].alias("category"), r["value"].alias("value"), r["count"].alias("count")
        ),
    )


def evidence(
    df: DataFrame,
    *,
    kind: Column,
    title: Column,
    summary: Column,
    headline: Column,
    chart_kind: Column,
    value_format: Column,
    caveats: Column,
    facts: Column,
    reference: Column | None = None,
    reference_label: Column | None = None,
    practical_ratio: Column | None = None,
    filter_text: str | None = None,
) -> DataFrame:
    """Common shape of every analysis result; key, target, dimension, agg, effect, n and
    points are taken from the input columns of those names."""
    if filter_text:
        note = F.array(F.lit(f"Computed on the subset where {filter_text}."))
        caveats = F.concat(caveats, note)
    nothing = F.lit(None)
    return df.select(
        "key",
        kind.alias("kind"),
        title.alias("title"),
        summary.alias("summary"),
        headline.alias("headline"),
        F.col("target"),
        F.col("dimension").cast("string").alias("dimension"),
        F.col("agg"),
        "effect_name",
        F.col("effect").cast("double").alias("effect"),
        (nothing if practical_ratio is None else practical_ratio)
        .cast("double")
        .alias("practical_ratio"),
        F.col("p_value").cast("double").alias("p_value"),
        F.col("n").cast("bigint").alias("n"),
        chart_kind.alias("chart_kind"),
        "points",
        value_format.alias("value_format"),
        (nothing if reference is None else reference).cast("double").alias("reference"),
        (nothing if reference_label is None else reference_label)
        .cast("string")
        .alias("reference_label"),
        caveats.cast("array<string>").alias("caveats"),
        F.lit(filter_text).cast("string").alias("filter"),
        facts.cast("map<string,string>").alias("facts"),
    )


def graded(rows: DataFrame) -> DataFrame:
    """Choose the effect that is reported and grade it.

    A band ratio replaces the test's own effect where it is the stronger of the two.
    """
    own = effects.normalized(F.col("effect_name"), F.col("effect"))
    ratio = effects.normalized(F.lit(effects.RATE_RATIO), F.col("practical_ratio"))
    practical = F.col("practical_ratio").isNotNull() & (ratio > own)
    name = F.when(practical, effects.RATE_RATIO).otherwise(F.col("effect_name"))
    value = F.when(practical, F.col("practical_ratio")).otherwise(F.col("effect"))
    strength = effects.strength_of(name, value)
    return rows.withColumns({"shown_name": name, "shown_value": value}).withColumn(
        "strength", strength
    ).withColumn(
        "significant",
        # A concentration carries no p-value: it is significant when practically large.
        F.when(
            F.col("kind") == "concentration", F.col("strength").isin("moderate", "strong")
        ).otherwise(
            F.coalesce(F.col("p_value") < SIGNIFICANCE, F.lit(False))
            & (F.col("strength") != "negligible")
        ),
    )


def to_findings(
    graded_rows: DataFrame,
    finding_id: Column | None = None,
    q_value: Column | None = None,
    score: Column | None = None,
    source: str = "battery",
) -> DataFrame:
    """The public findings table."""
    rounded = F.transform(
        "points",
        lambda p: F.struct(
            p["category"].alias("category"),
            F.round(p["value"], 4).alias("value"),
            p["count"].alias("count"),
        ),
    )
    return graded_rows.select(
        (F.lit("") if finding_id is None else finding_id).alias("id"),
        "kind",
        "title",
        "summary",
        "headline",
        "target",
        "dimension",
        "agg",
        F.struct(
            F.col("shown_name").alias("name"),
            F.round("shown_value", 4).alias("value"),
            F.col("strength").alias("strength"),
        ).alias("effect"),
        text.three_digits(F.col("p_value")).alias("p_value"),
        (F.lit(None).cast("double") if q_value is None else text.three_digits(q_value)).alias(
            "q_value"
        ),
        "n",
        "significant",
        F.struct(
            F.col("chart_kind").alias("kind"),
            rounded.alias("points"),
            F.col("value_format").alias("value_format"),
            F.round("reference", 4).alias("reference"),
            F.col("reference_label").alias("reference_label"),
        ).alias("chart"),
        "caveats",
        "filter",
        F.lit(source).alias("source"),
        (F.lit(0.0) if score is None else score).alias("score"),
        "facts",
    )


def finding(rows: DataFrame, source: str = "battery") -> DataFrame:
    """Evidence rows straight to findings, without a battery-wide adjustment."""
    return to_findings(graded(rows), source=source)


def finding_json(findings: DataFrame) -> DataFrame:
    """(id, json): compact text of each finding without the internal ranking columns."""
    shown = [c for c in findings.columns if c not in ("score", "source")]
    return findings.select("id", F.to_json(F.struct(*shown)).alias("json"))
