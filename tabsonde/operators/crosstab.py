"""Association of two categorical columns and their most over-represented combination."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import AnalysisError
from ..functions import text
from .findings import evidence, points
from .frame import Frame, Where, fold_plans
from .testbed import TestBed


def crosstab_lift(frame: Frame, a: str, b: str, folds=None) -> DataFrame:
    """(a, b, n, share, overall, lift) in long form: share of b within a, against its share
    overall, in percent."""
    folds = folds or fold_plans(frame, [a, b])
    rows = frame.df.selectExpr(
        f"{folds[a].apply(frame.label_sql(a))} AS a", f"{folds[b].apply(frame.label_sql(b))} AS b"
    ).where("a IS NOT NULL AND b IS NOT NULL")
    # At most 13 x 13 cells remain after this aggregation.
    cells = rows.groupBy("a", "b").agg(F.count("*").alias("n")).withColumn("one", F.lit(1))
    in_a, in_b = Window.partitionBy("one", "a"), Window.partitionBy("one", "b")
    share = 100.0 * F.col("n") / F.sum("n").over(in_a)
    overall = 100.0 * F.sum("n").over(in_b) / F.sum("n").over(Window.partitionBy("one"))
    shares = cells.withColumns({"share": share, "overall": overall})
    return shares.withColumn("lift", F.col("share") / F.col("overall")).drop("one")


def crosstab(
    frame: Frame, dimension_a: str, dimension_b: str, where: Where | None = None, key: int = 0
) -> DataFrame:
    """One evidence row: are two categorical columns linked, and where most."""
    a = frame.resolve(dimension_a, "dimension")
    b = frame.resolve(dimension_b, "dimension")
    if a == b:
        raise AnalysisError("Pick two different columns.")
    sub = frame.subset(where)
    folds = fold_plans(sub, [a, b])
    bed = TestBed.build(sub, [], [a, b], folds)
    tests = bed.run([bed.pair_spec(key, a, b)]).withColumnRenamed("test", "key").drop("n")
    cells = crosstab_lift(sub, a, b, folds).withColumn("key", F.lit(key))
    whole = Window.partitionBy("key")
    best = F.min_by("b", F.struct(-F.col("lift"), F.col("b"))).over(whole)
    level = cells.withColumns({"level": best, "total": F.sum("n").over(whole)})
    per_group = level.groupBy("key", "a", "level", "total").agg(
        F.coalesce(F.max(F.when(F.col("b") == F.col("level"), F.col("share"))), F.lit(0.0)).alias(
            "share"
        ),
        F.max(F.when(F.col("b") == F.col("level"), F.col("overall"))).alias("overall"),
    )
    row = (
        per_group.groupBy("key", "level", F.col("total").alias("n"))
        .agg(
            points(
                -F.col("share"), F.col("a"), F.col("share"), F.lit(None).cast("bigint")
            ).alias("points"),
            F.max("overall").alias("overall"),
        )
        .join(F.broadcast(tests), "key")
        .withColumns({"target": F.lit(b), "dimension": F.lit(a), "agg": F.lit("share")})
    )
    top = F.element_at("points", 1)
    # The wording of titles, summaries and headlines.
    summary = F.concat(
        F.lit(f"{b} = "), F.col("level"), F.lit(" makes up "),
        F.format_string("%.0f%%", top["value"]), F.lit(f" of {a} = "), top["category"],
        F.lit(", versus "), F.format_string("%.0f%%", F.col("overall")),
        F.format_string(" overall (Cramér's V %.2f).", F.col("effect")),
    )
    return evidence(
        row,
        kind=F.lit("crosstab"),
        title=F.lit(f"{a} and {b} are linked"),
        summary=summary,
        headline=text.ratio_text(top["value"] / F.col("overall")),
        chart_kind=F.lit("bars"),
        value_format=F.lit("percent"),
        reference=F.col("overall"),
        reference_label=F.concat(F.lit(f"{b} = "), F.col("level"), F.lit(" overall")),
        caveats=F.array().cast("array<string>"),
        facts=F.create_map().cast("map<string,string>"),
        filter_text=sub.filter,
    )
