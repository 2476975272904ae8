"""Metric by group: rates, means and medians per level of a dimension."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import AnalysisError
from ..functions import text
from .findings import evidence, points
from .frame import Fold, Frame, Where, fold_plans
from .hypotheses import melt
from .ranks import bucket_name, exact_quantiles, find_cuts, with_buckets
from .testbed import TestBed

# Groups below this size are named in a caveat, at most four of them.
SMALL_GROUP = 50
NAMED_SMALL_GROUPS = 4


@dataclass(frozen=True)
class Segment:
    """A metric to compare across the groups of a dimension."""

    key: int
    metric: str
    dimension: str
    agg: str = "auto"


def _agg_name(frame: Frame, s: Segment) -> str:
    if frame.is_binary(s.metric):
        return "rate"
    return "median" if s.agg == "median" else "mean"


def group_means(frame: Frame, segments: Sequence[Segment], folds: Mapping[str, Fold]) -> DataFrame:
    """(key, category, value, n, overall, total): means or rates of every segment in one pass."""
    metrics = list(dict.fromkeys(s.metric for s in segments))
    dims = list(dict.fromkeys(s.dimension for s in segments))
    wide = frame.df.selectExpr(
        *[f"{frame.measure_sql(m)} AS m{i}" for i, m in enumerate(metrics)],
        *[f"{folds[d].apply(frame.label_sql(d))} AS d{i}" for i, d in enumerate(dims)],
    )
    rows = melt(
        wide,
        [
            {
                "key": str(s.key),
                "category": f"d{dims.index(s.dimension)}",
                "y": f"m{metrics.index(s.metric)}",
            }
            for s in segments
        ],
    )
    sums = (
        rows.where("category IS NOT NULL AND y IS NOT NULL")
        .groupBy("key", "category")
        .agg(F.sum("y").alias("sum_y"), F.count("*").alias("n"))
    )
    scale = _by_key({s.key: 100.0 if _agg_name(frame, s) == "rate" else 1.0 for s in segments})
    per_key = Window.partitionBy("key")
    total = F.sum("n").over(per_key)
    return sums.select(
        "key",
        "category",
        (scale * F.col("sum_y") / F.col("n")).alias("value"),
        "n",
        (scale * F.sum("sum_y").over(per_key) / total).alias("overall"),
        total.alias("total"),
    )


def group_medians(frame: Frame, s: Segment, fold: Fold) -> DataFrame:
    """As group_means for one segment, with exact medians by distributed selection."""
    y = frame.measure(s.metric).alias("y")
    category = F.expr(fold.apply(frame.label_sql(s.dimension))).alias("category")
    rows = frame.df.select(y, category)
    rows = rows.where("category IS NOT NULL AND y IS NOT NULL")
    cuts = find_cuts(rows, ["y"], frame.n_rows)
    both = with_buckets(rows, cuts).select(
        "y",
        bucket_name("y"),
        F.explode(F.array(F.col("category"), F.lit(None).cast("string"))).alias("category"),
    )
    keyed = both.withColumn("slot", F.coalesce(F.concat(F.lit("g:"), "category"), F.lit("all")))
    bound = cuts["y"].buckets * (len(fold.groups) + 1)
    medians = exact_quantiles(keyed, ["slot"], "y", bucket_name("y"), [0.5], bound)
    whole = Window.partitionBy(F.lit(0))
    overall = F.max(F.when(F.col("slot") == "all", F.col("q0"))).over(whole)
    total = F.max(F.when(F.col("slot") == "all", F.col("n"))).over(whole)
    out = medians.select(
        F.lit(s.key).alias("key"),
        F.when(F.col("slot") != "all", F.expr("substring(slot, 3)")).alias("category"),
        F.col("q0").alias("value"),
        "n",
        overall.alias("overall"),
        total.alias("total"),
    )
    return out.where("category IS NOT NULL")


def _by_key(mapping: Mapping[int, object]) -> Column:
    if len(set(mapping.values())) == 1:
        return F.lit(next(iter(mapping.values())))
    pairs = [F.lit(x) for k, v in mapping.items() for x in (k, v)]
    return F.element_at(F.create_map(*pairs), F.col("key"))


def segment_evidence(
    frame: Frame,
    segments: Sequence[Segment],
    folds: Mapping[str, Fold],
    tests: DataFrame,
) -> DataFrame:
    """Evidence rows of many segments; ``tests`` holds (test = key, effect, p_value, ...)."""
    medians = [s for s in segments if _agg_name(frame, s) == "median"]
    means = [s for s in segments if _agg_name(frame, s) != "median"]
    tables = [group_medians(frame, s, folds[s.dimension]) for s in medians]
    if means:
        tables.append(group_means(frame, means, folds))
    groups = tables[0]
    for t in tables[1:]:
        groups = groups.unionByName(t)

    agg = _by_key({s.key: _agg_name(frame, s) for s in segments})
    metric = _by_key({s.key: s.metric for s in segments})
    dimension = _by_key({s.key: s.dimension for s in segments})
    overall = F.col("overall")
    distance = F.when(overall == 0, F.abs("value")).otherwise(
        F.abs(F.try_divide(F.col("value"), overall) - 1)
    )
    per = groups.groupBy("key").agg(
        points(-F.col("value"), F.col("category"), F.col("value"), F.col("n")).alias("points"),
        F.max_by("category", F.struct(distance, F.col("value"))).alias("far"),
        F.max("overall").alias("overall"),
        F.max("total").alias("n"),
        F.count("*").alias("groups"),
        F.slice(
            F.sort_array(F.collect_list(F.when(F.col("n") < SMALL_GROUP, F.col("category")))),
            1,
            NAMED_SMALL_GROUPS,
        ).alias("small"),
    ).where("groups >= 2")
    first, last = F.element_at("points", 1), F.element_at("points", -1)
    per = per.withColumns(
        {
            "agg": agg,
            "target": metric,
            "dimension": dimension,
            "top": first["category"],
            "bottom": last["category"],
            "top_value": first["value"],
            "bottom_value": last["value"],
        }
    ).join(F.broadcast(tests.withColumnRenamed("test", "key").drop("n")), "key")

    rate = F.col("agg") == "rate"
    kind = F.col("value_kind")
    top, bottom = F.col("top_value"), F.col("bottom_value")
    per = text.with_text(
        per.withColumn("value_kind", F.when(rate, "percent").otherwise("number")),
        {"top_text": "top_value", "bottom_text": "bottom_value", "overall_text": "overall"},
        "value_kind",
    )
    top_text, bottom_text, overall_text = (
        F.col(c) for c in ("top_text", "bottom_text", "overall_text")
    )
    standout = F.when(rate, F.col("top")).otherwise(F.col("far"))
    standout_value = F.element_at(
        F.filter("points", lambda p: p["category"] == standout), 1
    )["value"]
    gap = F.when(
        bottom > 0, F.concat(F.lit(" ("), text.ratio_text(top / bottom), F.lit(" gap)."))
    ).otherwise(F.lit("."))
    # The wording of titles, summaries and headlines.
    rate_summary = F.concat(
        F.col("target"), F.lit(" rate is highest for "), F.col("dimension"), F.lit(" = "),
        F.col("top"), F.lit(" at "), top_text, F.lit(" and lowest for "), F.col("bottom"),
        F.lit(" at "), bottom_text, F.lit(", versus "), overall_text, F.lit(" overall"), gap,
    )
    mean_summary = F.concat(
        F.when(F.col("agg") == "median", "Median ").otherwise("Average "), F.col("target"),
        F.lit(" is highest for "), F.col("dimension"), F.lit(" = "), F.col("top"), F.lit(" ("),
        top_text, F.lit(") and lowest for "), F.col("bottom"), F.lit(" ("), bottom_text,
        F.lit("), versus "), overall_text, F.lit(" overall."),
    )
    small = F.when(
        F.size("small") > 0,
        F.concat(
            F.lit(f"Small groups (under {SMALL_GROUP} rows): "),
            F.array_join("small", ", "),
            F.lit("."),
        ),
    )
    return evidence(
        per,
        kind=F.lit("segment"),
        title=F.concat(
            F.col("target"), F.lit(" by "), F.col("dimension"), F.lit(": "), standout,
            F.lit(" stands out"),
        ),
        summary=F.when(rate, rate_summary).otherwise(mean_summary),
        headline=F.when(rate, F.concat(top_text, F.lit(" vs "), bottom_text)).otherwise(
            text.pct_change(standout_value, overall)
        ),
        chart_kind=F.lit("bars"),
        value_format=kind,
        reference=overall,
        reference_label=F.lit("overall"),
        caveats=F.array_compact(F.array(small)),
        facts=F.create_map(
            F.lit("top"), F.col("top"),
            F.lit("bottom"), F.col("bottom"),
            F.lit("top_value"), F.round(top, 4).cast("string"),
            F.lit("bottom_value"), F.round(bottom, 4).cast("string"),
            F.lit("overall"), F.round(overall, 4).cast("string"),
        ),
        filter_text=frame.filter,
    )


def segment_stats(
    frame: Frame, metric: str, dimension: str, agg: str = "auto", where: Where | None = None
) -> DataFrame:
    """(category, value, n, overall) of one metric by one dimension, rare levels folded."""
    sub, s, folds = _request(frame, metric, dimension, agg, where)
    if _agg_name(sub, s) == "median":
        table = group_medians(sub, s, folds[s.dimension])
    else:
        table = group_means(sub, [s], folds)
    return table.select("category", "value", "n", "overall")


def compare_segments(
    frame: Frame, metric: str, dimension: str, agg: str = "auto", where: Where | None = None
) -> DataFrame:
    """One evidence row: how a metric differs across groups, tested and described."""
    sub, s, folds = _request(frame, metric, dimension, agg, where)
    bed = TestBed.build(sub, [s.metric], [s.dimension], folds)
    tests = bed.run([bed.group_spec(s.key, s.metric, s.dimension)])
    return segment_evidence(sub, [s], folds, tests)


def _request(
    frame: Frame, metric: str, dimension: str, agg: str, where: Where | None
) -> tuple[Frame, Segment, dict[str, Fold]]:
    metric = frame.resolve(metric, "metric")
    dimension = frame.resolve(dimension, "dimension")
    if metric == dimension:
        raise AnalysisError("The metric and the dimension must be different columns.")
    sub = frame.subset(where)
    sub.need_numbers(metric)
    folds = fold_plans(sub, [dimension])
    if len(folds[dimension].groups) < 2:
        raise AnalysisError(
            f"{dimension!r} has fewer than two groups with enough rows to compare."
        )
    return sub, Segment(0, metric, dimension, agg), folds
