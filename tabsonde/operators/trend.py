"""A metric over calendar periods: level, long-run change and monthly seasonality."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import AnalysisError
from ..functions import dates, effects, pvalues, text
from ..staging import stage
from .findings import evidence, points
from .frame import ROWS, Frame, Where
from .hypotheses import chi2_uniform, kruskal, melt, melted_rank_sums
from .ranks import bucket_name, find_cuts, with_buckets
from .segments import _by_key

# Name parts of measures that add up over time.
ADDITIVE_NAMES = (
    "revenue", "sales", "amount", "spend", "charge", "cost",
    "margin", "profit", "units", "quantity", "count", "total",
)
# Smallest inputs, complete share of a period, months for seasonality.
MIN_DATED_ROWS = 30
MIN_PERIODS = 4
COMPLETE_SHARE = 0.6
SEASONAL_PERIODS = 24
EDGE_PERIODS = 3
FREQUENCIES = ("week", "month", "quarter")


@dataclass(frozen=True)
class Trend:
    """A metric to follow over time (ROWS counts records)."""

    key: int
    metric: str
    freq: str = "auto"


@dataclass(frozen=True)
class TrendPlan:
    key: int
    label: str
    freq: str
    agg: str
    first: object
    last: object
    rows: int
    years: int


def is_additive(name: str) -> bool:
    return any(part in name.lower() for part in ADDITIVE_NAMES)


def _dated(frame: Frame, trends: Sequence[Trend]) -> tuple[DataFrame, dict[str, str]]:
    names = list(dict.fromkeys(t.metric for t in trends))
    slots = {m: f"m{i}" for i, m in enumerate(names)}
    wide = frame.df.select(
        frame.when().alias("t"), *[frame.measure(m).alias(s) for m, s in slots.items()]
    )
    return wide.where("t IS NOT NULL"), slots


def plan_trends(frame: Frame, trends: Sequence[Trend]) -> dict[int, TrendPlan]:
    """Frequency and aggregate of every trend from one aggregate over the table."""
    wide, slots = _dated(frame, trends)
    aggs = []
    for t in trends:
        y = F.col(slots[t.metric])
        when = F.when(y.isNotNull(), F.col("t"))
        aggs.append(
            F.struct(
                F.count(y).alias("n"),
                F.min(when).alias("first"),
                F.max(when).alias("last"),
                F.min(y).alias("low"),
            ).alias(f"k{t.key}")
        )
    head = wide.agg(*aggs).first()
    plans = {}
    for t in trends:
        i = head[f"k{t.key}"]
        if i["n"] < MIN_DATED_ROWS:
            continue
        span = (i["last"] - i["first"]).days
        freq = dates.pick_freq(span) if t.freq == "auto" else t.freq
        if t.metric == ROWS:
            agg, label = "count", "Record volume"
        else:
            label = t.metric
            additive = i["low"] >= 0 and is_additive(t.metric)
            agg = "rate" if frame.is_binary(t.metric) else "sum" if additive else "mean"
        years = i["last"].year - i["first"].year + 1
        plans[t.key] = TrendPlan(t.key, label, freq, agg, i["first"], i["last"], i["n"], years)
    return plans


def period_values(
    frame: Frame, trends: Sequence[Trend], plans: Mapping[int, TrendPlan]
) -> DataFrame:
    """(key, period, value, n): the series of every trend, gaps filled for sums and counts and
    a trailing partial period dropped. One aggregation over the table; the rest is calendar-
    sized (one row per period)."""
    trends = [t for t in trends if t.key in plans]
    wide, slots = _dated(frame, trends)
    used = {plans[t.key].freq for t in trends}
    by_period = wide.withColumns(
        {f"period_{f}": dates.period_label_date(F.col("t"), f) for f in used}
    )
    rows = melt(
        by_period,
        [
            {
                "key": str(t.key),
                "period": f"period_{plans[t.key].freq}",
                "y": slots[t.metric],
            }
            for t in trends
        ],
    ).where("y IS NOT NULL")
    sums = rows.groupBy("key", "period").agg(F.sum("y").alias("sum_y"), F.count("*").alias("n"))
    keep = []
    for t in trends:
        p = plans[t.key]
        label = F.col("period")
        start, end = dates.period_start(label, p.freq), dates.period_end(label, p.freq)
        length = F.datediff(end, start) * F.lit(86400.0 * COMPLETE_SHARE)
        last = F.lit(p.last).cast("timestamp_ntz")
        seconds = F.unix_timestamp(last.cast("timestamp")) - F.unix_timestamp(
            start.cast("timestamp")
        )
        keep.append(F.when(F.col("key") == p.key, seconds >= length))
    complete = F.coalesce(*keep)
    agg = _by_key({t.key: plans[t.key].agg for t in trends})
    value = (
        F.when(agg == "count", F.coalesce(F.col("n"), F.lit(0)).cast("double"))
        .when(agg == "sum", F.coalesce(F.col("sum_y"), F.lit(0.0)))
        .when(agg == "rate", 100.0 * F.col("sum_y") / F.col("n"))
        .otherwise(F.col("sum_y") / F.col("n"))
    )
    filled = [t for t in trends if plans[t.key].agg in ("count", "sum")]
    series = sums
    if filled:
        spine = None
        for t in filled:
            p = plans[t.key]
            step = {"week": "7 days", "month": "1 month", "quarter": "3 months"}[p.freq]
            first, last = (
                dates.period_label_date(F.lit(x).cast("timestamp_ntz"), p.freq)
                for x in (p.first, p.last)
            )
            one = frame.df.sparkSession.range(1).select(
                F.lit(t.key).alias("key"),
                F.explode(F.sequence(first, last, F.expr(f"interval {step}"))).alias("period"),
            )
            spine = one if spine is None else spine.unionByName(one)
        series = sums.join(F.broadcast(spine), ["key", "period"], "full")
    return series.where(complete).select(
        "key", "period", value.alias("value"), F.coalesce(F.col("n"), F.lit(0)).alias("n")
    )


def series_tests(series: DataFrame) -> DataFrame:
    """(key, periods, average, rho, p_value, start_value, end_value) per series."""
    per_key = Window.partitionBy("key")
    by_period = per_key.orderBy("period")
    k = F.col("periods")
    edge = F.greatest(F.least(F.floor(k / 4), F.lit(EDGE_PERIODS)), F.lit(1))
    placed = series.select(
        "key",
        "value",
        F.row_number().over(by_period).alias("pos"),
        F.count("*").over(per_key).alias("periods"),
        (
            F.rank().over(per_key.orderBy("value"))
            + (F.count("*").over(Window.partitionBy("key", "value")) - 1) / 2
        ).alias("r"),
    )
    middle = (k + 1) / 2
    dp, dr = F.col("pos") - middle, F.col("r") - middle
    per = placed.groupBy("key").agg(
        F.max("periods").alias("periods"),
        F.avg("value").alias("average"),
        F.try_divide(F.sum(dp * dr), F.sqrt(F.sum(dp * dp) * F.sum(dr * dr))).alias("rho"),
        F.avg(F.when(F.col("pos") <= edge, F.col("value"))).alias("start_value"),
        F.avg(F.when(F.col("pos") > k - edge, F.col("value"))).alias("end_value"),
    )
    per = per.where(k >= MIN_PERIODS)
    p = pvalues.student_p(pvalues.spearman_t(F.col("rho"), k), k - 2)
    return per.withColumn("trend_p", F.when(F.col("rho").isNotNull(), p))


def season_index(series: DataFrame) -> DataFrame:
    """(key, month, index, average, rank): month-of-year means against their mean."""
    months = series.groupBy("key", F.month("period").alias("month")).agg(
        F.avg("value").alias("average")
    )
    overall = F.avg("average").over(Window.partitionBy("key"))
    index = months.withColumn("index", F.try_divide(F.col("average"), overall))
    order = Window.partitionBy("key").orderBy(F.desc("index"), "month")
    return index.withColumn("rank", F.row_number().over(order))


def season_p(
    frame: Frame, trends: Sequence[Trend], plans: Mapping[int, TrendPlan]
) -> DataFrame:
    """(key, season_p) over all dated rows: row counts per month against a uniform year for
    sums and counts, Kruskal-Wallis by month for means and rates."""
    wide, slots = _dated(frame, trends)
    month = F.month("t").cast("short")
    parts = []
    counted = [t for t in trends if plans[t.key].agg in ("count", "sum")]
    if counted:
        rows = melt(
            wide.withColumn("month", month),
            [{"test": str(t.key), "month": "month", "y": slots[t.metric]} for t in counted],
        )
        counts = rows.where("y IS NOT NULL").groupBy("test", "month").agg(F.count("*").alias("n"))
        uniform = chi2_uniform(counts, 12)
        parts.append(uniform.select(F.col("test").alias("key"), F.col("p_value").alias("season_p")))
    averaged = [t for t in trends if plans[t.key].agg in ("mean", "rate")]
    if averaged:
        base = wide.select(
            month.alias("month"), *[F.col(slots[t.metric]).alias(f"y{t.key}") for t in averaged]
        )
        cuts = find_cuts(base, [f"y{t.key}" for t in averaged], frame.n_rows)
        cut = with_buckets(base, cuts)
        rows = melt(
            cut,
            [
                {
                    "test": str(t.key),
                    "bucket": bucket_name(f"y{t.key}"),
                    "value": f"y{t.key}",
                    "g": "month",
                }
                for t in averaged
            ],
        )
        tested = kruskal(melted_rank_sums(rows, sum(c.buckets for c in cuts.values())))
        p = pvalues.chi2_p(F.col("law_stat"), F.col("a"))
        parts.append(tested.select(F.col("test").alias("key"), p.alias("season_p")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def trend_evidence(
    frame: Frame, trends: Sequence[Trend], plans: Mapping[int, TrendPlan]
) -> DataFrame:
    trends = [t for t in trends if t.key in plans]
    series = period_values(frame, trends, plans)
    freq = _by_key({t.key: plans[t.key].freq for t in trends})
    period = F.coalesce(
        *[F.when(freq == f, dates.period_text(F.col("period"), f)) for f in FREQUENCIES]
    )
    charts = series.groupBy("key").agg(
        points(
            F.col("period"), period, F.col("value"), F.lit(None).cast("bigint")
        ).alias("points")
    )
    per = series_tests(series).join(F.broadcast(charts), "key")
    monthly = [t for t in trends if plans[t.key].freq == "month"]
    if monthly:
        months = season_index(series.where(F.col("key").isin(*[t.key for t in monthly])))
        seasonal = months.groupBy("key").agg(
            F.try_divide(F.max("index"), F.min("index")).alias("season_ratio"),
            F.max(F.when(F.col("rank") == 1, F.col("month"))).alias("peak_1"),
            F.max(F.when(F.col("rank") == 2, F.col("month"))).alias("peak_2"),
            F.avg(F.when(F.col("rank") <= 2, F.col("index"))).alias("peak_ratio"),
        )
        seasonal = seasonal.join(F.broadcast(season_p(frame, monthly, plans)), "key")
        per = per.join(F.broadcast(seasonal), "key", "left")
    else:
        per = per.withColumns(
            {
                c: F.lit(None).cast("double")
                for c in ("season_ratio", "peak_1", "peak_2", "peak_ratio", "season_p")
            }
        )
    rho = F.coalesce(F.col("rho"), F.lit(0.0))
    has_season = (F.col("periods") >= SEASONAL_PERIODS) & F.col("season_ratio").isNotNull()
    use_season = F.coalesce(
        has_season
        & (
            effects.normalized(F.lit(effects.SEASONAL_RATIO), F.col("season_ratio"))
            >= effects.normalized(F.lit(effects.SPEARMAN), rho)
        ),
        F.lit(False),
    )
    agg = _by_key({t.key: plans[t.key].agg for t in trends})
    years = _by_key({t.key: plans[t.key].years for t in trends})
    per = per.withColumns(
        {
            "target": _by_key({t.key: plans[t.key].label for t in trends}),
            "dimension": F.lit(frame.time),
            "agg": agg,
            "n": _by_key({t.key: plans[t.key].rows for t in trends}),
            "freq": freq,
            "seasonal": use_season,
            "effect_name": F.when(use_season, effects.SEASONAL_RATIO).otherwise(effects.SPEARMAN),
            "effect": F.when(use_season, F.col("season_ratio")).otherwise(rho),
            "p_value": F.when(use_season, F.col("season_p")).otherwise(F.col("trend_p")),
            "change": text.pct_change(F.col("end_value"), F.col("start_value")),
            "peak": F.when(
                has_season,
                dates.month_span(F.col("peak_1").cast("int"), F.col("peak_2").cast("int")),
            ),
        }
    )
    rate = F.col("agg") == "rate"
    kind = F.col("value_kind")
    per = text.with_text(
        per.withColumn("value_kind", F.when(rate, "percent").otherwise("number")),
        {"average_text": "average"},
        "value_kind",
    )
    label, change, seasonal_row = F.col("target"), F.col("change"), F.col("seasonal")
    clear = (
        effects.strength_of(F.lit(effects.SPEARMAN), rho) != "negligible"
    ) & F.coalesce(F.col("trend_p") < 0.05, F.lit(False))
    # The wording of titles, summaries and headlines.
    moved = F.when(F.col("end_value") > F.col("start_value"), " rose ").otherwise(" fell ")
    trend_text = F.when(
        clear,
        F.concat(label, moved, change, F.lit(" from the first to the last "), F.col("freq"),
                 F.lit("s")),
    ).otherwise(
        F.concat(label, F.lit(" shows no clear long-run trend ("), change,
                 F.lit(" first to last "), F.col("freq"), F.lit("s)"))
    )
    ratio = text.ratio_text(F.col("peak_ratio"))
    season_summary = F.concat(
        label, F.lit(" is seasonal: "), F.col("peak"), F.lit(" run at "), ratio,
        F.lit(" the average month. "), trend_text, F.lit("."),
    )
    plain_summary = F.concat(
        trend_text, F.lit(", averaging "), F.col("average_text"),
        F.lit(" per "), F.col("freq"), F.lit("."),
    )
    low, high = F.least("peak_1", "peak_2"), F.greatest("peak_1", "peak_2")
    peak_names = F.when(
        F.col("peak").isNotNull(),
        F.array(dates.month_name(low.cast("int")), dates.month_name(high.cast("int"))),
    ).otherwise(F.array().cast("array<string>"))
    note = F.when(
        seasonal_row,
        F.concat(
            F.lit("Seasonality is estimated from "), years.cast("string"),
            F.lit(" calendar years of data."),
        ),
    )
    return evidence(
        per,
        kind=F.lit("trend"),
        title=F.when(seasonal_row, F.concat(label, F.lit(" peaks in "), F.col("peak"))).otherwise(
            F.concat(label, F.lit(" trend over time"))
        ),
        summary=F.when(seasonal_row, season_summary).otherwise(plain_summary),
        headline=F.when(seasonal_row, F.concat(ratio, F.lit(" in "), F.col("peak"))).otherwise(
            change
        ),
        chart_kind=F.lit("line"),
        value_format=kind,
        reference=F.col("average"),
        reference_label=F.concat(F.lit("average "), F.col("freq")),
        caveats=F.array_compact(F.array(note)),
        facts=F.create_map(
            F.lit("change"), change,
            F.lit("start_value"), F.round("start_value", 4).cast("string"),
            F.lit("end_value"), F.round("end_value", 4).cast("string"),
            F.lit("peak_months"), F.array_join(peak_names, ","),
        ),
        filter_text=frame.filter,
    )


def _request(
    frame: Frame, metric: str, freq: str, where: Where | None
) -> tuple[Frame, Trend, dict[int, TrendPlan]]:
    if frame.time is None:
        raise AnalysisError("The dataset has no date column, so trends can't be computed.")
    metric = metric if metric == ROWS else frame.resolve(metric, "metric")
    if freq not in ("auto", *FREQUENCIES):
        raise AnalysisError("freq must be week, month or quarter.")
    sub = frame.subset(where)
    request = Trend(0, metric, freq)
    plans = plan_trends(sub, [request])
    if not plans:
        raise AnalysisError("Too few dated rows for a trend.")
    return sub, request, plans


def trend_series(
    frame: Frame, metric: str, freq: str = "auto", where: Where | None = None
) -> DataFrame:
    """(period, label, value, n) of one metric over calendar periods."""
    sub, request, plans = _request(frame, metric, freq, where)
    label = dates.period_text(F.col("period"), plans[0].freq)
    return period_values(sub, [request], plans).select(
        "period", label.alias("label"), "value", "n"
    )


def trend(
    frame: Frame, metric: str, freq: str = "auto", where: Where | None = None
) -> DataFrame:
    """One evidence row: how a metric moves over time."""
    sub, request, plans = _request(frame, metric, freq, where)
    found = stage(trend_evidence(sub, [request], plans))
    if found.isEmpty():
        raise AnalysisError(f"Too few whole periods of {metric!r}; a finer frequency has more.")
    return found
