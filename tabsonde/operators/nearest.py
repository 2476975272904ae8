"""As-of matches: the nearest known values below and above a wanted one, of the same key.

Wanted and known rows of a key are sorted together once in either direction, and the last known
value on the way is carried along; no wanted row ever meets all known ones. A key that holds
more than its share of the rows is cut into ranges of its values, and what lies nearest beyond
the borders of a range is put into it, so that every range can be sorted by itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage

#: A key is cut into ranges if it holds more rows than this and than this share of all rows;
#: there are at most as many such keys as the reciprocal of the share.
LARGE_KEY = 100_000
LARGE_SHARE = 0.001
#: Ranges of such a key, found in two steps.
STEP = 32
RANGES = STEP * STEP
SKETCH_SIZE = 4 * RANGES


def _edges(known: DataFrame, by: Sequence[str], value: str, large: DataFrame) -> DataFrame:
    """(by, edges): what cuts the values of each large key into RANGES even ranges, about."""
    sketch = F.call_function("kll_sketch_agg_double", F.col(value), F.lit(SKETCH_SIZE))
    merged = F.call_function("kll_merge_agg_double", F.col("sketch"))
    at = F.expr(f"array({', '.join(f'{k / RANGES!r}D' for k in range(1, RANGES))})")
    parts = (
        known.join(F.broadcast(large), list(by))
        .groupBy(*by, F.pmod(F.spark_partition_id(), F.lit(STEP)).alias("part"))
        .agg(sketch.alias("sketch"))
    )
    return parts.groupBy(*by).agg(
        F.call_function("kll_sketch_get_quantile_double", merged, at).alias("edges")
    )


def _range_of(value: Column) -> Column:
    """The number of ``edges`` that are at most ``value``: STEP edges apart first, then between."""
    coarse = F.size(
        F.filter(F.transform(F.sequence(F.lit(1), F.lit(STEP - 1)), _edge), lambda e: e <= value)
    )
    fine = F.slice("edges", coarse * STEP + 1, F.lit(STEP - 1))
    return coarse * STEP + F.size(F.filter(fine, lambda e: e <= value))


def _edge(k: Column) -> Column:
    return F.element_at("edges", k * STEP)


def nearest_known(
    wanted: DataFrame,
    known: DataFrame,
    by: Sequence[str],
    at: str,
    value: str,
    kind: str,
    kinds: Sequence[str],
) -> DataFrame:
    """``wanted`` with ``<kind>_below`` and ``<kind>_above`` for each of ``kinds``.

    These are the greatest ``value`` of that ``kind`` at most ``at``, and the least at least
    ``at``, among the rows of ``known`` with the same ``by``; null where there is none. Nulls
    and NaN in ``value`` are passed over.
    """
    by = list(by)
    wanted = stage(wanted)
    known = known.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*by, kind, value)
    known = stage(known.join(wanted.select(*by).distinct(), by, "left_semi").distinct())
    sizes = known.groupBy(*by).agg(F.count(F.lit(1)).alias("size"))
    total = known.count()
    large = stage(
        sizes.where(F.col("size") > max(LARGE_KEY, LARGE_SHARE * total)).select(*by)
    )
    ranged = not large.isEmpty()
    part, borders = F.lit(0), None
    if ranged:
        edges = F.broadcast(stage(_edges(known, by, value, large)))

        def cut(df: DataFrame, column: str) -> DataFrame:
            placed = df.join(edges, by, "left")
            inside = F.when(F.col("edges").isNotNull(), _range_of(F.col(column))).otherwise(0)
            return placed.withColumn("part", inside).drop("edges")

        wanted, known = cut(wanted, at), cut(known, value)
        part = F.col("part")
        # Per kind, what lies next to every range of a large key: RANGES rows a key.
        spans = known.join(F.broadcast(large), by).groupBy(*by, "part").agg(
            *[F.min(F.when(F.col(kind) == k, F.col(value))).alias(f"least_{k}") for k in kinds],
            *[F.max(F.when(F.col(kind) == k, F.col(value))).alias(f"most_{k}") for k in kinds],
        )
        every = large.select(*by, F.explode(F.sequence(F.lit(0), F.lit(RANGES - 1))).alias("part"))
        rising = Window.partitionBy(*by).orderBy("part")
        lower = rising.rowsBetween(Window.unboundedPreceding, -1)
        falling = Window.partitionBy(*by).orderBy(F.desc("part"))
        upper = falling.rowsBetween(Window.unboundedPreceding, -1)
        beyond = [
            F.struct(F.lit(k).alias(kind), F.last(f"{side}_{k}", True).over(frame).alias(value))
            for k in kinds
            for side, frame in (("most", lower), ("least", upper))
        ]
        borders = (
            every.join(spans, [*by, "part"], "left")
            .select(*by, "part", F.array(*beyond).alias("beyond"))
            .select(*by, F.inline("beyond"), "part")
            .where(F.col(value).isNotNull())
        )
        known = known.select(*by, kind, value, "part").union(borders)
    nothing = F.lit(None).cast("double")

    def carried(k: str) -> Column:
        return F.when(F.col(kind) == k, F.col(value)).otherwise(nothing)

    own = [c for c in wanted.columns if c != "part"]
    asked = F.struct(*own)
    rows = known.select(
        *by, part.alias("part"), F.col(value).alias("place"), F.lit(0).alias("asks"),
        *[carried(k).alias(f"known_{i}") for i, k in enumerate(kinds)],
        F.lit(None).cast(wanted.select(asked.alias("s")).schema["s"].dataType).alias("asked"),
    ).unionByName(
        wanted.select(
            *by, part.alias("part"), F.col(at).alias("place"), F.lit(1).alias("asks"),
            *[nothing.alias(f"known_{i}") for i in range(len(kinds))],
            asked.alias("asked"),
        )
    )
    key = Window.partitionBy(*by, "part")
    # Known values stand before wanted ones of the same place in both directions.
    rising = key.orderBy("place", "asks").rowsBetween(Window.unboundedPreceding, 0)
    falling = key.orderBy(F.desc("place"), "asks").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumns(
        {
            f"{k}_{side}": F.last(f"known_{i}", True).over(frame)
            for i, k in enumerate(kinds)
            for side, frame in (("below", rising), ("above", falling))
        }
    )
    return placed.where("asks = 1").select(
        *[F.col(f"asked.{c}").alias(c) for c in own],
        *[f"{k}_{side}" for k in kinds for side in ("below", "above")],
    )
