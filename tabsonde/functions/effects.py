"""Effect sizes on a common footing: strength words, normalised size, association."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON_SQUARED = "epsilon squared"
SPEARMAN = "Spearman rho"
RANK_BISERIAL = "rank-biserial r"
CRAMERS_V = "Cramer's V"
RATE_RATIO = "rate ratio"
TOP_SHARE = "top-20% share"
SEASONAL_RATIO = "seasonal ratio"

# Fixed values: (weak, moderate, strong) limits of each effect measure.
THRESHOLDS: dict[str, tuple[float, float, float]] = {
    EPSILON_SQUARED: (0.01, 0.06, 0.14),
    SPEARMAN: (0.1, 0.3, 0.5),
    RANK_BISERIAL: (0.1, 0.3, 0.5),
    CRAMERS_V: (0.1, 0.2, 0.35),
    RATE_RATIO: (1.25, 1.5, 2.0),
    TOP_SHARE: (0.35, 0.5, 0.65),
    SEASONAL_RATIO: (1.2, 1.4, 1.7),
}
# Ratios are neutral at 1, every other measure at 0.
RATIO_EFFECTS = (RATE_RATIO, SEASONAL_RATIO)
MAX_NORMALIZED = 1.5


def _threshold(name: Column, level: int) -> Column:
    limits = F.create_map(*[F.lit(x) for k, v in THRESHOLDS.items() for x in (k, v[level])])
    return F.try_element_at(limits, name)


def strength_of(name: Column, value: Column) -> Column:
    size = F.abs(value)
    return (
        F.when(size >= _threshold(name, 2), "strong")
        .when(size >= _threshold(name, 1), "moderate")
        .when(size >= _threshold(name, 0), "weak")
        .otherwise("negligible")
    )


def normalized(name: Column, value: Column) -> Column:
    base = F.when(name.isin(*RATIO_EFFECTS), 1.0).otherwise(0.0)
    scaled = (F.abs(value) - base) / (_threshold(name, 2) - base)
    return F.least(F.greatest(scaled, F.lit(0.0)), F.lit(MAX_NORMALIZED))


def association(name: Column, value: Column) -> Column:
    return F.when(name == EPSILON_SQUARED, F.sqrt(F.greatest(value, F.lit(0.0)))).otherwise(
        F.least(F.abs(value), F.lit(1.0))
    )
