"""Survival functions of test statistics, as Spark expressions.

Spark has no chi-square, normal or Student-t distribution functions. Here they are series and
continued fractions, folded over a sequence inside the row, so that tables of any size get their
p-values without leaving Spark. Only Mann-Whitney's exact law, for tests with a tiny side, counts
with whole numbers of any size and runs as a pandas UDF over the table of tests.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Executors need not have this package installed: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: From here on the t tail is expanded in 1/df; before, both agree to about ten digits.
EXPANSION_DF = 1e5
#: Largest small side for which Mann-Whitney's exact distribution is used, if there are no ties.
EXACT_SIDE = 8
#: Below this the series of the error function is summed, above its continued fraction, with
#: these numbers of terms: both are exact to the last digits there.
SERIES_UNTIL = 2.0
SERIES_TERMS, FRACTION_TERMS = 40, 80
#: Steps of the incomplete beta function's continued fraction at most, and more by the root of df.
BETA_STEPS, BETA_STEPS_PER_ROOT = 60, 3
#: A step gains ((1 + s) / (1 - s)) ** 2 in accuracy, s the root of 1 - x: so many over half the
#: logarithm of that, the root of df and a few first ones are exact to the last digits.
BETA_DIGITS, BETA_FIRST_STEPS = 20.2, 3
#: log(gamma(z + 1/2) / gamma(z)) is half of log z and these over odd powers of z,
#: from RATIO_FROM on to the last digits.
RATIO_TERMS = (-1 / 8, 1 / 192, -1 / 640, 17 / 14336, -31 / 18432)
RATIO_FROM = 12


def _double(value: Column | float) -> Column:
    return (F.lit(float(value)) if isinstance(value, (int, float)) else value).cast("double")


def _erfc_of_root(h: Column) -> Column:
    """The complementary error function of the root of ``h``."""
    x = F.sqrt(h)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(SERIES_TERMS)),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")),
        lambda s, n: F.struct(
            (s["term"] * 2 * h / (2 * n + 1)).alias("term"),
            (s["total"] + s["term"] * 2 * h / (2 * n + 1)).alias("total"),
        ),
        lambda s: s["total"],
    )
    fraction = F.aggregate(
        F.sequence(F.lit(FRACTION_TERMS), F.lit(1), F.lit(-1)), x, lambda below, n: x + n / 2 / below
    )
    return F.when(
        h < SERIES_UNTIL, 1 - 2 / math.sqrt(math.pi) * x * F.exp(-h) * series
    ).otherwise(F.exp(-h) / (math.sqrt(math.pi) * fraction))


def chi2_p(x: Column, df: Column) -> Column:
    """P(chi-square > x) for whole df, by the two-step recurrence in df, in logarithms."""
    half, k = _double(x) / 2, df.cast("int")
    odd = k % 2 == 1
    first = F.when(odd, 1).otherwise(2)
    start = F.when(odd, F.log(half) / 2 - math.log(math.sqrt(math.pi) / 2)).otherwise(F.log(half))
    steps = F.when(k - 2 >= first, F.sequence(first, k - 2, F.lit(2))).otherwise(
        F.array().cast("array<int>")
    )
    more = F.aggregate(
        steps,
        F.struct((start - half).alias("log"), F.lit(0.0).alias("total")),
        lambda s, j: F.struct(
            (s["log"] + F.log(half) - F.log(j / 2 + 1)).alias("log"),
            (s["total"] + F.exp(s["log"])).alias("total"),
        ),
        lambda s: s["total"],
    )
    least = F.when(odd, _erfc_of_root(half)).otherwise(F.exp(-half))
    tail = F.when(half <= 0, 1.0).otherwise(F.least(least + more, F.lit(1.0)))
    return F.when(half.isNotNull() & ~F.isnan(half) & k.isNotNull(), tail)


def normal_p(z: Column) -> Column:
    """Two-sided normal tail."""
    z = _double(z)
    return F.when(z.isNotNull() & ~F.isnan(z), _erfc_of_root(z * z / 2))


def _beta_fraction(a: Column, b: Column, x: Column, steps: Column) -> Column:
    """The incomplete beta function's continued fraction, from its last step to the first.

    Its inputs are worked out once and named: in the step itself they would be at every step.
    """

    def of(given: Column) -> Column:
        a, b, x = given["a"], given["b"], given["x"]

        def step(below: Column, m: Column) -> Column:
            rising = m * (b - m) * x / ((a + 2 * m) * below)
            falling = (a + m - 1) * (a + b + m - 1) * x / (a + 2 * m - 2)
            return 1 - falling / (a + 2 * m - 1 + rising)

        return 1 / F.aggregate(given["steps"], F.lit(1.0), step)

    numbers = F.sequence(steps, F.lit(1), F.lit(-1)).cast("array<double>")
    named = F.struct(a.alias("a"), b.alias("b"), x.alias("x"), numbers.alias("steps"))
    return F.transform(F.array(named), of)[0]


def _expanded_student(t: Column, df: Column) -> Column:
    """The normal tail at the point with the same probability, to second order in 1/df**2."""
    a = df - 0.5
    y = a * F.log1p(t * t / df)
    b = 48.0 * a * a
    third = (((-0.4 * y - 3.3) * y - 24.0) * y - 85.5) / (0.8 * y * y + 100.0 + b)
    return normal_p(F.sqrt(y) * (1.0 + (y + 3.0 + third) / b))


def student_p(t: Column, df: Column) -> Column:
    """Two-sided tail of Student's t."""
    t, df = _double(t), _double(df)
    a, b, squares = df / 2, F.lit(0.5), df + t * t
    x, rest = df / squares, t * t / squares
    z = a + RATIO_FROM
    ratio = F.log(z) / 2
    for k, c in enumerate(RATIO_TERMS):
        ratio = ratio + c / F.pow(z, F.lit(2.0 * k + 1))
    for k in range(RATIO_FROM):
        ratio = ratio - F.log1p(0.5 / (a + k))
    front = F.exp(ratio - math.log(math.sqrt(math.pi)) + a * F.log(x) + F.log(rest) / 2)
    far = x < (a + 1) / (a + b + 2)
    near, other = F.when(far, x).otherwise(rest), F.when(far, rest).otherwise(x)
    gain = 2 * F.log1p(F.sqrt(other)) - F.log(near)
    needed = BETA_FIRST_STEPS + F.sqrt(a) + BETA_DIGITS / gain
    steps = F.least(BETA_STEPS + BETA_STEPS_PER_ROOT * F.sqrt(a), needed).cast("int")
    first = F.when(far, a).otherwise(b)
    share = front * _beta_fraction(first, F.when(far, b).otherwise(a), near, steps) / first
    tail = F.when(far, share).otherwise(1 - share)
    p = F.when(F.abs(t) == float("inf"), 0.0).when(df >= EXPANSION_DF, _expanded_student(t, df))
    p = p.when(rest <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), tail)))
    known = t.isNotNull() & ~F.isnan(t) & df.isNotNull() & (df > 0)
    return F.when(known, p)


def _partitions_up_to(most: list[int], parts: int) -> list[int]:
    """For each number, how many partitions into parts of 1 to ``parts`` do not exceed it.

    The generating function 1 / ((1 - q)(1 - q)(1 - q^2)...(1 - q^parts)) is brought to the
    denominator (1 - q^period)^(parts + 1), so that a number takes parts + 1 terms, whatever
    its size.
    """
    period = math.lcm(*range(1, parts + 1))
    top = np.zeros(period * (parts + 1), dtype=object)
    top[0] = 1
    for i in (1, *range(1, parts + 1)):
        grown = top.copy()
        grown[period:] -= top[:-period]
        for offset in range(i):
            grown[offset::i] = np.cumsum(grown[offset::i])
        top = grown
    return [
        sum(
            int(top[j]) * math.comb((x - j) // period + parts, parts)
            for j in range(x % period, min(x + 1, len(top)), period)
        )
        for x in most
    ]


def exact_mann_whitney(u: float, n1: int, n2: int) -> float:
    """Two-sided exact p of U without ties, for a small side and another of any size.

    The counts of arrangements per U are the coefficients of a Gaussian binomial. Its numerator
    is multiplied out (2^small terms), the denominator counts partitions; all exact integers.
    """
    small, large = sorted((int(n1), int(n2)))
    nearer = small * large - math.ceil(max(u, n1 * n2 - u) - 1e-9)
    signs = {0: 1}
    for i in range(1, small + 1):
        for shift, sign in list(signs.items()):
            signs[shift + large + i] = signs.get(shift + large + i, 0) - sign
    signs = {nearer - shift: sign for shift, sign in signs.items() if shift <= nearer}
    counts = _partitions_up_to(list(signs), small)
    tail = sum(sign * n for sign, n in zip(signs.values(), counts, strict=True))
    return min(2 * tail / math.comb(small + large, small), 1.0)


@F.pandas_udf(T.DoubleType())
def _exact_udf(u: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    rows = zip(u, n1, n2, strict=True)
    return pd.Series(
        [None if pd.isna(x) else exact_mann_whitney(x, int(a), int(b)) for x, a, b in rows], dtype=float
    )


def tail_p(law: Column, stat: Column, a: Column, b: Column, exact: bool = True) -> Column:
    """p-values of a mixed table of tests: law is chi2, student, normal, exact_u or null.

    Without ``exact`` the table has no row of the last law, and no Python is run.
    """
    stat, a, b = (_double(c) for c in (stat, a, b))

    def of(name: str, value: Column) -> Column:
        return F.when(law == name, value)

    p = F.when(law == "chi2", chi2_p(of("chi2", stat), of("chi2", a)))
    p = p.when(law == "student", student_p(stat, a)).when(law == "normal", normal_p(stat))
    if exact:
        p = p.when(law == "exact_u", _exact_udf(of("exact_u", stat), a, b))
    return p


def spearman_t(rho: Column, n: Column) -> Column:
    """t statistic of a rank correlation; infinite for a perfect one."""
    unit = F.least(F.abs(rho), F.lit(1.0))
    return F.when(unit >= 1.0, F.lit(float("inf"))).otherwise(
        unit * F.sqrt((n - 2) / ((1.0 - unit) * (1.0 + unit)))
    )
