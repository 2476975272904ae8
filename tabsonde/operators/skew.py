"""Equi-joins whose left side may have one key on a large share of its rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    salt_on: Sequence[str],
    how: str = "inner",
) -> DataFrame:
    """Join after spreading each key of the left side over salts; the (smaller) right side is
    repeated per salt. The salt is a hash of other columns, so reruns place rows alike."""
    spread = left.withColumn("salt", F.pmod(F.xxhash64(*salt_on), F.lit(SALTS)).cast("int"))
    repeated = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return spread.join(repeated, [*keys, "salt"], how).drop("salt")
