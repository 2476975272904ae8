"""Connected components of a table of links, by alternating large and small stars.

Every round is a grouping and a join over the links, written to the shared folder; the driver
only reads how many links there are and whether they changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest of its neighbours and itself."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
    larger = both.where("b > a")
    return larger.join(least, larger["a"] == least["node"]).select(
        F.col("m").alias("a"), F.col("b")
    ).where("a < b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    least = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("m"))
    down = links.join(least, links["b"] == least["node"]).select(
        F.col("m").alias("a"), F.col("a").alias("b")
    )
    own = least.select(F.col("m").alias("a"), F.col("node").alias("b"))
    return down.union(own).where("a < b").distinct()


def _mark(links: DataFrame) -> tuple:
    row = links.agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")
    ).first()
    return row["n"], row["x"]


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: longs without nulls).

    The root is the smallest node reachable. Loops and repeated links change nothing; no links
    give no rows.
    """
    links = stage(
        links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .where("a < b")
        .distinct(),
        "links",
    )
    before = _mark(links)
    while before[0]:
        links = stage(_small_star(_large_star(links)), "links")
        after = _mark(links)
        if after == before:
            break
        before = after
    return links.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
        links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    )
